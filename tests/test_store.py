"""Stored models and tables when something goes wrong."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from labelloom.model import store
from labelloom.model.classifier import Classifier, fit_classifier
from labelloom.sources import tables


@pytest.fixture(scope="module")
def models(spark):
    rows = [(f"{word} text", label) for label, word in (("a", "alpha"), ("b", "beta"), ("c", "gamma")) for _ in range(4)]
    df = spark.createDataFrame(rows, "text string, label string")
    return df, fit_classifier(df, "text"), fit_classifier(df.where("label <> 'c'"), "text")


def test_the_newest_complete_version_is_loaded(spark, models, tmp_path):
    df, first, second = models
    folder = str(tmp_path / "model")
    first.save(spark, folder)
    assert Classifier.load(spark, folder).labels == ["a", "b", "c"]
    second.save(spark, folder)
    again = Classifier.load(spark, folder)
    assert again.labels == ["a", "b"]
    texts = df.where("label <> 'c'").select("text")
    assert sorted(again.predict(texts, "text").collect()) == sorted(second.predict(texts, "text").collect())


def test_a_version_without_manifest_does_not_exist(spark, models, tmp_path, monkeypatch):
    _, first, second = models
    folder = str(tmp_path / "model")
    first.save(spark, folder)

    def crash(*_):
        raise OSError("no space left")

    monkeypatch.setattr(store, "files_of", crash)  # after pipeline and labels, before the manifest
    with pytest.raises(OSError):
        second.save(spark, folder)
    monkeypatch.undo()
    assert len(glob.glob(f"{folder}/version-*")) == 2
    assert Classifier.load(spark, folder).labels == ["a", "b", "c"]


@pytest.mark.parametrize("damage", ["lost", "changed"])
def test_a_damaged_version_is_passed_over(spark, models, tmp_path, damage):
    _, first, second = models
    folder = str(tmp_path / "model")
    first.save(spark, folder)
    newest = store.save(spark, folder, second.pipeline, second.labels)
    path = sorted(glob.glob(f"{folder}/{newest}/pipeline/stages/*/data/*.parquet"))[0]
    os.rename(path, f"{tmp_path}/elsewhere")
    if damage == "changed":  # in a store that keeps no checksums of its own
        folder_of, name = os.path.split(path)
        os.rename(f"{folder_of}/.{name}.crc", f"{tmp_path}/elsewhere.crc")
        with open(path, "wb") as f:
            f.write(b"other bytes")
    assert Classifier.load(spark, folder).labels == ["a", "b", "c"]


def test_nothing_complete(spark, tmp_path):
    with pytest.raises(store.NoCompleteModel):
        Classifier.load(spark, str(tmp_path / "none"))


def test_a_failing_write_leaves_the_old_table(spark):
    name = "survivor"
    try:
        assert tables.overwrite_table(spark.range(5), name) == 5
        bad = spark.range(3).withColumn("x", F.raise_error(F.lit("stop")))
        with pytest.raises(Exception, match="stop"):
            tables.overwrite_table(bad, name)
        assert tables.stored_rows(spark, name) == 5
    finally:
        tables.remove_table(spark, name)


def test_a_table_is_overwritten_from_itself_while_it_is_read(spark):
    name = "self_read"
    try:
        tables.overwrite_table(spark.range(5), name)
        reader = spark.table(name)
        reader.count()
        tables.overwrite_table(spark.table(name).select((F.col("id") * 2).alias("twice"), F.lit("x").alias("more")), name)
        assert reader.count() == 5 and reader.columns == ["id"]
        assert [tuple(r) for r in spark.table(name).orderBy("twice").collect()] == [(2 * i, "x") for i in range(5)]
    finally:
        tables.remove_table(spark, name)
    assert not spark.catalog.tableExists(name)


def test_missing_rows_are_noticed_before_the_name_is_switched(spark, monkeypatch):
    name = "checked"
    try:
        tables.overwrite_table(spark.range(5), name)
        monkeypatch.setattr(tables.Observation, "get", property(lambda self: {"n": 99}))
        with pytest.raises(tables.IncompleteWrite):
            tables.overwrite_table(spark.range(7), name)
        monkeypatch.undo()
        assert tables.stored_rows(spark, name) == 5
    finally:
        tables.remove_table(spark, name)
