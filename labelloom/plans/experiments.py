"""Train, compare and cross-validate over the training table."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import has_text, summary_text
from labelloom.model.classifier import Classifier, Settings, fit_each, fit_folds
from labelloom.operators.evaluation import (
    compare_experiments, fold_summary, prediction_metrics)
from labelloom.operators.keyed import keep_frequent
from labelloom.operators.strata import with_document_holdout, with_folds, with_holdout
from labelloom.session import shared_folder, stage

IDENTITY = ["source_id", "filename"]
MIN_TEXTS = 10


def model_rows(training: DataFrame, at_least: int = 5) -> DataFrame:
    """Training rows with a label and text, of classes frequent enough to split."""
    usable = training.where(F.col("label").isNotNull() & has_text(F.col("feature_text")))
    return keep_frequent(usable, "label", at_least)


def experiment_texts() -> dict[str, Column]:
    """The text of each experiment as an expression over the training table."""
    return {
        "baseline": F.col("baseline_text"),
        "summary_only": summary_text(F.col("summary"), F.col("doc_subtype")),
        "combined": F.col("feature_text"),
    }


def text_readiness(rows: DataFrame, text: Column, by: str, more_than: int = MIN_TEXTS) -> DataFrame:
    """``by, with_text, enough``: rows that hold any text, and whether they are more than ``more_than``."""
    with_text = F.count_if(F.coalesce(F.length(text), F.lit(0)) > 0)
    return rows.groupBy(by).agg(with_text.alias("with_text")).withColumn(
        "enough", F.col("with_text") > more_than)


def enough_texts(rows: DataFrame, text: Column, more_than: int = MIN_TEXTS) -> bool:
    """Whether more than ``more_than`` rows hold any text."""
    return rows.where(F.length(text) > 0).limit(more_than + 1).count() > more_than


def split_rows(training: DataFrame, by_document: bool = False) -> DataFrame:
    """Model rows with ``part``.

    The split is by row, as each label of a document is its own row. With
    ``by_document`` all rows of a document stay together, and every label is level.
    """
    rows = model_rows(training)
    if not by_document:
        return with_holdout(rows, "label", IDENTITY)
    return rows.join(document_parts(rows).select("source_id", "part"), "source_id")


def document_parts(rows: DataFrame) -> DataFrame:
    """``source_id, labels, part``: each document on one side, by all of its labels."""
    documents = rows.groupBy("source_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return with_document_holdout(documents, "labels", ["source_id"])


def experiment_rows(split: DataFrame) -> dict[str, DataFrame]:
    """The split with each experiment's ``text``."""
    return {name: split.select("source_id", "filename", "title", "classification", "doc_subtype",
                               "label", "part", text.alias("text"))
            for name, text in experiment_texts().items()}


def run_experiments(split: DataFrame, settings: Settings = Settings()
                    ) -> tuple[DataFrame, dict[str, Classifier]]:
    """Predictions on the test part for every experiment, and the fitted models.

    ``split`` carries ``part``; store it first, as each fit reads it again.
    """
    rows = experiment_rows(split)
    train = {name: df.where(F.col("part") == "train") for name, df in rows.items()}
    if not enough_texts(train["summary_only"], F.col("text")):
        del train["summary_only"]
    models = fit_each(train, "text", settings)
    predictions = [
        model.predict(rows[name].where(F.col("part") == "test"), "text").select(
            F.lit(name).alias("experiment"), "source_id", "filename", "title", "classification",
            "doc_subtype", F.col("label").alias("true"), "pred", "probs")
        for name, model in models.items()
    ]
    return reduce(DataFrame.unionByName, predictions), models


def experiment_comparison(predictions: DataFrame) -> DataFrame:
    return compare_experiments(prediction_metrics(predictions, ["experiment"]),
                               "baseline", "combined")


def comparison_of_all(predictions: DataFrame) -> DataFrame:
    """The comparison with a ``status``; an experiment with too few texts has null metrics."""
    names = predictions.sparkSession.createDataFrame([(n,) for n in experiment_texts()], "experiment string")
    compared = experiment_comparison(predictions).withColumn("status", F.lit("fitted"))
    return names.join(compared, "experiment", "left").fillna({"status": "too few texts"})


def prediction_checks(predictions: DataFrame, by: str) -> DataFrame:
    """Rows per ``by``, those whose probabilities sum to 1 and those that predict the likeliest class."""
    total = F.aggregate("probs", F.lit(0.0), lambda t, c: t + c["p"])
    top = F.array_max(F.transform("probs", lambda c: c["p"]))
    first = F.get(F.filter("probs", lambda c: c["p"] == top), 0)["class"]
    return predictions.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        F.count_if(F.col("pred") == first).alias("likeliest"))


def reload_checks(split: DataFrame, predictions: DataFrame, models: dict[str, Classifier]) -> DataFrame:
    """``prediction_checks`` per experiment, and the test rows whose prediction a saved
    and loaded model repeats with equal probabilities."""
    spark = split.sparkSession
    repeated = []
    for name, model in models.items():
        folder = f"{shared_folder(spark).rstrip('/')}/experiment-{uuid.uuid4().hex}"
        model.save(spark, folder)
        tests = experiment_rows(split)[name].where(F.col("part") == "test")
        first = model.predict(tests, "text").withColumnsRenamed({"pred": "first_pred", "probs": "first_probs"})
        both = Classifier.load(spark, folder).predict(first, "text")
        repeated.append(both.agg(
            F.lit(name).alias("experiment"),
            F.count_if((F.col("pred") == F.col("first_pred")) & (F.col("probs") == F.col("first_probs")))
            .alias("same_after_load")))
    return prediction_checks(predictions, "experiment").join(
        reduce(DataFrame.unionByName, repeated), "experiment")


def fold_predictions(rows: DataFrame, text: str = "feature_text", folds: int = 5,
                     settings: Settings = Settings()) -> DataFrame:
    """Out-of-fold predictions; vocabulary, weights and model are those of the other folds.

    ``rows`` carries ``fold``; store it first.
    """
    columns = ["fold", "source_id", "filename", "label"]
    vectors, models = fit_folds(rows.select(*columns, text), text, folds, settings=settings)
    parts = [
        model.predict_vectors(vectors.where(F.col("fold") == fold).select(*columns, "damped")).select(
            "fold", "source_id", "filename", F.col("label").alias("true"), "pred", "probs")
        for fold, model in models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def cross_validation(training: DataFrame, folds: int = 5,
                     settings: Settings = Settings()) -> DataFrame:
    """Summary of the weighted F1 of each fold."""
    rows = stage(with_folds(model_rows(training), "label", IDENTITY, folds), "folds")
    scored = fold_predictions(rows, folds=folds, settings=settings)
    return fold_summary(prediction_metrics(scored, ["fold"]))
