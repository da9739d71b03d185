"""Words and neighbours counted as numbers, against Spark's own steps on strings."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom.model.classifier import fit_classifier
from labelloom.model.features import damped_counts, fit_features
from labelloom.operators import terms


@pytest.fixture(scope="module")
def texts(spark):
    dice = random.Random(7)
    letters = "aAb_1 é²×.中𝒜😀́İΣ\n٣ Ⅰx "
    rows = [(i, i % 4, "".join(dice.choices(letters, k=dice.randrange(40)))) for i in range(300)]
    plain = [(i, i % 4, " ".join(dice.choices(["aa", "bb", "CC", "x", "dd-ee"], k=dice.randrange(9)))) for i in range(300, 500)]
    return spark.createDataFrame([*rows, *plain, (500, 1, None), (501, None, "aa bb aa bb"), (502, 2, "")],
                                 "id int, fold int, t string").persist()


def counts(df, columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_words_are_those_of_sparks_search(spark, texts, monkeypatch):
    monkeypatch.setattr(terms, "BUCKETS", 1 << 20)
    once = terms.gram_lists(texts, "id", F.col("t"))
    want = sorted((r.term, r.n) for r in once.select(F.explode("grams").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")).collect())
    got = terms._counts(terms.lowered_texts(texts, F.col("t")), None)
    assert sorted((r.term, r.corpus[0]) for r in got.collect()) == want
    sums = terms.bucket_sums(terms.lowered_texts(texts, F.col("t")))
    assert sum(r.upper for r in sums.collect()) == sum(n for _, n in want)


@pytest.mark.parametrize("buckets", [1, 64, 1 << 20])
def test_vocabularies_of_texts_are_those_of_gram_lists(texts, monkeypatch, buckets):
    monkeypatch.setattr(terms, "BUCKETS", buckets)
    lists = texts.select("fold", terms.with_bigrams(terms.tokens(F.col("t"))).alias("grams"))
    plain = terms.lowered_texts(texts, F.col("t"), "fold")
    columns = ["term", "corpus_count", "document_count"]
    assert counts(terms.vocabulary(plain, 15), columns) == counts(terms.vocabulary(lists, 15), columns)
    columns = ["fold", *columns]
    assert counts(terms.fold_vocabularies(plain, 4, 15), columns) == counts(terms.fold_vocabularies(lists, 4, 15), columns)


def test_damped_counts_are_those_of_the_stages(texts):
    filled = texts.select("id", F.coalesce("t", F.lit("")).alias("t"))
    model = fit_features(filled, "t", max_features=40)
    want = {r.id: r.damped for r in model.transform(filled).select("id", "damped").collect()}
    got = {r.id: r.v for r in filled.select("id", damped_counts(F.col("t"), model.stages[1].vocabulary).alias("v")).collect()}
    assert any(len(v.indices) > 2 for v in got.values())
    for i, v in want.items():
        assert got[i].size == v.size and got[i].indices.tolist() == v.indices.tolist()
        assert got[i].values.tolist() == pytest.approx(v.values.tolist(), rel=1e-14)


def test_predictions_make_no_bigrams_and_no_json(spark):
    rows = spark.createDataFrame([("aa bb", "x"), ("aa cc", "y"), ("bb cc", "x"), ("cc aa", "y")], "t string, label string")
    model = fit_classifier(rows, "t")
    predicted = model.predict(rows, "t")
    plan = predicted._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "from_json" not in plan and "zip_with(slice" not in plan
    whole = model._scored(rows.withColumn("model_text", F.col("t")), ["t"])
    assert [r.pred for r in predicted.collect()] == [r.pred for r in whole.collect()]
    for r, s in zip(predicted.collect(), whole.collect()):
        assert [c.p for c in r.probs] == pytest.approx([c.p for c in s.probs], abs=1e-12)
