import math
from collections import Counter

import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from labelloom.model.classifier import Classifier, Settings, fit_classifier
from labelloom.model.features import SublinearCounts, fit_features
from labelloom.operators import terms
from labelloom.operators.evaluation import prediction_metrics
from labelloom.plans import experiments
from labelloom.plans.replies import parsed_replies
from labelloom.plans.scoring import prompts, score_documents

TOPICS = {"law": "court judge contract clause", "tax": "income levy rate refund",
          "lab": "sample assay reagent culture"}


@pytest.fixture(scope="module")
def training(spark):
    """Rows of three topics in the shape of the training table, and one rare label."""
    rows = []
    for topic, words in TOPICS.items():
        w = words.split()
        for i in range(20):
            text = f"{w[i % 4]} {w[(i + 1) % 4]} common filler"
            rows.append((f"{topic}{i}", f"{topic}{i}.txt", f"title {i}", "c", "s", topic, text,
                         f"s c {text} ", f"title {i} x.pdf"))
    rows.append(("r", "r.txt", "t", "c", "s", "rare", "court", "s c court ", "t x"))
    return spark.createDataFrame(rows, "source_id string, filename string, title string, "
                                 "classification string, doc_subtype string, label string, "
                                 "summary string, feature_text string, baseline_text string").persist()


def test_vectors_equal_the_relational_weights(spark, training):
    texts = training.select(F.col("source_id").alias("id"), F.col("feature_text").alias("text"))
    model = fit_features(texts, "text")
    names = model.stages[1].vocabulary
    got = {r.id: {names[i]: v for i, v in zip(r.features.indices.tolist(), r.features.values.tolist())}
           for r in model.transform(texts).select("id", "features").collect()}
    grams = terms.gram_lists(texts, "id", F.col("text"))
    want = {}
    for r in terms.tfidf_weights(grams, "id", terms.vocabulary(grams)).collect():
        want.setdefault(r.id, {})[r.term] = r.weight
    assert got.keys() == want.keys()
    for doc, weights in want.items():
        assert got[doc] == pytest.approx(weights)
        assert math.isclose(sum(w * w for w in weights.values()), 1)


def test_weights_by_hand(spark):
    df = spark.createDataFrame([(1, "aa aa bb"), (2, "aa cc"), (3, "bb")], "id int, t string")
    grams = terms.gram_lists(df, "id", F.col("t"))
    got = {(r.id, r.term): r.weight for r in
           terms.tfidf_weights(grams, "id", terms.vocabulary(grams)).collect()}
    idf = math.log(4 / 3) + 1
    a, b = (1 + math.log(2)) * idf, idf
    norm = math.hypot(a, b)
    assert got == pytest.approx({(1, "aa"): a / norm, (1, "bb"): b / norm, (2, "aa"): 1.0,
                                 (3, "bb"): 1.0})


def test_fit_predict_save_load(spark, training, tmp_path):
    rows = experiments.model_rows(training)
    assert {r.label for r in rows.select("label").distinct().collect()} == set(TOPICS)
    model = fit_classifier(rows, "feature_text")
    assert model.labels == sorted(TOPICS)
    scored = model.predict(rows, "feature_text").persist()
    assert scored.count() == 60
    for r in scored.select("probs", "pred").collect():
        assert math.isclose(sum(c.p for c in r.probs), 1)
        assert r.pred == max(r.probs, key=lambda c: c.p)["class"]
    accuracy = prediction_metrics(scored.withColumnRenamed("label", "true")).first().accuracy
    assert accuracy > 0.95
    model.save(spark, str(tmp_path / "model"))
    again = Classifier.load(spark, str(tmp_path / "model"))
    assert again.labels == model.labels
    before, after = (m.predict(rows, "feature_text").select("source_id", "pred")
                     for m in (model, again))
    assert before.exceptAll(after).count() == 0


def test_load_of_a_missing_model_fails(spark, tmp_path):
    with pytest.raises(Exception):
        Classifier.load(spark, str(tmp_path / "none"))


def test_two_classes_are_binary(spark, training):
    model = fit_classifier(training.where("label IN ('law', 'tax')"), "feature_text")
    row = model.predict(training.where("label = 'law'"), "feature_text").first()
    assert len(row.probs) == 2 and row.pred == "law"


def test_experiments_and_folds(spark, training):
    split = experiments.split_rows(training).persist()
    assert Counter(r.part for r in split.collect()) == {"train": 48, "test": 12}
    predictions, models = experiments.run_experiments(split)
    assert set(models) == {"baseline", "summary_only", "combined"}
    rows = {r.experiment: r for r in experiments.experiment_comparison(predictions).collect()}
    assert rows["combined"].accuracy > 0.9 > rows["baseline"].accuracy
    assert rows["combined"].verdict == "improves"
    summary = experiments.cross_validation(training, folds=3, settings=Settings(parallel_fits=2))
    assert summary.first()["mean"] > 0.9


def test_summary_experiment_needs_texts(spark, training):
    blank = training.withColumn("summary", F.lit("")).withColumn("doc_subtype", F.lit(None).cast("string"))
    _, models = experiments.run_experiments(experiments.split_rows(blank).persist())
    assert set(models) == {"baseline", "combined"}


def test_split_by_document_keeps_rows_together(spark, training):
    doubled = training.unionByName(training.withColumn("label", F.lit("tax")))
    parts = experiments.split_rows(doubled, by_document=True).groupBy("source_id").agg(
        F.count_distinct("part").alias("n"))
    assert parts.where("n > 1").count() == 0


def test_scoring_routes_every_document(spark, training):
    model = fit_classifier(experiments.model_rows(training), "feature_text")
    best = spark.createDataFrame([
        (1, "m", 2, "court text", 0.9), (2, None, None, "", 0.0), (3, "m", 1, "t", 0.8),
        (4, "m", 1, "t", 0.8), (5, "m", 1, "t", 0.4), (6, "m", 1, "t", 0.3999),
    ], "doc_id int, method string, pages int, text string, quality_score double")
    good = '{"summary": "court judge contract", "key_terms": ["clause"], "llm_confidence": "%s"}'
    replies = parsed_replies(spark.createDataFrame([
        (1, 200, good % "high"), (3, 500, "down"), (5, 200, good % "low"), (6, 200, good % "high"),
    ], "doc_id int, status_code int, body string"))
    rows = {r.doc_id: r for r in score_documents(best, replies, model).collect()}
    assert {k: r.state for k, r in rows.items()} == {
        1: "ready", 2: "low_quality", 3: "failed_reply", 4: "no_reply", 5: "ready", 6: "low_quality"}
    assert rows[1].prediction == "law" and rows[1].band in ("HIGH", "MEDIUM")
    assert not rows[1].review and rows[1].first_terms == "clause"
    assert [c["class"] for c in rows[1].ranking][0] == "law" and len(rows[1].ranking) == 3
    assert rows[5].review and rows[5].review_reason == "LLM confidence low"
    for doc in (2, 3, 4, 6):
        assert rows[doc].prediction is None and rows[doc].top_probability is None
        assert rows[doc].review and rows[doc].review_reason and rows[doc].band is None
    assert {r.doc_id for r in prompts(best, "Summarise the document.").collect()} == {1, 3, 4, 5}


def test_logarithm_of_counts_stays_in_the_jvm(spark):
    """Hand-worked vector; zero entries stay absent and an empty vector stays empty."""
    counts = CountVectorizerModel.from_vocabulary(["a", "b", "c"], "grams", "counts")
    docs = spark.createDataFrame([(0, ["a", "a", "c"]), (1, [])], "id int, grams array<string>")
    out = SublinearCounts(inputCol="counts", outputCol="damped").transform(counts.transform(docs))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    full, empty = [r.damped for r in out.orderBy("id").collect()]
    assert list(full.indices) == [0, 2] and list(full.values) == [1 + math.log(2), 1.0]
    assert empty.size == 3 and len(empty.indices) == 0
