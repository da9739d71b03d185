"""Fits proved by their gradient, and folds against fits of their own."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom.model.certificate import STATIONARY, certificate
from labelloom.model.classifier import Settings, fit_classifier
from labelloom.plans import experiments

TIGHT = Settings(tolerance=1e-11)


@pytest.fixture(scope="module")
def rows(spark):
    dice = random.Random(8)
    words = {"law": "court judge contract clause", "tax": "income levy rate refund", "lab": "sample assay reagent dose"}
    data = []
    for i in range(120):
        label = dice.choice(sorted(words))
        text = " ".join(dice.choice((words[label] + " common filler other word").split()) for _ in range(dice.randrange(12)))
        data.append((f"d{i}", f"f{i}", label, text or None, i % 3))
    return spark.createDataFrame(
        data, "source_id string, filename string, label string, feature_text string, fold int").persist()


@pytest.mark.parametrize("labels", [("law", "tax", "lab"), ("law", "tax")])
def test_a_converged_fit_is_optimal_and_no_other(rows, labels):
    some = rows.where(F.col("label").isin(*labels))
    model = fit_classifier(some, "feature_text", settings=TIGHT)
    good = certificate(some, "feature_text", "label", model).first()
    assert good.optimal and good.largest_slope <= STATIONARY and good.rows == some.count()
    assert good.classes == len(labels) and good.terms == len(model.pipeline.stages[1].vocabulary)
    for penalty in (10 / good.rows, 0.1 / good.rows):
        assert not certificate(some, "feature_text", "label", model, penalty=penalty).first().optimal
    early = fit_classifier(some, "feature_text", settings=Settings(max_iterations=2))
    assert not certificate(some, "feature_text", "label", early).first().optimal
    fewer = fit_classifier(some.where("source_id < 'd5'"), "feature_text", settings=TIGHT)
    assert not certificate(some, "feature_text", "label", fewer).first().optimal


def test_the_objective_is_least_at_the_fit(rows):
    best = fit_classifier(rows, "feature_text", settings=TIGHT)
    early = fit_classifier(rows, "feature_text", settings=Settings(max_iterations=3))
    low, high = (certificate(rows, "feature_text", "label", m).first().objective for m in (best, early))
    assert low < high


def test_folds_equal_fits_of_their_own(rows):
    got = {(r.source_id, r.filename): r for r in experiments.fold_predictions(rows, folds=3, settings=TIGHT).collect()}
    assert len(got) == rows.count()
    for fold in range(3):
        model = fit_classifier(rows.where(F.col("fold") != fold), "feature_text", settings=TIGHT)
        for r in model.predict(rows.where(F.col("fold") == fold), "feature_text").collect():
            other = got[r.source_id, r.filename]
            assert other.pred == r.pred and other.true == r.label and other.fold == fold
            assert [c["class"] for c in other.probs] == [c["class"] for c in r.probs]
            assert [c.p for c in other.probs] == pytest.approx([c.p for c in r.probs], abs=1e-4)


def test_texts_are_tokenised_once_for_all_folds(rows):
    vectors = experiments.fit_folds(rows, "feature_text", 3, settings=TIGHT)[0]
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "feature_text" not in plan
