"""Intervals, paired tests, leakage by association, mentions and incremental scores."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from labelloom.model.classifier import fit_classifier
from labelloom.operators import association, bootstrap, strata
from labelloom.operators.evaluation import prediction_metrics
from labelloom.plans.scoring import score_unknown


def sign_test(b, c):
    n = b + c
    return min(1.0, float(2 * sum(Fraction(math.comb(n, k), 2 ** n) for k in range(min(b, c) + 1)))) if n else 1.0


@pytest.fixture(scope="module")
def predictions(spark):
    dice = random.Random(6)
    rows = []
    for i in range(500):
        true = dice.choice("abc")
        for experiment, luck in (("one", 0.6), ("two", 0.7)):
            rows.append((experiment, i, true, true if dice.random() < luck else dice.choice("abc")))
    return spark.createDataFrame(rows, "experiment string, id long, true string, pred string").persist()


def test_sign_test_is_exact(spark):
    cases = [(0, 0), (0, 1), (3, 3), (5, 12), (12, 5), (0, 40), (100, 140), (700, 650), (1, 900)]
    df = spark.createDataFrame(cases, "b long, c long").select(
        "b", "c", bootstrap.exact_sign_test(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(sign_test(r.b, r.c), rel=1e-9)


def test_sign_test_of_large_counts_stays_near_the_normal_form(spark):
    b, c = 500_000_000, 500_050_000
    p = spark.range(1).select(bootstrap.exact_sign_test(F.lit(b), F.lit(c)).alias("p")).first().p
    assert p == pytest.approx(math.erfc((c - b - 1) / math.sqrt(2 * (b + c))), rel=1e-3)


def test_paired_test(predictions):
    row = bootstrap.paired_test(predictions, "one", "two", ["id"]).first()
    right = {(r.experiment, r.id): r.true == r.pred for r in predictions.collect()}
    b = sum(right["one", i] and not right["two", i] for i in range(500))
    c = sum(right["two", i] and not right["one", i] for i in range(500))
    assert (row.pairs, row.only_baseline, row.only_candidate) == (500, b, c)
    assert row.p_value == pytest.approx(sign_test(b, c))


def test_bootstrap_replicates_by_plain_loops(predictions):
    steps = bootstrap.STEPS

    def fraction(*parts):
        return int(hashlib.md5("#".join(parts).encode()).hexdigest()[:13], 16) / 2 ** 52

    got = {(r.experiment, r.replicate): r for r in bootstrap.bootstrap_metrics(
        predictions, ["experiment"], ["id"], replicates=6, blocks=40).collect()}
    for experiment in ("one", "two"):
        mine = [r for r in predictions.collect() if r.experiment == experiment]
        for replicate in range(1, 7):
            hits = rows = 0
            for r in mine:
                block = int(hashlib.md5(f"42#{r.id}".encode()).hexdigest()[:8], 16) % 40
                times = sum(s <= fraction("draw", str(replicate), str(block)) for s in steps)
                rows += times
                hits += times * (r.true == r.pred)
            assert got[experiment, replicate].rows == rows
            assert got[experiment, replicate].accuracy == pytest.approx(hits / rows)


def test_intervals_hold_the_score_and_are_as_wide_as_theory(predictions):
    whole = {r.experiment: r for r in prediction_metrics(predictions, ["experiment"]).collect()}
    for r in bootstrap.bootstrap_intervals(predictions, ["experiment"], ["id"]).collect():
        value = whole[r.experiment][r.metric]
        assert r.low < value < r.high
        if r.metric == "accuracy":
            assert (r.high - r.low) / (2 * 1.96 * math.sqrt(value * (1 - value) / 500)) == pytest.approx(1, abs=0.25)


def test_draws_have_a_mean_and_variance_of_one(spark):
    row = spark.range(20_000).select(bootstrap.draws(F.lit(1), F.col("id")).alias("k")).agg(
        F.avg("k").alias("m"), F.var_pop("k").alias("v")).first()
    assert row.m == pytest.approx(1, abs=0.03) and row.v == pytest.approx(1, abs=0.05)


def test_terms_move_for_no_join(spark):
    """Only the labels' sizes are joined; counts of equal rows, and of terms that two labels share, add up."""
    df = spark.createDataFrame([("a", "xx yy"), ("a", "xx yy"), ("b", "yy"), ("b", "zz"), (None, "xx"), ("b", None)],
                               "label string, text string")
    found = association.associated_terms(df, F.col("text"), "label", top=5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert {(r.label, r.term, r.n, r.with_term) for r in found.collect()} == {
        ("a", "xx", 2, 2), ("a", "xx yy", 2, 2), ("a", "yy", 2, 3)}


def test_associated_terms_by_hand(spark):
    rows = [("law court", "law")] * 8 + [("law day", "law")] * 2 + [("tax day", "tax")] * 9 + [("court tax", "tax"), (None, "tax"),
            ("court", None)]
    df = spark.createDataFrame(rows, "text string, label string")
    got = {(r.label, r.term): r for r in association.associated_terms(df, F.col("text"), "label", top=3).collect()}
    n, size, total = 8, 10, 21  # court: 8 of 10 in law, 9 in all
    expected = total * (n * total - 9 * size) ** 2 / (9 * 12 * size * 11)
    assert got["law", "court"].chi_square == pytest.approx(expected)
    assert got["law", "law"].rank == 1 and got["law", "law"].chi_square == pytest.approx(21)
    assert got["tax", "tax"].n == 10 and {r.rank for r in got.values()} == {1, 2, 3}


def test_mentions_equal_plain_search(spark):
    labels = ["", "law", "lawyer", "La", "ÄRA", "tax", None]
    texts = ["the LAWYER", "no", None, "ära of tax", "lala", "x" * 100_000 + "law"]
    rows = [(t, x) for t in texts for x in labels]
    got = {(r.label, r.mentioned): r.n for r in association.label_mentions(
        spark.createDataFrame(rows, "text string, label string"), F.col("text"), "label").collect()}
    want = Counter((x, y) for t, x in rows for y in labels if y and t and y.lower() in t.lower())
    assert got == dict(want)
    none = spark.createDataFrame([("a", None)], "text string, label string")
    assert association.label_mentions(none, F.col("text"), "label").count() == 0


def test_only_unknown_texts_are_scored(spark, tmp_path):
    train = spark.createDataFrame([(f"{w} text", x) for x, w in (("a", "alpha"), ("b", "beta"), ("c", "gamma"))
                                   for _ in range(4)], "text string, label string")
    model, folder = fit_classifier(train, "text"), str(tmp_path / "scores")
    rows = spark.createDataFrame([(1, "alpha text"), (2, "alpha text"), (3, None), (4, ""), (None, "beta text"),
                                  (1, "gamma text")], "id int, text string")
    first, seen = score_unknown(rows, ["id"], "text", model, "v1", folder)
    direct = model.predict(rows, "text").drop("text")
    assert seen == 4 and sorted(map(repr, first.collect())) == sorted(map(repr, direct.collect()))
    more = rows.unionByName(spark.createDataFrame([(9, "new beta")], "id int, text string"))
    again, seen = score_unknown(more, ["id"], "text", model, "v1", folder)
    assert seen == 1 and again.count() == 7 and again.where("pred IS NULL").count() == 0
    assert score_unknown(more, ["id"], "text", model, "v1", folder)[1] == 0
    assert score_unknown(more, ["id"], "text", model, "v2", folder)[1] == 5


LABELS = ["a", "b", "c", "d", "e", "rare"]


def test_document_holdout_keeps_every_label_level(spark):
    dice = random.Random(12)
    rows = []
    for i in range(3000):
        labels = [x for x, p in zip(LABELS, (0.5, 0.3, 0.2, 0.2, 0.1, 0.004)) if dice.random() < p]
        rows.append((i, labels * dice.randrange(1, 3)))
    rows += [(5000, None), (5001, []), (5002, ["a", None])]
    got = strata.with_document_holdout(spark.createDataFrame(rows, "id int, labels array<string>"), "labels", ["id"]).collect()
    assert len(got) == len(rows)
    for x in LABELS:
        with_label = [r for r in got if r.labels and x in r.labels]
        assert abs(sum(r.part == "test" for r in with_label) - len(with_label) / 5) <= 1
    assert abs(sum(r.part == "test" for r in got) - len(got) / 5) <= 10


def test_dealt_sets_pay_debts():
    sets = [("x", ["a", "b"], 3), ("y", ["b", "c"], 3), ("z", ["a", "c"], 3), ("w", ["a"], 7)]
    taken = dict(strata.dealt_sets(sets, 20))
    assert all(abs(sum(taken[n] for n, x, _ in sets if label in x)
                   - sum(k for _, x, k in sets if label in x) / 5) <= 1 for label in "abc")
