import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators.heavy_hitters import key_summary
from labelloom.operators.keyed import balanced_weights, dropped_classes, keep_frequent
from labelloom.operators.keyed import smallest_per_key
from labelloom.operators.set_join import names_of_ids
from labelloom.operators.stem_join import (
    _sliced, candidate_counts, fan_out, hot_keys, sliced_join, status_counts)
from labelloom.plans.metadata import metadata, one_row_per_label
from labelloom.plans.training import training_rows

SUMMARY_SCHEMA = ("filename string, text_length int, quality_score double, llm_confidence string, "
                  "final_confidence double, routing string, summary string, "
                  "key_terms array<string>, llm_status string")


def test_smallest_per_key_skips_nulls(spark):
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("a", None), ("n", None)],
                               "source_id string, v string")
    assert [tuple(r) for r in smallest_per_key(df, "source_id", "v").collect()] == [("a", "b")]


def test_names_of_ids_edge_cases(spark):
    docs = spark.createDataFrame([
        ("1", ["a", "b", "a"], ["r"]), ("2", None, []), ("3", [], None), ("4", ["zz", None], ["r"]),
        (None, ["a"], None), (None, ["b"], None), ("1", ["c"], None),
    ], "source_id string, area_ids array<string>, regulation_ids array<string>")
    areas = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("a", "A2"), ("d", None)],
                                  "id string, name string")
    regulations = spark.createDataFrame([("r", "R"), ("a", "not an area")], "id string, name string")
    sets = {"areas": ("area_ids", areas), "regulations": ("regulation_ids", regulations)}
    got = {r.source_id: (sorted(r.areas), sorted(r.regulations))
           for r in names_of_ids(docs, ["source_id"], sets).collect()}
    assert got == {"1": (["A", "A2", "B", "C"], ["R"]), "2": ([], []), "3": ([], []),
                   "4": ([], ["R"]), None: (["A", "A2", "B"], [])}


def test_names_of_ids_matches_membership_join(spark):
    """Against the nested-loop form on ids drawn from lineitem."""
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    docs = lines.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.collect_set(F.col("l_suppkey").cast("string")).alias("ids"))
    dim = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").select(
        F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"))
    fast = names_of_ids(docs, ["k"], {"n": ("ids", dim)}).select("k", F.sort_array("n").alias("n"))
    slow = docs.join(dim, F.array_contains("ids", F.col("id")), "left").groupBy("k").agg(
        F.sort_array(F.collect_set("name")).alias("n"))
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0
    plan = names_of_ids(docs, ["k"], {"n": ("ids", dim)})._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


def test_metadata_filters_merges_and_explodes(spark):
    docs = spark.createDataFrame([
        ("1", "t", "c", None, ["a"], None), ("1", "t", "c", None, ["b"], ["r"]),
        ("2", None, "c", "s", ["a"], None), ("3", "t", None, "s", ["a"], None),
        ("4", "t", "c", "s", [], None),
    ], "source_id string, title string, classification string, doc_subtype string, "
       "area_ids array<string>, regulation_ids array<string>")
    paths = spark.createDataFrame([("1", "y"), ("1", "x"), ("4", None)],
                                  "source_id string, attachment_path string")
    names = spark.createDataFrame([("1", "Doc.PDF")], "source_id string, object_name string")
    dim = spark.createDataFrame([("a", "A"), ("b", "B"), ("r", "R")], "id string, name string")
    meta = metadata(docs, paths, names, dim, dim)
    rows = {r.source_id: r for r in meta.collect()}
    assert set(rows) == {"1", "4"}
    assert sorted(rows["1"].area_names) == ["A", "B"] and rows["1"].regulation_names == ["R"]
    assert rows["1"].attachment_path == "x" and rows["4"].attachment_path is None
    assert sorted(r.label for r in one_row_per_label(meta).collect()) == ["A", "B"]


def _sides(spark):
    """Hot keys on either side, on both, keys of one side and null keys."""
    left = [("hot", i) for i in range(40)] + [("both", i) for i in range(15)] + [
        ("rare", 1), ("alone", 2), (None, 3), ("right", 4)]
    right = [("hot", i) for i in range(2)] + [("both", i) for i in range(20)] + [
        ("rare", 9), ("other", 8), (None, 7)] + [("right", i) for i in range(50)]
    return (spark.createDataFrame(left, "k string, a int"),
            spark.createDataFrame(right, "k string, b int"))


def test_sliced_join_keeps_every_pair(spark):
    left, right = _sides(spark)
    want = Counter(tuple(r) for r in left.join(right, "k").collect())
    for limit in (1, 7, 1000):
        got = sliced_join(left, right, "k", limit).select("k", "a", "b")
        assert Counter(tuple(r) for r in got.collect()) == want
    slices = {r.k: (r.left_slices, r.right_slices) for r in hot_keys(left, right, "k", 49).collect()}
    assert slices == {"hot": (2, 1), "both": (3, 3), "right": (1, 2)}


def test_sliced_join_of_equal_rows(spark):
    """Equal rows of a hot key are dealt over its slices, and no pair is lost."""
    left = spark.range(300).select(F.lit("hot").alias("k"), F.lit(1).alias("a"))
    right = spark.range(20).select(F.lit("hot").alias("k"), F.lit(2).alias("b"))
    assert sliced_join(left, right, "k", 400).count() == 6_000
    rows = _sliced(left, hot_keys(left, right, "k", 400), "k", "left", "right")
    assert rows.select("_left_slice").distinct().count() == 15


def test_sliced_join_spreads_a_hot_key(spark):
    """A third of all rows on one key end up in several slices."""
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1)], "k string, b int")
    slices = hot_keys(left, right, "k", 1_000).collect()
    assert [(r.k, r.left_slices) for r in slices] == [("hot", 10)]
    assert sliced_join(left, right, "k", 1_000).count() == 10_000


def _plain_hot(left, right, limit):
    a, b = Counter(r.k for r in left.collect()), Counter(r.k for r in right.collect())
    return {k for k in {*a, *b} - {None} if max(a[k] * b[k], a[k], b[k]) > limit}


@pytest.mark.parametrize("capacity", [1, 20, 1 << 17])
@pytest.mark.parametrize("limit", [30, 3_000])
def test_summaries_find_the_same_hot_keys(spark, capacity, limit):
    dice = random.Random(capacity)
    keys = ["a"] * 300 + ["b"] * 120 + ["c"] * 60 + [None] * 50 + [f"k{dice.randrange(300)}" for _ in range(400)]
    dice.shuffle(keys)
    left = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    right = spark.createDataFrame([(k,) for k in keys[:350]], "k string").repartition(3)
    assert {r.k for r in hot_keys(left, right, "k", limit, capacity).collect()} == _plain_hot(left, right, limit)


@pytest.mark.parametrize("capacity", [1, 4, 50])
def test_summary_bounds(spark, capacity):
    keys = ["x"] * 500 + ["y"] * 100 + [f"z{i}" for i in range(200)] + [None] * 9
    random.Random(1).shuffle(keys)
    kept, taken, rows = key_summary(spark.createDataFrame([(k,) for k in keys], "k string").repartition(4), "k", capacity)
    counts, true = {r.k: r.n for r in kept.collect()}, Counter(keys)
    assert rows == 800 and taken <= rows / capacity and len(counts) <= 4 * capacity
    assert all(true[k] - taken <= counts.get(k, 0) <= true[k] for k in true if k is not None)


def test_only_candidates_are_counted(spark):
    left = spark.range(5_000).select(F.when(F.col("id") % 4 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot",)] * 3, "k string")
    counted = candidate_counts(left.repartition(2), right, "k", 1_000, capacity=100)
    assert [tuple(r) for r in counted.collect()] == [("hot", 1250, 3)]


def test_status_counts_match_the_joined_rows(spark):
    left, right = _sides(spark)
    right = right.withColumn("s", F.when(F.col("b") % 3 == 0, "x").when(F.col("b") % 3 == 1, "y"))
    joined = left.join(right.withColumn("found", F.lit(1)), "k", "left")
    want = Counter("no_match" if r.found is None else r.s for r in joined.collect())
    got = {r.status: r.n for r in status_counts(left, right, "k", F.col("s")).collect()}
    assert got == dict(want) and None in got


def test_fan_out(spark):
    left, right = _sides(spark)
    row = fan_out(left, right, "k").first()
    assert (row.left_rows, row.right_rows) == (left.count(), right.count())
    assert row.joined_rows == left.join(right, "k").count()
    assert (row.left_keys, row.right_keys, row.matched_keys) == (5, 5, 4)
    assert (row.left_repeated_keys, row.right_repeated_keys) == (2, 3)
    assert row.largest_key_rows == 300


def test_training_rows_texts_and_filters(spark):
    meta = spark.createDataFrame([
        ("1", "T", None, None, "A.b.PDF", "p", ["L1", "L2"], ["R"]),
        ("2", "T", "c", "s", ".pdf", "p", ["L1"], []),
        ("3", "T", "c", "s", None, "p", ["L1"], []),
    ], "source_id string, title string, classification string, doc_subtype string, "
       "object_name string, attachment_path string, area_names array<string>, "
       "regulation_names array<string>")
    base = (10, 0.5, "high", 0.9)
    summaries = spark.createDataFrame([
        ("a.B.txt", *base, "ml_training", "words", ["k", None, "m"], "success"),
        ("A.B.doc", *base, "ml_training", "again", None, "success"),
        ("a.b.x", *base, "human_review", "no", None, "success"),
        ("a.b.y", *base, "ml_training", "   ", None, "success"),
        ("a.b.z", *base, "ml_training", "no", None, "failed"),
        (".md", *base, "ml_training", "empty stem", [], "success"),
        (None, *base, "ml_training", "no", [], "success"),
    ], SUMMARY_SCHEMA)
    rows = training_rows(meta, summaries).collect()
    assert Counter((r.source_id, r.label, r.filename) for r in rows) == Counter([
        ("1", "L1", "a.B.txt"), ("1", "L2", "a.B.txt"), ("1", "L1", "A.B.doc"),
        ("1", "L2", "A.B.doc"), ("2", "L1", ".md")])
    texts = {(r.filename): (r.feature_text, r.baseline_text) for r in rows}
    assert texts["a.B.txt"] == ("  words k m", "T A.b.PDF")
    assert texts["A.B.doc"][0] == "  again "
    assert texts[".md"][0] == "s c empty stem "


def test_rare_classes_and_weights(spark):
    df = spark.createDataFrame([("five",)] * 5 + [("four",)] * 4 + [(None,)], "label string")
    assert {r.label for r in keep_frequent(df, "label").collect()} == {"five"}
    assert [tuple(r) for r in dropped_classes(df, "label").collect()] == [("four", 4)]
    named = df.where("label is not null")
    weights = {r.label: r.weight for r in balanced_weights(named, "label").collect()}
    assert weights == {"five": 9 / 10, "four": 9 / 8}
