"""Joins on the file-name stem, which may repeat on both sides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.heavy_hitters import CAPACITY, key_summary
from labelloom.session import stage

PAIRS_PER_TASK = 4_000_000


def key_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows per key on both sides: ``key, left_rows, right_rows``.

    Both counts are combined before the shuffle, so a key with a third of all
    rows arrives as one row per map task.
    """
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("right_rows"))
    return a.join(b, key, "full")


def _work(n: Column, m: Column) -> Column:
    """Rows or pairs of a key, whichever are more."""
    return F.greatest(n.cast("double") * m, n.cast("double"), m.cast("double"))


def candidate_counts(left: DataFrame, right: DataFrame, key: str, pairs_per_task: int,
                     capacity: int = CAPACITY) -> DataFrame:
    """``key, left_rows, right_rows`` of a superset of the keys with more work than ``pairs_per_task``.

    Summaries of both sides bound every key's rows from above. Only keys whose bounds
    exceed the limit are counted, and these alone are shuffled. A key without a count in
    either summary occurs at most ``taken`` times a side; where even such keys could
    exceed the limit, the summaries are too small for the tables and all keys are counted.
    """
    (a, off_a, _), (b, off_b, _) = (key_summary(side, key, capacity) for side in (left, right))
    if max(off_a * off_b, off_a, off_b) > pairs_per_task:
        return key_counts(left, right, key)
    known = a.withColumnRenamed("n", "left_rows").join(b.withColumnRenamed("n", "right_rows"), key, "full")
    if off_a == off_b == 0:
        return known
    n, m = F.coalesce("left_rows", F.lit(0)) + off_a, F.coalesce("right_rows", F.lit(0)) + off_b
    wanted = stage(known.where(_work(n, m) > pairs_per_task).select(key), "candidate-keys")
    return key_counts(left.select(key).join(wanted, key, "left_semi"), right.select(key).join(wanted, key, "left_semi"), key)


def hot_keys(left: DataFrame, right: DataFrame, key: str, pairs_per_task: int,
             capacity: int = CAPACITY) -> DataFrame:
    """Keys with too many rows or pairs for one task, and the slices of each side.

    Two slices that meet form at most ``pairs_per_task`` pairs. A side that is small
    itself stays whole; else both are cut to the square root of the limit.
    """
    n, m = F.coalesce("left_rows", F.lit(0)), F.coalesce("right_rows", F.lit(0))
    square = math.isqrt(pairs_per_task)

    def slices(own: Column, other: Column) -> Column:
        size = F.greatest(F.lit(square), pairs_per_task / F.greatest(other, F.lit(1)))
        return F.greatest(F.lit(1), F.ceil(own / size)).cast("int")

    counts = candidate_counts(left, right, key, pairs_per_task, capacity)
    return counts.where(F.col(key).isNotNull() & (_work(n, m) > pairs_per_task)).select(
        key, slices(n, m).alias("left_slices"), slices(m, n).alias("right_slices"))


def sliced_join(left: DataFrame, right: DataFrame, key: str, pairs_per_task: int = PAIRS_PER_TASK,
                right_keys: DataFrame | None = None) -> DataFrame:
    """Inner equi-join on ``key`` with hot keys cut into slices on both sides.

    A row of a hot key takes one slice of its own side and is repeated once per
    slice of the other side, so every pair meets in exactly one task. Rows of hot
    keys are numbered and stored first: the number differs for equal rows, and a
    retried task reads it back instead of making a new one. Other keys join plainly.

    Jobs run here while the plan is built: one that counts keys and reads only
    them, and, with a hot key, those that store its rows. ``right_keys`` may give
    the keys of a superset of ``right`` that is cheaper to read.
    """
    hot = stage(hot_keys(left, right if right_keys is None else right_keys, key, pairs_per_task),
                "hot-keys")
    if hot.isEmpty():
        return left.join(right, key, "inner")
    plain = left.join(hot.select(key), key, "left_anti").join(right, key, "inner")
    a, b = _sliced(left, hot, key, "left", "right"), _sliced(right, hot, key, "right", "left")
    return plain.unionByName(
        a.join(b, [key, "_left_slice", "_right_slice"], "inner").drop("_left_slice", "_right_slice"))


def _sliced(df: DataFrame, hot: DataFrame, key: str, own: str, other: str) -> DataFrame:
    rows = stage(df.join(hot, key).withColumn("_row", F.monotonically_increasing_id()), f"hot-{own}")
    return rows.withColumns({
        f"_{own}_slice": F.pmod(F.xxhash64("_row"), F.col(f"{own}_slices")).cast("int"),
        f"_{other}_slice": F.explode(F.sequence(F.lit(0), F.col(f"{other}_slices") - 1)),
    }).drop("_row", "left_slices", "right_slices")


def status_counts(left: DataFrame, right: DataFrame, key: str, status: Column,
                  unmatched: str = "no_match") -> DataFrame:
    """``status, n`` of the left join, without forming its pairs.

    Rows are counted per key on the left and per key and status on the right;
    the counts multiply. Left rows without a partner count as ``unmatched``.
    """
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("left_rows"))
    b = (
        right.where(F.col(key).isNotNull())
        .groupBy(key, status.alias("status")).agg(F.count(F.lit(1)).alias("right_rows"))
    )
    joined = a.join(b, key, "left")
    found = F.col("right_rows").isNotNull()
    return (
        joined.groupBy(F.when(found, F.col("status")).otherwise(unmatched).alias("status"))
        .agg(F.sum(F.col("left_rows") * F.coalesce("right_rows", F.lit(1))).alias("n"))
    )


def fan_out(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row that says what an inner join on ``key`` does to the row count."""
    n, m = F.coalesce("left_rows", F.lit(0)), F.coalesce("right_rows", F.lit(0))
    counts = key_counts(left, right, key)
    known = F.col(key).isNotNull()
    pairs = F.when(known, n * m).otherwise(0)
    return counts.agg(
        F.sum(n).alias("left_rows"),
        F.sum(m).alias("right_rows"),
        F.sum((known & (n > 0)).cast("long")).alias("left_keys"),
        F.sum((known & (m > 0)).cast("long")).alias("right_keys"),
        F.sum((known & (n > 1)).cast("long")).alias("left_repeated_keys"),
        F.sum((known & (m > 1)).cast("long")).alias("right_repeated_keys"),
        F.sum((pairs > 0).cast("long")).alias("matched_keys"),
        F.sum(pairs).alias("joined_rows"),
        F.max(pairs).alias("largest_key_rows"),
    )
