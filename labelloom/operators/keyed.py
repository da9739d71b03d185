"""Per-key reductions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.session import stage


def smallest_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key with its smallest non-null value (partial min first)."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value))


def frequent_classes(df: DataFrame, label: str, at_least: int = 5) -> DataFrame:
    """Labels with enough rows: ``label, n``."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def keep_frequent(df: DataFrame, label: str, at_least: int = 5) -> DataFrame:
    """Rows of frequent classes. The classes are counted and stored while the plan is built."""
    frequent = stage(frequent_classes(df, label, at_least).select(label), "frequent")
    return df.join(frequent, label, "left_semi")


def dropped_classes(df: DataFrame, label: str, at_least: int = 5) -> DataFrame:
    """Labels with too few rows. Counting per label makes them distinct already."""
    return (
        df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < at_least)
    )


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``label, n, weight`` with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # One row per class, so the window without keys stays small.
    everything = Window.partitionBy()
    rows, classes = F.sum("n").over(everything), F.count(F.lit(1)).over(everything)
    return counts.select(label, "n", (rows / (classes * F.col("n"))).alias("weight"))
