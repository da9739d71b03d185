"""Reports on the training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.tiers import length_bucket


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value and their percentage. The window runs over one row per value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") * F.lit(100).cast("decimal(4,1)") / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(share, 1)).orderBy(F.desc("n"), column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def length_buckets(df: DataFrame, text: str = "feature_text") -> DataFrame:
    return value_counts(df.select(length_bucket(F.col(text)).alias("bucket")), "bucket")


def leakage_preview(training: DataFrame, rows: int = 20) -> DataFrame:
    """The first rows by label, with short previews of their texts."""
    ordered = training.orderBy("label", "source_id", "filename").limit(rows)
    return ordered.select(
        "label", "classification", "doc_subtype", "final_confidence",
        F.left(F.col("summary"), F.lit(300)).alias("summary_preview"),
        "key_terms",
        F.left(F.col("feature_text"), F.lit(400)).alias("feature_preview"),
    )


def leakage_flags(training: DataFrame) -> DataFrame:
    """Per label, how many feature texts contain the label itself."""
    found = F.contains(F.lower("feature_text"), F.lower("label")).cast("long")
    return training.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                         F.sum(found).alias("with_label_in_text"))


def repeated_documents(training: DataFrame) -> DataFrame:
    """Documents with more than one training row, most rows first.

    Rows repeat for several labels or for several summaries of one stem, so the
    number of distinct labels is given as well.
    """
    groups = training.groupBy("source_id", "title").agg(
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.count(F.lit(1)).alias("row_count"),
    )
    return (
        groups.where(F.col("row_count") > 1)
        .withColumn("label_count", F.size("labels"))
        .orderBy(F.desc("row_count"), "source_id", "title")
    )
