"""Choosing the best extraction of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.cleaning import clean_text
from labelloom.functions.quality import quality_columns, quality_reason, quality_score
from labelloom.session import stage


def with_quality(df: DataFrame, text: str) -> DataFrame:
    """Add the quality measures, ``quality_score`` and ``quality_reason`` of a text column."""
    measured = df.withColumns(quality_columns(F.col(text)))
    return measured.withColumns({
        "quality_score": quality_score(F.col("letter_ratio"), F.col("word_ratio"),
                                       F.col("special_ratio"), F.col("garbled_runs")),
        "quality_reason": quality_reason(F.col("letter_ratio")),
    })


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Clean and score ``doc_id, method, priority, text, pages`` rows."""
    cleaned = candidates.select("doc_id", "method", "priority", "pages",
                                clean_text(F.col("text")).alias("text"))
    return with_quality(cleaned, "text").select(
        "doc_id", "method", "priority", "pages", "text", "quality_score")


def _place(score: Column, priority: Column, row: Column) -> Column:
    """One number that is greater for the better candidate; its last 63 bits tell the row.

    Score in thousandths, then the smaller priority number, then the earlier row. A number
    fits an aggregation buffer that is updated in place, other than a struct or a text.
    """
    wide = "decimal(38,0)"
    best = F.round(score * 1000).cast("long") * F.lit(1 << 32) + (
        F.lit((1 << 31) - 1) - F.coalesce(priority, F.lit((1 << 31) - 1)).cast("long"))
    return best.cast(wide) * F.lit(1 << 62).cast(wide) + (F.lit((1 << 62) - 1) - row).cast(wide)


def best_candidates(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per document with its best extraction.

    The highest score wins, ties go to the smaller priority number, then to the row
    stored first, and a score of 0 never wins. A document without a winner keeps empty
    text, score 0 and null method and pages.

    Candidates are cleaned and scored once and stored. The choice reads scores and row
    numbers only, as one number per document; texts are read again for the winners alone.
    Jobs run here while the plan is built.
    """
    scored = stage(scored_candidates(candidates).withColumn("row", F.monotonically_increasing_id()),
                   "candidates")
    place = _place(F.col("quality_score"), F.col("priority"), F.col("row"))
    winners = scored.where(F.col("quality_score") > 0).groupBy("doc_id").agg(F.max(place).alias("place")).select(
        (F.lit((1 << 62) - 1) - F.pmod("place", F.lit(1 << 62).cast("decimal(38,0)")).cast("long")).alias("row"))
    best = scored.join(winners, "row", "left_semi").drop("row")
    joined = documents.select("doc_id").join(best, "doc_id", "left")
    return joined.select(
        "doc_id", "method", "pages",
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
    )
