"""The labelled training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import baseline_text, feature_text, has_text, name_stem
from labelloom.functions.tiers import match_status
from labelloom.operators.stem_join import PAIRS_PER_TASK, sliced_join, status_counts
from labelloom.plans.metadata import one_row_per_label

SUMMARY_COLUMNS = ["filename", "text_length", "quality_score", "llm_confidence",
                   "final_confidence", "routing", "summary", "key_terms"]


def finished_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.where(
        (F.col("routing") == "ml_training") & (F.col("llm_status") == "success"))


def usable_summaries(summaries: DataFrame) -> DataFrame:
    return finished_summaries(summaries).where(has_text(F.col("summary")))


def training_rows(meta: DataFrame, summaries: DataFrame,
                  pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """One row per (document, label, matching summary) with its model texts."""
    return with_model_texts(joined_rows(meta, summaries, pairs_per_task))


def with_model_texts(rows: DataFrame) -> DataFrame:
    """``joined_rows`` with the model texts.

    Feature text holds neither the label nor title and regulations, which give
    it away. The texts repeat columns of the row, so a stored table does without them.
    """
    return rows.select(
        "*",
        feature_text(F.col("doc_subtype"), F.col("classification"), F.col("summary"),
                     F.col("key_terms")).alias("feature_text"),
        baseline_text(F.col("title"), F.col("object_name")).alias("baseline_text"),
    )


def joined_rows(meta: DataFrame, summaries: DataFrame,
                pairs_per_task: int = PAIRS_PER_TASK) -> DataFrame:
    """One row per (document, label, matching summary).

    Both sides are narrowed before the join on the file-name stem.
    Pass a stored ``meta``: the join looks at its keys once before reading it.
    """
    labelled = one_row_per_label(meta).drop("attachment_path").withColumn(
        "stem", name_stem(F.col("object_name")))
    stem = name_stem(F.col("filename")).alias("stem")
    texts = usable_summaries(summaries).select(*SUMMARY_COLUMNS, stem)
    # Counting keys without the test for text leaves the texts unread.
    keys = finished_summaries(summaries).select(stem)
    return sliced_join(labelled, texts, "stem", pairs_per_task, keys).select(
        "source_id", "title", "object_name", "label", "classification", "doc_subtype",
        "regulation_names", *SUMMARY_COLUMNS)


def join_coverage(meta: DataFrame, summaries: DataFrame) -> DataFrame:
    """How many labelled rows find a summary, by the summary's routing."""
    labelled = one_row_per_label(meta).select(name_stem(F.col("object_name")).alias("stem"))
    texts = summaries.select("filename", "routing", name_stem(F.col("filename")).alias("stem"))
    status = match_status(F.col("filename"), F.col("routing"))
    return status_counts(labelled, texts, "stem", status).orderBy(F.desc("n"), "status")
