"""Scoring a table of documents from extraction to review routing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.replies import prompt_parts
from labelloom.functions.text import leading_terms, scoring_text
from labelloom.functions.tiers import (
    below_quality_gate, confidence_band, needs_review, review_reason)
from labelloom.model.classifier import Classifier
from labelloom.operators.ranking import by_probability
from labelloom.session import stage


def prompts(best: DataFrame, instruction: str) -> DataFrame:
    """``doc_id, part, parts, prompt`` for the documents that pass the quality gate."""
    passing = best.where(~below_quality_gate(F.col("quality_score")))
    return passing.select("doc_id", F.inline(prompt_parts(F.col("text"), instruction)))


def gated(best: DataFrame, replies: DataFrame) -> DataFrame:
    """Best extractions with their parsed reply and the state each is in.

    ``state`` is ``low_quality``, ``no_reply``, ``failed_reply`` or ``ready``.
    """
    joined = best.join(replies.drop("status_code"), "doc_id", "left")
    state = (
        F.when(below_quality_gate(F.col("quality_score")), "low_quality")
        .when(F.col("parse_status").isNull(), "no_reply")
        .when(F.col("parse_status") != "ok", "failed_reply")
        .otherwise("ready")
    )
    return joined.select(
        "doc_id", "method", "pages", F.length("text").alias("chars"), "quality_score",
        state.alias("state"), "error", "summary", "key_terms", "llm_confidence",
        "llm_confidence_reason",
    )


def routed(scored: DataFrame) -> DataFrame:
    """Ranking, band and review routing of scored rows.

    Rows that were not ready hold no prediction and go to review.
    """
    ready = F.col("state") == "ready"
    ranked = scored.withColumn("ranking", F.when(ready, by_probability(F.col("probs"))))
    topped = ranked.withColumn("top_probability", F.get("ranking", 0)["p"])
    top, confidence = F.col("top_probability"), F.col("llm_confidence")
    not_ready = {
        "low_quality": "Text quality too low",
        "no_reply": "Reply missing",
        "failed_reply": "Reply failed",
    }
    waiting = F.create_map(*[F.lit(x) for pair in not_ready.items() for x in pair])
    return topped.select(
        *[c for c in scored.columns if c not in ("probs", "pred")],
        F.when(ready, F.col("pred")).alias("prediction"),
        "top_probability",
        confidence_band(top).alias("band"),
        F.when(ready, needs_review(confidence, top)).otherwise(True).alias("review"),
        F.when(ready, review_reason(confidence, top))
        .otherwise(F.try_element_at(waiting, F.col("state"))).alias("review_reason"),
        "ranking",
        F.when(ready, leading_terms(F.col("key_terms"), 10)).alias("first_terms"),
        F.when(ready, leading_terms(F.col("key_terms"), 15, "none extracted")).alias("shown_terms"),
    )


def score_documents(best: DataFrame, replies: DataFrame, model: Classifier,
                    document_info: DataFrame | None = None) -> DataFrame:
    """One result row per document.

    ``best`` comes from ``best_candidates`` and ``replies`` from
    ``parsed_replies``. With ``document_info`` (``doc_id, doc_subtype,
    classification``) the model text has the same parts as in training.
    """
    rows = gated(best, replies)
    if document_info is None:
        text = scoring_text(F.col("summary"), F.col("key_terms"))
        extra = []
    else:
        rows = rows.join(document_info.select("doc_id", "doc_subtype", "classification"),
                         "doc_id", "left")
        text = scoring_text(F.col("summary"), F.col("key_terms"), F.col("doc_subtype"),
                            F.col("classification"))
        extra = ["doc_subtype", "classification"]
    # Rows that are not ready get no prediction, so their texts are not tokenised.
    ready_text = F.when(F.col("state") == "ready", text)
    scored = model.predict(rows.withColumn("scoring_text", ready_text), "scoring_text")
    return routed(scored.drop("scoring_text", *extra))


_RESULTS = "digest string, model string, pred string, probs array<struct<class:string,p:double>>"


def known_results(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """``digest, pred, probs`` that ``folder`` holds of a model version."""
    try:
        stored = spark.read.schema(_RESULTS).parquet(folder)
    except AnalysisException:
        stored = spark.createDataFrame([], _RESULTS)
    return stored.where(F.col("model") == version).drop("model").dropDuplicates(["digest"])


def score_unknown(rows: DataFrame, ids: list[str], text_column: str, model: Classifier, version: str,
                  folder: str) -> tuple[DataFrame, int]:
    """``ids, pred, probs`` of every row, and how many texts the model had to see.

    Results are stored by the digest of the text and the model's version. Digests are
    compared first, on rows without texts; only texts whose digest is not known yet are
    read again and scored, one of several equal ones, and their results appended. So a
    second run scores nothing, another version scores all, and a run that fails before it
    has appended repeats its work. Null and empty texts are one text.
    """
    spark = rows.sparkSession
    text = F.coalesce(text_column, F.lit(""))
    digests = stage(rows.select(*ids, F.sha2(text, 256).alias("digest")), "digests")
    known = known_results(spark, folder, version)
    missing = digests.join(known.select("digest"), "digest", "left_anti").select("digest").distinct()
    missing = stage(missing, "unknown-digests")
    n = missing.count()
    if n:
        texts = rows.select(F.sha2(text, 256).alias("digest"), text.alias("text")).join(
            missing, "digest", "left_semi").dropDuplicates(["digest"])
        model.predict(texts, "text").select(
            "digest", F.lit(version).alias("model"), "pred", "probs").write.mode("append").parquet(folder)
    results = known_results(spark, folder, version)
    return digests.join(results, "digest", "left").select(*ids, "pred", "probs"), n
