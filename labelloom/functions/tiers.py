"""Threshold rules: buckets, bands, gates, routing and verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed thresholds and names.
QUALITY_GATE = 0.40
HIGH_FROM = 0.70
MEDIUM_FROM = 0.40
REVIEW_BELOW = 0.40
CLEAR_UPLIFT = 0.02


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    return (
        F.when(n < 200, "< 200").when(n < 1000, "200-1000").when(n < 3000, "1000-3000")
        .otherwise("> 3000")
    )


def match_status(matched: Column, routing: Column) -> Column:
    """``no_match`` for an unmatched row, else its routing (which may be null)."""
    return F.when(matched.isNull(), "no_match").otherwise(routing)


def confidence_band(probability: Column) -> Column:
    return (
        F.when(probability.isNull(), F.lit(None).cast("string"))
        .when(probability >= HIGH_FROM, "HIGH").when(probability >= MEDIUM_FROM, "MEDIUM")
        .otherwise("LOW")
    )


def below_quality_gate(score: Column) -> Column:
    return F.coalesce(score, F.lit(0.0)) < QUALITY_GATE


def needs_review(reply_confidence: Column, probability: Column) -> Column:
    return (F.coalesce(reply_confidence, F.lit("")) == "low") | (probability < REVIEW_BELOW)


def review_reason(reply_confidence: Column, probability: Column) -> Column:
    """Why a document goes to review; a low reply confidence is named first."""
    return (
        F.when(F.coalesce(reply_confidence, F.lit("")) == "low", "LLM confidence low")
        .when(probability < REVIEW_BELOW, "Prediction probability low")
    )


def uplift_verdict(delta: Column) -> Column:
    return (
        F.when(delta > CLEAR_UPLIFT, "improves").when(delta > 0, "marginal")
        .otherwise("no improvement")
    )
