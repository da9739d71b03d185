"""What proves a fitted classifier optimal: the gradient of its objective, as a table.

The objective is the weighted mean of the rows' log-losses plus half the penalty times
the squared coefficients; intercepts are free. It is convex, so a fit is optimal where
its gradient is zero. Nothing of the fit is used but its coefficients: texts become
TF-IDF weights by joins (``operators.terms``), scores are sums over shared terms, and the
gradient is one row per term with one entry per class. A fit that stopped early, another
penalty, other class weights or vectors that differ from the relational ones all show as a
gradient that is not small.

``STATIONARY`` is the largest absolute entry up to which a fit counts as converged.

Rows with a null text count as empty ones and score by the intercepts alone. Scores per
row and the gradient per term are combined before they are exchanged. What is broadcast is
bounded by the model's limits: terms times classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.model.classifier import Classifier, Settings
from labelloom.operators import terms as T
from labelloom.operators.keyed import balanced_weights
from labelloom.session import stage

STATIONARY = 1e-4


@dataclass(frozen=True)
class LinearModel:
    """Coefficients as ``term, place, w`` (one entry per class), intercepts and labels.

    With two classes the first one's scores are 0 and not fitted.
    """

    coefficients: DataFrame
    intercepts: list[float]
    labels: list[str]
    fitted_classes: list[int]


def linear_model(spark: SparkSession, model: Classifier) -> LinearModel:
    """The numbers of a classifier's last stage, by term."""
    regression = model.pipeline.stages[-1]
    vocabulary = model.pipeline.stages[1].vocabulary
    matrix, intercepts = regression.coefficientMatrix.toArray(), regression.interceptVector.toArray().tolist()
    binary = len(matrix) == 1
    columns = [[0.0, w] for w in matrix[0].tolist()] if binary else matrix.T.tolist()
    table = spark.createDataFrame(pa.table({
        "term": pa.array(vocabulary, pa.string()), "w": pa.array(columns, pa.list_(pa.float64()))}))
    return LinearModel(table, [0.0, *intercepts] if binary else intercepts, model.labels,
                       [1] if binary else list(range(len(matrix))))


def _entry(array: str, k: int) -> Column:
    return F.get(F.col(array), F.lit(k))


def row_scores(entries: DataFrame, model: LinearModel) -> DataFrame:
    """``row, score`` (array by class) of rows that hold a term, without intercepts."""
    joined = entries.join(F.broadcast(model.coefficients), "term")
    sums = [F.sum(F.col("weight") * _entry("w", k)) for k in range(len(model.labels))]
    return joined.groupBy("row").agg(F.array(*sums).alias("score"))


def with_residuals(rows: DataFrame, scores: DataFrame, model: LinearModel) -> DataFrame:
    """Add ``loss`` and ``residual`` (probability minus truth, times the row's weight) to ``row, label, weight``."""
    intercepts = F.array(*[F.lit(b) for b in model.intercepts])
    place = F.array_position(F.array(*[F.lit(x) for x in model.labels]), F.col("label")) - 1
    scored = rows.join(scores, "row", "left").select(
        "row", "weight", place.cast("int").alias("place"),
        F.coalesce(F.zip_with("score", intercepts, lambda s, b: s + b), intercepts).alias("score"))
    shifted = scored.withColumn("score", F.transform("score", lambda s: s - F.array_max("score")))
    powers = shifted.withColumn("power", F.transform("score", F.exp))
    total = powers.withColumn("total", F.aggregate("power", F.lit(0.0), lambda t, x: t + x))
    return total.select(
        "row", "weight", (F.log("total") - F.get("score", F.col("place"))).alias("loss"),
        F.transform("power", lambda x, k: F.col("weight") * (
            x / F.col("total") - F.when(k == F.col("place"), 1.0).otherwise(0.0))).alias("residual"))


def gradient(entries: DataFrame, residuals: DataFrame, model: LinearModel, total: float, penalty: float) -> DataFrame:
    """``term, g``: the objective's derivative by every coefficient, an entry per class."""
    sums = [F.sum(F.col("weight") * _entry("residual", k)) / total for k in range(len(model.labels))]
    parts = entries.join(residuals.select("row", "residual"), "row").groupBy("term").agg(F.array(*sums).alias("g"))
    zeros = F.array(*[F.lit(0.0)] * len(model.labels))
    return model.coefficients.join(parts, "term", "left").select(
        "term", F.zip_with(F.coalesce("g", zeros), "w", lambda g, w: g + penalty * w).alias("g"), "w")


def certificate(rows: DataFrame, text: str, label: str, model: Classifier,
                settings: Settings = Settings(), penalty: float | None = None) -> DataFrame:
    """One row on a fit over ``rows``: sizes, loss, norm and the largest entry of the gradient.

    ``penalty`` defaults to that of ``fit_classifier``, one over the number of rows.
    """
    spark = rows.sparkSession
    kept = stage(rows.select(F.monotonically_increasing_id().alias("row"), F.col(label).alias("label"),
                             F.coalesce(F.col(text), F.lit("")).alias("text")), "certificate-rows")
    weights = stage(balanced_weights(kept, "label").select("label", "weight"), "certificate-weights")
    weighted = kept.select("row", "label").join(weights, "label")
    sizes = weighted.agg(F.count(F.lit(1)).alias("rows"), F.sum("weight").alias("total")).first()
    grams = T.gram_lists(kept, "row", F.col("text"))
    entries = stage(T.tfidf_weights(grams, "row", T.vocabulary(
        grams, settings.max_features, settings.min_documents)), "certificate-entries")
    fitted = linear_model(spark, model)
    penalty = 1.0 / sizes["rows"] if penalty is None else penalty
    residuals = stage(with_residuals(weighted, row_scores(entries, fitted), fitted), "certificate-residuals")
    by_term = gradient(entries, residuals, fitted, sizes["total"], penalty)
    classes = fitted.fitted_classes
    slopes = by_term.agg(
        F.count(F.lit(1)).alias("terms"),
        F.max(F.greatest(F.lit(0.0), *[F.abs(_entry("g", k)) for k in classes])).alias("slope"),
        F.sum(F.aggregate("w", F.lit(0.0), lambda t, w: t + w * w)).alias("squares"))
    losses = residuals.agg(
        (F.sum(F.col("loss") * F.col("weight")) / sizes["total"]).alias("loss"),
        F.greatest(F.lit(0.0), *[F.abs(F.sum(_entry("residual", k))) / sizes["total"] for k in classes])
        .alias("slope")).first()
    largest = F.greatest("slope", F.lit(losses["slope"]))
    return slopes.select(
        F.lit(sizes["rows"]).alias("rows"), F.lit(len(fitted.labels)).alias("classes"), "terms",
        (losses["loss"] + penalty / 2 * F.col("squares")).alias("objective"),
        F.sqrt("squares").alias("norm"), largest.alias("largest_slope"),
        (largest <= STATIONARY).alias("optimal"))
