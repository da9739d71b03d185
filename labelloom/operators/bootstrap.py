"""Intervals and tests for classifier metrics.

The bootstrap is a Poisson one: every row would be drawn a Poisson(1) number of times,
independent of all others, so replicates need no shuffle of rows. Rows are first dealt by
hash to blocks and counted per (block, true, predicted); replicates draw blocks. From there
on the tables have blocks times classes squared times replicates rows at most, whatever
the number of predictions. Draws come from an MD5 of replicate and block, so reruns and
other engines agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.evaluation import metrics_of_pairs
from labelloom.session import stage

BLOCKS = 1000
REPLICATES = 200
SEED = 42
# cumulative probabilities of 0, 1, ... events at a mean of 1; the rest is below 2**-52
STEPS = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(18)]


def _hash_fraction(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from an MD5."""
    digits = F.substring(F.md5(F.concat_ws("#", *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def block_of(id_columns: list[str], blocks: int = BLOCKS, seed: int = SEED) -> Column:
    digits = F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_columns])), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(blocks)).cast("int")


def draws(replicate: Column, block: Column) -> Column:
    """How often a replicate draws a block: Poisson with a mean of 1."""
    fraction = _hash_fraction(F.lit("draw"), replicate.cast("string"), block.cast("string"))
    return F.size(F.filter(F.array(*[F.lit(s) for s in STEPS]), lambda step: step <= fraction)).cast("long")


def bootstrap_metrics(predictions: DataFrame, by: list[str], id_columns: list[str],
                      replicates: int = REPLICATES, blocks: int = BLOCKS) -> DataFrame:
    """``by, replicate, accuracy, macro_f1, weighted_f1, rows``: the metrics of every replicate."""
    counted = stage(predictions.groupBy(*by, block_of(id_columns, blocks).alias("block"), "true", "pred").agg(
        F.count(F.lit(1)).alias("n")), "blocks")
    drawn = counted.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    pairs = drawn.withColumn("n", F.col("n") * draws(F.col("replicate"), F.col("block"))).groupBy(
        *by, "replicate", "true", "pred").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    return metrics_of_pairs(pairs, [*by, "replicate"])


def bootstrap_intervals(predictions: DataFrame, by: list[str], id_columns: list[str], percent: int = 95,
                        replicates: int = REPLICATES, blocks: int = BLOCKS) -> DataFrame:
    """``by, metric, low, high``: the values that cut off half the rest on either side, by rank."""
    metrics = bootstrap_metrics(predictions, by, id_columns, replicates, blocks)
    measures = ("accuracy", "macro_f1", "weighted_f1")
    cut = replicates * (100 - percent) // 200
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in measures]))
    rows = metrics.select(*by, values.alias("v")).select(*by, "v.*")
    return rows.groupBy(*by, "metric").agg(F.sort_array(F.collect_list("value")).alias("values")).select(
        *by, "metric", F.get("values", F.lit(cut)).alias("low"),
        F.get("values", F.size("values") - 1 - cut).alias("high"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series at ``x + 10``, brought back by the recurrence."""
    y = x + 10
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    product = F.log(x)
    for i in range(1, 10):
        product = product + F.log(x + i)
    return series - product


def exact_sign_test(b: Column, c: Column) -> Column:
    """Two-sided p-value of ``b`` against ``c`` discordant pairs, were both sides as likely.

    The smaller side's tail is summed from its largest term on, as ratios. Terms fall; those
    more than ``8 * sqrt(n)`` places on add nothing to a double, so the sum stays short.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    first = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) - n * math.log(2)
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(8 * F.sqrt(n)) + 40).cast("int"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1.0).alias("term"))
    total = F.aggregate(steps, start, lambda t, i: F.struct(
        (t["total"] + t["term"]).alias("total"), (t["term"] * (k - i) / (n - k + i + 1)).alias("term")))["total"]
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(first) * total)).otherwise(1.0)


def paired_test(predictions: DataFrame, baseline: str, candidate: str, id_columns: list[str]) -> DataFrame:
    """One row: pairs, those that only one side gets right, and the exact p-value of McNemar's test.

    Predictions of both experiments meet in a group of the row's identity; a row that one
    of them lacks is no pair. Of a repeated identity one right prediction is enough.
    """
    right = F.col("true") == F.col("pred")
    pairs = predictions.where(F.col("experiment").isin(baseline, candidate)).groupBy(*id_columns).agg(
        F.max(F.when(F.col("experiment") == baseline, right)).alias("before"),
        F.max(F.when(F.col("experiment") == candidate, right)).alias("after")).where(
        F.col("before").isNotNull() & F.col("after").isNotNull())
    counts = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("before") & ~F.col("after")).alias("only_baseline"),
                       F.count_if(~F.col("before") & F.col("after")).alias("only_candidate"))
    return counts.withColumn("p_value", exact_sign_test(F.col("only_baseline"), F.col("only_candidate")))
