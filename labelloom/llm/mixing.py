"""Mixing sources to target weights by repetition.

Sizes are summed per source, the token budget is shared by weight under a ceiling
per source, and a document is emitted ``floor(rate)`` times, plus once more when
a draw seeded by its id falls below the fraction of the rate. ``rate`` is the
source's target over its size. Everything is DataFrame functions.

Defined results: a null text has size 0; a null source is a source of its own and
comes last; a source of size 0 has target 0 and its documents are not emitted; an
empty table gives no rows. Repeated rows of one id get the same draw. Columns of
the input with the names used here are kept, as rows travel inside a struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import unused_name

SHARE = 1.5
WEIGHTS = (3, 1, 2)
CEILING = 2.0
SEED = "mix-1"
_DRAW_DIGITS = 13


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    key = F.concat(F.lit(f"{seed}#"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    digits = F.conv(F.substring(F.md5(key), 1, _DRAW_DIGITS), 16, 10).cast("double")
    return digits / F.lit(float(16 ** _DRAW_DIGITS))


def source_targets(sizes: DataFrame, share: float = SHARE, weights: Sequence[int] = WEIGHTS,
                   ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    The budget is ``share`` of all sizes. Sources in code point order take the
    weights in turn. A source whose share by weight would pass ``ceiling`` times
    its size stops there, and what is left is shared by the rest again. Sorted by
    ceiling over weight the stopped sources come first, so running sums find them
    in one pass. The windows see one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("turn", turn).select(
        "source", "source_size",
        F.get(F.array(*[F.lit(float(w)) for w in weights]), "turn").alias("weight"),
        (F.col("source_size") * ceiling).alias("cap"),
    ).withColumns({
        "budget": F.sum("source_size").over(everything) * share,
        "all_weight": F.sum("weight").over(everything),
    })
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("stopped", F.col("cap") / F.col("weight") <=
                  (F.col("budget") - F.col("cap_before"))
                  / (F.col("all_weight") - F.col("weight_before")))
    stopped_cap = F.sum(F.when(F.col("stopped"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("stopped"), 0.0).otherwise(F.col("weight"))).over(everything)
    return filled.withColumns({"stopped_cap": stopped_cap, "open_weight": open_weight}).select(
        "source", "source_size",
        F.when(F.col("stopped"), F.col("cap")).otherwise(
            F.col("weight") * ((F.col("budget") - F.col("stopped_cap")) / F.col("open_weight")))
        .alias("target"))


def with_copies(rows: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows (doc_id, source, ...) with ``source_size``, ``target`` and ``copies``.

    The targets are one row per source: adaptive execution turns the join into a
    broadcast once it has seen that they are small, and else splits a hot source.
    """
    t = targets.withColumnRenamed("source", "t_source")
    joined = rows.join(t, rows["source"].eqNullSafe(t["t_source"])).drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    extra = (draw(F.col("doc_id"), seed) < rate - whole).cast("long")
    return joined.withColumn("copies", whole + extra)


def mixed(docs: DataFrame, size: Column, share: float = SHARE, weights: Sequence[int] = WEIGHTS,
          ceiling: float = CEILING, seed: str = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as its copies, same columns."""
    targets = source_targets(docs.select("source", size.alias("size")), share, weights, ceiling)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select("doc_id", "source", row)
    copy = unused_name(docs.columns, "copy")
    out = with_copies(packed, targets, seed).where(F.col("copies") > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
