"""Classes ranked by probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_probability(probs: Column) -> Column:
    """``probs`` from most to least probable, equal ones in name order.

    Sorting happens inside the row; no window or shuffle is needed.
    """
    keyed = F.transform(probs, lambda c: F.struct((-c["p"]).alias("n"), c["class"].alias("class"),
                                                  c["p"].alias("p")))
    return F.transform(F.array_sort(keyed),
                       lambda c: F.struct(c["class"].alias("class"), c["p"].alias("p")))


def ranked_predictions(scored: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, rank, class, probability``, one row per class."""
    return (
        # The outer form keeps Spark from sorting once more to test for emptiness.
        scored.select(doc, F.posexplode_outer(by_probability(F.col("probs"))).alias("pos", "c"))
        .where(F.col("c").isNotNull())
        .select(doc, (F.col("pos") + 1).alias("rank"), F.col("c.class").alias("class"),
                F.col("c.p").alias("probability"))
    )
