"""Connected components of an edge table, by contraction to smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); the root is its component's smallest node.

    In a round every node is replaced by the smallest of itself and its neighbours,
    and edges inside one node vanish. A node that is not the smallest around it is
    gone after the round, so the rounds are few; each is written to the shared folder.
    Nodes with very many edges are combined before the shuffle when the smallest
    neighbour is sought, and split by adaptive execution when edges are relabelled.
    """
    left = staged(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "component-edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("best")).select(
            "node", F.least("node", "best").alias("next")), "component-step")
        steps.append(step)
        for end in ("u", "v"):
            left = left.join(step.select(F.col("node").alias(end), F.col("next").alias(f"next_{end}")), end)
        left = staged(left.select(F.col("next_u").alias("u"), F.col("next_v").alias("v")).where(
            F.col("u") != F.col("v")).distinct(), "component-edges")
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = steps[0].select("node", F.col("next").alias("root"))
    for step in steps[1:]:
        found = found.join(step.select(F.col("node").alias("root"), "next"), "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"))
    return staged(found, "component-roots")
