"""Resolving arrays of foreign ids to sets of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def names_of_ids(df: DataFrame, keys: list[str],
                 sets: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Group ``df`` by ``keys`` and collect the names its id arrays refer to.

    ``sets`` maps an output column to (id-array column, dimension with
    ``id, name``). Joining each dimension on ``array_contains`` would be a
    nested loop and would multiply the arrays of a row with one another. Here
    the ids of all arrays go through one explode, tagged with the set they
    belong to, and one equi-join; the cost is the sum of the array lengths.
    The ids of a row stay in one task up to the partial ``collect_set``, so the
    aggregate shuffles one row per input row when the dimension is broadcast.
    A dimension too large for that joins by shuffle, where AQE splits hot ids.
    """
    tags = F.concat(*[_tagged(F.col(ids), kind) for kind, (ids, _) in sets.items()])
    exploded = df.select(*keys, F.explode_outer(tags).alias("tag"))
    # A null id matches nothing; a salt in place of its set keeps such rows from one task.
    salt = F.concat(F.lit("none "), F.pmod(F.xxhash64(*keys), F.lit(4096)).cast("string"))
    tagged = exploded.select(*keys, F.when(F.col("tag.id").isNull(), salt).otherwise(F.col("tag.kind"))
                             .alias("kind"), F.col("tag.id").alias("id"))
    names = reduce(DataFrame.unionByName, [
        dim.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"),
                   F.col("name").alias("name"))
        for kind, (_, dim) in sets.items()
    ])
    named = tagged.join(names, ["kind", "id"], "left")
    return named.groupBy(*keys).agg(*[
        F.collect_set(F.when(F.col("kind") == kind, F.col("name"))).alias(kind) for kind in sets
    ])


def _tagged(ids: Column, kind: str) -> Column:
    """An id array as ``struct<kind, id>``; a null array is an empty one."""
    present = F.coalesce(ids.cast("array<string>"), F.array().cast("array<string>"))
    return F.transform(present, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))
