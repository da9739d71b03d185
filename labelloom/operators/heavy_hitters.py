"""Frequent keys of a table by a mergeable summary, without a shuffle of all keys.

Every task keeps at most ``CAPACITY`` keys of its rows with counts. When it meets more, it
takes the same number off all of them, so that no more than these stay above zero, and
forgets the others. What it took off in all is the most by which one of its counts is too
low, and at most ``rows / CAPACITY``. Summaries merge by adding counts and adding what was
taken off, in any order, so a retried task changes nothing.

A key that occurs ``n`` times has a merged count between ``n - taken`` and ``n``, and a key
without a count occurs at most ``taken`` times. A task with no more distinct keys than it
may keep takes nothing off, and its counts are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import stage

CAPACITY = 1 << 17


def _merged(held: pa.Table, batch: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    """Counts of both, cut to ``capacity`` keys, and what was taken off each."""
    both = pa.concat_tables([held, batch]).group_by("key").aggregate([("n", "sum")]).rename_columns(["key", "n"])
    if both.num_rows <= capacity:
        return both, 0
    counts = both.column("n").to_numpy()
    off = int(np.partition(counts, both.num_rows - capacity - 1)[both.num_rows - capacity - 1])
    left = pa.table({"key": both.column("key"), "n": pa.array(counts - off)})
    return left.filter(pc.greater(left.column("n"), 0)), off


def _summaries(capacity: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        held, taken, rows = empty, 0, 0
        for batch in batches:
            counted = pa.table({"key": batch.column(0).cast(pa.string())}).group_by("key").aggregate([([], "count_all")])
            held, off = _merged(held, counted.rename_columns(["key", "n"]), capacity)
            taken, rows = taken + off, rows + batch.num_rows
        # the row without a key says what was taken off and how many rows there were
        nothing = pa.table({"key": pa.array([None], pa.string()), "n": pa.array([0], pa.int64())})
        out = pa.concat_tables([held, nothing]).combine_chunks()
        last = np.arange(out.num_rows) == out.num_rows - 1
        yield pa.RecordBatch.from_arrays(
            [out.column("key").combine_chunks(), out.column("n").combine_chunks(),
             pa.array(np.where(last, taken, 0)), pa.array(np.where(last, rows, 0))], ["key", "n", "taken", "rows"])
    return summarise


def key_summary(df: DataFrame, key: str, capacity: int = CAPACITY) -> tuple[DataFrame, int, int]:
    """(``key, n``, taken, rows): counts that are too low by at most ``taken``, from one pass.

    Keys are compared as text; rows without a key are left out.
    """
    parts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key")).mapInArrow(
        _summaries(capacity), "key string, n long, taken long, rows long")
    merged = stage(parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "taken", "rows")]), "key-summary")
    totals = merged.where(F.col("key").isNull()).select("taken", "rows").first() or (0, 0)
    kept = merged.where(F.col("key").isNotNull()).select(F.col("key").cast(df.schema[key].dataType).alias(key), "n")
    return kept, totals[0], totals[1]
