"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of
ten code points and more count, by 128-bit hash. The index of a set of documents is

* ``refs``: per key the number of documents that hold it and the smallest of their
  ids, exact;
* ``postings``: (doc_id, key), which makes deletions exact;
* ``filters``: one cuckoo filter per shard of the keys, with one fingerprint per key.

An insertion first adds its documents up per key, so that a line of a third of all
documents is one row. A key that its shard's filter does not know is new and is
appended; only the others meet the reference counts in a join. A deletion counts
its postings off, gives keys whose smallest holder left a new one, and takes keys
that nobody holds out of counts and filter. A filter without room for what comes is
refilled from the counts of its shard; the others are not touched. Shards stay small: all
are dealt anew when they hold four times the keys they are meant for. Every state is a
set of Parquet tables in the shared folder; earlier states stay readable.

A key held by two documents or more loses its lines everywhere but in the smallest
id that holds it. Defined results: a null or empty text is one empty line; rows
without an id are not indexed and lose nothing; rows of one id count as one
document; a document inserted again, or deleted without being there, changes
nothing; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import staged
from labelloom.llm.cuckoo import MAX_LOAD, CuckooFilter

MIN_CODE_POINTS = 10
KEYS_PER_SHARD = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POSTING = "doc_id long, key binary"
_ROUTED = "key binary, n long, first_doc long, known boolean, shard int, filter binary"
_FILTER = "shard int, filter binary, n long"


def line_key(line: bytes) -> bytes | None:
    """Hash of a line's key; None for lines that are too short to count."""
    key = line.strip().translate(_LOWER)
    size = len(key)
    if size < MIN_CODE_POINTS or size < 4 * MIN_CODE_POINTS and len(key.decode()) < MIN_CODE_POINTS:
        return None
    return xxhash.xxh3_128_digest(key)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            found = {line_key(x) for x in text.encode().split(b"\n")} - {None}
            ids += [doc] * len(found)
            keys += found
        yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary())})


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, key) for every counting line of every document."""
    return docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_postings, _POSTING)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _hashes(keys: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8")[::2].copy() if len(keys) else np.zeros(0, np.uint64)


def _rows(table: pa.Table, known: np.ndarray) -> pa.Table:
    n = table.num_rows
    return pa.table({"key": table.column("key"), "n": table.column("n"), "first_doc": table.column("first_doc"),
                     "known": pa.array(known, pa.bool_()), "shard": pa.nulls(n, pa.int32()),
                     "filter": pa.nulls(n, pa.binary())})


def _filter_row(shard: int, filter_: CuckooFilter) -> pa.Table:
    """A shard's filter; ``n`` is what it holds."""
    none = {"key": pa.binary(), "first_doc": pa.int64(), "known": pa.bool_()}
    row = {**{k: pa.nulls(1, t) for k, t in none.items()}, "n": pa.array([filter_.size], pa.int64()),
           "shard": pa.array([shard], pa.int32()), "filter": pa.array([filter_.to_bytes()], pa.binary())}
    return pa.table({name: row[name] for name in ("key", "n", "first_doc", "known", "shard", "filter")})


def _routed(key: tuple, added: pa.Table, filters: pa.Table) -> pa.Table:
    """Which keys of a shard its filter knows; then the filter with the new ones in it."""
    shard = key[0].as_py()
    hashes = _hashes(added.column("key"))
    if filters.num_rows:
        filter_ = CuckooFilter.from_bytes(filters.column("filter")[0].as_py())
        known = filter_.contains(hashes)
    else:
        filter_, known = CuckooFilter.for_keys(2 * len(hashes)), np.zeros(len(hashes), bool)
    # two keys of one batch may share a fingerprint; a known key is settled by the exact
    # counts, and put into the filter afterwards if it is new there after all
    filter_.insert(hashes[~known])
    return pa.concat_tables([_rows(added, known), _filter_row(shard, filter_)])


def _refilled(key: tuple, keys: pa.Table, wanted: pa.Table) -> pa.Table:
    """A shard's filter built anew from its keys, with the room that is wanted."""
    filter_ = CuckooFilter.for_keys(max(wanted.column("room")[0].as_py(), keys.num_rows))
    filter_.insert(_hashes(keys.column("key")))
    return _filter_row(key[0].as_py(), filter_)


def _settled(key: tuple, keys: pa.Table, filters: pa.Table) -> pa.Table:
    """A shard's filter after late insertions (``n`` = 1) and deletions (``n`` = -1)."""
    filter_ = CuckooFilter.from_bytes(filters.column("filter")[0].as_py())
    hashes, change = _hashes(keys.column("key")), keys.column("n").to_numpy()
    filter_.delete(hashes[change < 0])
    filter_.insert(hashes[change > 0])
    return _filter_row(key[0].as_py(), filter_)


@dataclass(frozen=True)
class LineIndex:
    """A state of the index; insertions and deletions return a new one."""

    refs: DataFrame
    postings: DataFrame
    filters: DataFrame
    shards: int
    keys: int

    # ---- building -------------------------------------------------------------------------

    @staticmethod
    def of(docs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> "LineIndex":
        """An index of ``docs``: of half of them, by a hash of the id, and then of the others as an insertion.

        So of every key that both halves hold, a filter tells that it is known, and the exact
        counts are asked for those keys only.
        """
        second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
        return LineIndex.build(docs.where(~second), keys_per_shard).insert(docs.where(second), keys_per_shard)

    @staticmethod
    def build(docs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> "LineIndex":
        """An index of ``docs``: an insertion into an empty one."""
        new = staged(postings(docs).distinct(), "line-postings")
        delta = staged(new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")),
                       "line-delta")
        keys = delta.count()
        shards = max(1, -(-keys // keys_per_shard))
        nothing = docs.sparkSession.createDataFrame([], _FILTER)
        refs, filters = _route(delta, nothing, shards)
        return LineIndex(refs.select("key", "n", "first_doc"), new, filters, shards, keys)

    def _with_room(self, delta: DataFrame, keys_per_shard: int) -> "LineIndex":
        """The same state with room for the keys of ``delta``.

        Shards that lack room get a larger filter; the others are not touched. Only where
        shards would hold four times the keys they are meant for, all are dealt anew.
        """
        more = delta.count()
        if self.keys + more > 4 * self.shards * keys_per_shard:
            shards = max(1, -(-2 * (self.keys + more) // keys_per_shard))
            wanted = self.refs.sparkSession.range(shards).select(
                F.col("id").cast("int").alias("shard"), F.lit(keys_per_shard).cast("long").alias("room"))
            return LineIndex(self.refs, self.postings, _refill(self.refs, wanted, shards), shards, self.keys)
        need = delta.groupBy(_shard(self.shards).alias("shard")).agg(F.count(F.lit(1)).alias("more"))
        room = F.octet_length("filter") / 2 * MAX_LOAD
        wanted = staged(self.filters.join(need, "shard").where(F.col("n") + F.col("more") > room).select(
            "shard", (2 * (F.col("n") + F.col("more"))).alias("room")), "line-wanted")
        if wanted.isEmpty():
            return self
        filters = staged(self.filters.join(wanted, "shard", "left_anti").unionByName(
            _refill(self.refs, wanted, self.shards)), "line-filters")
        return LineIndex(self.refs, self.postings, filters, self.shards, self.keys)

    # ---- changes ---------------------------------------------------------------------------

    def insert(self, docs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> "LineIndex":
        new = staged(postings(docs).distinct().join(self.postings, ["doc_id", "key"], "left_anti"), "line-postings")
        delta = staged(new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")),
                       "line-delta")
        state = self._with_room(delta, keys_per_shard)
        routed, filters = _route(delta, state.filters, state.shards)
        fresh = routed.where(~F.col("known")).select("key", "n", "first_doc")
        maybe = routed.where(F.col("known")).select("key", F.col("n").alias("more"), F.col("first_doc").alias("new_first"))
        # exact counts decide about the keys a filter claims to know
        met = staged(maybe.join(self.refs, "key", "left").select(
            "key", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("n"),
            F.least("first_doc", "new_first").alias("first_doc"), F.col("n").isNull().alias("unseen")), "line-met")
        refs = staged(self.refs.join(met, "key", "left_anti").unionByName(fresh).unionByName(
            met.drop("unseen")), "line-refs")
        late = met.where("unseen").select("key", F.lit(1).cast("long").alias("n"))
        return LineIndex(refs, staged(self.postings.unionByName(new), "line-postings"),
                         _settle(late, filters, state.shards), state.shards, refs.count())

    def delete(self, ids: DataFrame) -> "LineIndex":
        """Without the documents whose ``doc_id`` is in ``ids``."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        gone = staged(self.postings.join(ids, "doc_id", "left_semi"), "line-gone")
        left = staged(self.postings.join(ids, "doc_id", "left_anti"), "line-postings")
        less = gone.groupBy("key").agg(F.count(F.lit(1)).alias("less"), F.min("doc_id").alias("gone_first"))
        touched = staged(self.refs.join(less, "key").withColumn("n", F.col("n") - F.col("less")), "line-touched")
        orphaned = touched.where((F.col("n") > 0) & (F.col("gone_first") == F.col("first_doc"))).select("key")
        firsts = left.join(orphaned, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("new_first"))
        kept = touched.where(F.col("n") > 0).join(firsts, "key", "left").select(
            "key", "n", F.coalesce("new_first", "first_doc").alias("first_doc"))
        refs = staged(self.refs.join(touched, "key", "left_anti").unionByName(kept), "line-refs")
        dead = touched.where(F.col("n") == 0).select("key", F.lit(-1).cast("long").alias("n"))
        return LineIndex(refs, left, _settle(dead, self.filters, self.shards), self.shards, refs.count())

    # ---- use -------------------------------------------------------------------------------

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses."""
        repeated = self.refs.where(F.col("n") > 1).select("key", "first_doc")
        lost = self.postings.join(repeated, "key").where(F.col("doc_id") != F.col("first_doc"))
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept) with the kept lines as text."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        joined = rows.join(self.drops().hint("shuffle_hash"), "doc_id", "left")
        return joined.mapInArrow(_rewritten, "doc_id long, n_lines long, n_dropped long, kept string")

    def digests(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_sha256)."""
        return self.deduplicated(docs).select(
            "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _route(delta: DataFrame, filters: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``delta`` with ``known``, and the filters after the insertion."""
    placed = delta.select("key", "n", "first_doc", _shard(shards).alias("shard"))
    touched = filters.join(placed.select("shard").distinct(), "shard", "left_semi")
    out = staged(placed.groupBy("shard").cogroup(touched.groupBy("shard")).applyInArrow(_routed, _ROUTED), "line-routed")
    changed = out.where(F.col("filter").isNotNull()).select("shard", "filter", "n")
    return out.where(F.col("filter").isNull()), staged(
        filters.join(changed, "shard", "left_anti").unionByName(changed), "line-filters")


def _refill(refs: DataFrame, wanted: DataFrame, shards: int) -> DataFrame:
    """New filters for the shards of ``wanted`` (shard, room), from the reference counts."""
    keys = refs.select("key", _shard(shards).alias("shard")).join(wanted.select("shard"), "shard", "left_semi")
    return staged(keys.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_refilled, _ROUTED).select(
        "shard", "filter", "n"), "line-filters")


def _settle(changes: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Filters after keys were put in or taken out; untouched shards stay as they are."""
    placed = staged(changes.select("key", "n", F.lit(None).cast("long").alias("first_doc"),
                                   _shard(shards).alias("shard")), "line-changes")
    changed = staged(placed.groupBy("shard").cogroup(
        filters.join(placed, "shard", "left_semi").groupBy("shard")).applyInArrow(_settled, _ROUTED)
        .select("shard", "filter", "n"), "line-filters")
    return staged(filters.join(changed, "shard", "left_anti").unionByName(changed), "line-filters")


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, dropped, kept = [], [], []
        for text, keys in zip(batch.column("text").to_pylist(), batch.column("keys").to_pylist()):
            lines = (text or "").encode().split(b"\n")
            total.append(len(lines))
            if keys:
                lost = set(keys)
                lines = [x for x in lines if line_key(x) not in lost]
            dropped.append(total[-1] - len(lines))
            kept.append(b"\n".join(lines).decode())
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_lines": pa.array(total, pa.int64()),
                               "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.string())})
