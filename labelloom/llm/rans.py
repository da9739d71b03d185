"""Token ids in files of entropy-coded blocks (static range asymmetric numeral system).

The file format. Documents are in ascending id order over numbered parts (Parquet
rows, so Spark's committer makes a rerun of a lost task harmless). A part is a row
of segments; a segment ends with the first document that fills it and holds

* ``ids`` and ``freqs``: the frequency table that all blocks of the segment share: the
  segment's own id counts scaled to 2**16, every id that occurs at 1 or more;
* ``halves``: whether the lower and upper halves of ids are coded in turn, which is done
  where more ids differ than such a table holds;
* ``payload``: blocks of 2**14 symbols. A block has 64 interleaved coder states of its
  own and can be decoded alone;
* ``blocks``: the checkpoints. Coded symbols, payload offset and CRC-32 of each block;
* ``docs``: id and number of tokens of each document.

States are 32 bits, renormalised by 16-bit words, so a step moves at most one word.
Coding is vectorised over all blocks and states of a segment.

Defined results: a null text is empty and holds the end id only; rows without an
id come first; rows of one id stand together, ordered by their texts' hashes; an empty
table gives empty files and no rows. Texts of any length are encoded whole. Other columns
of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.tokenizing import chunk_encoder

SCALE_BITS = 16
LANES = 64
STEPS = 256
BLOCK = LANES * STEPS
SEGMENT_TOKENS = 1 << 21
END_ID = 0
CHARACTERS_AT_ONCE = 1 << 20

_LOW = np.uint32(1 << 16)
_BLOCK_TYPE = pa.struct([("ids", pa.int64()), ("offset", pa.int64()), ("crc", pa.int64())])
_DOC_TYPE = pa.struct([("doc_id", pa.int64()), ("n", pa.int64())])
_SEGMENT = ("segment long, tokens long, halves boolean, ids binary, freqs binary, payload binary, "
            "blocks array<struct<ids: long, offset: long, crc: long>>, "
            "docs array<struct<doc_id: long, n: long>>")


# ---- frequency tables ------------------------------------------------------------------

def frequency_table(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**16 with no occurring id at zero; so there are 2**16 ids at most."""
    total = 1 << SCALE_BITS
    if len(counts) > total:
        raise ValueError(f"{len(counts)} ids do not fit a table of {total}")
    scaled = np.maximum(1, counts.astype(np.float64) * total / counts.sum()).astype(np.int64)
    spare = total - int(scaled.sum())
    order = np.argsort(-scaled, kind="stable")
    if spare >= 0:
        scaled[order[0]] += spare
    while spare < 0:  # take from the largest, never below 1
        room = scaled[order] - 1
        take = np.minimum(room, np.maximum(1, room * -spare // max(1, int(room.sum()))))
        upto = np.cumsum(take)
        take = np.where(upto <= -spare, take, np.maximum(0, take - (upto + spare)))
        scaled[order] -= take
        spare += int(take.sum())
    return scaled.astype(np.uint32)


# ---- blocks --------------------------------------------------------------------------------

def encode_blocks(symbols: np.ndarray, freqs: np.ndarray) -> list[bytes]:
    """Payloads of the blocks of ``symbols`` (places in the table)."""
    blocks = max(1, -(-len(symbols) // BLOCK))
    padded = np.full(blocks * BLOCK, int(np.argmax(freqs)), np.int64)
    padded[:len(symbols)] = symbols
    grid = padded.reshape(blocks, STEPS, LANES)
    begins = (np.cumsum(freqs) - freqs).astype(np.uint32)
    states = np.full((blocks, LANES), _LOW, np.uint32)
    words = np.zeros((STEPS, blocks, LANES), np.uint16)
    moved = np.zeros((STEPS, blocks, LANES), bool)
    for step in range(STEPS - 1, -1, -1):
        at = grid[:, step]
        freq = freqs[at]
        high = states >> np.uint32(16)
        full = high >= freq
        words[step] = states.astype(np.uint16)  # the lower half
        moved[step] = full
        states = np.where(full, high, states)
        whole = states // freq
        states = (whole << np.uint32(SCALE_BITS)) + begins[at] + (states - whole * freq)
    out = []
    for b in range(blocks):
        stream = words[:, b][moved[:, b]]
        out.append(states[b].astype("<u4").tobytes() + stream.astype("<u2").tobytes())
    return out


def decode_blocks(payloads: list[bytes], freqs: np.ndarray) -> np.ndarray:
    """Places of all symbols of whole blocks, one row per block."""
    blocks = len(payloads)
    begins = (np.cumsum(freqs) - freqs).astype(np.uint32)
    slots = np.repeat(np.arange(len(freqs), dtype=np.uint32), freqs)
    head = 4 * LANES
    states = np.stack([np.frombuffer(p, "<u4", LANES) for p in payloads]).astype(np.uint32)
    streams = [np.frombuffer(p, "<u2", offset=head) for p in payloads]
    ends = np.cumsum([len(s) for s in streams])
    flat = np.concatenate([*streams, np.zeros(1, "<u2")]).astype(np.uint32)
    at = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.empty((blocks, STEPS, LANES), np.uint32)
    for step in range(STEPS):
        slot = states & np.uint32((1 << SCALE_BITS) - 1)
        symbol = slots[slot]
        out[:, step] = symbol
        states = freqs[symbol] * (states >> np.uint32(SCALE_BITS)) + slot - begins[symbol]
        low = states < _LOW
        rank = np.cumsum(low, axis=1)
        word = flat[np.minimum(at[:, None] + rank - 1, len(flat) - 1)]
        states = np.where(low, (states << np.uint32(16)) | word, states)
        at += rank[:, -1]
    return out.reshape(blocks, BLOCK)


# ---- segments ------------------------------------------------------------------------------

def as_symbols(ids: np.ndarray) -> tuple[np.ndarray, bool]:
    """What is coded of ids: themselves, or their lower and upper halves if more differ than a table holds."""
    most = 1 << SCALE_BITS
    halves = min(len(ids), int(ids.max(initial=0)) + 1) > most and np.count_nonzero(np.bincount(ids)) > most
    return (ids.astype("<u4").view("<u2").astype(np.uint32), True) if halves else (ids, False)


def as_ids(symbols: np.ndarray, halves: bool) -> np.ndarray:
    return symbols.astype("<u2").view("<u4") if halves else symbols.astype("<u4")


def encode_segment(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes, list[dict]]:
    """Table ids, their frequencies, payload and checkpoints."""
    counts = np.bincount(ids)
    table = np.flatnonzero(counts).astype(np.uint32)
    freqs = frequency_table(counts[table])
    place = np.zeros(len(counts), np.int64)
    place[table] = np.arange(len(table))
    payloads = encode_blocks(place[ids], freqs)
    marks, offset = [], 0
    for i, payload in enumerate(payloads):
        marks.append({"ids": min(BLOCK, len(ids) - i * BLOCK), "offset": offset, "crc": zlib.crc32(payload)})
        offset += len(payload)
    return table, freqs, b"".join(payloads), marks


def decode_segment(table: np.ndarray, freqs: np.ndarray, payload: bytes, marks: list[dict],
                   first: int = 0, count: int | None = None) -> np.ndarray:
    """Ids of ``count`` blocks from block ``first`` on (all by default), checksums verified."""
    last = len(marks) if count is None else min(len(marks), first + count)
    ends = [m["offset"] for m in marks[1:]] + [len(payload)]
    parts = [payload[marks[i]["offset"]:ends[i]] for i in range(first, last)]
    for i, part in zip(range(first, last), parts):
        if zlib.crc32(part) != marks[i]["crc"]:
            raise ValueError(f"block {i} does not match its checksum")
    places = decode_blocks(parts, freqs)
    return np.concatenate([table[row[:m["ids"]]] for row, m in zip(places, marks[first:last])])


def _ids(encoder, texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of each text; a few texts are encoded at once, so that memory stays small."""
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) <= CHARACTERS_AT_ONCE:
            size += len(texts[end])
            end += 1
        flat, sizes = encoder.encode(texts[begin:end])
        yield from np.split(flat, np.cumsum(sizes)[:-1])
        begin = end


def _segments(path: str, segment_tokens: int):
    """Encode a partition's sorted texts into segments."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path, keep_spaces=True)
        number, held, docs, size = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, docs, size
            symbols, halves = as_symbols(np.concatenate(held))
            table, freqs, payload, marks = encode_segment(symbols)
            row = pa.record_batch({
                "segment": pa.array([number], pa.int64()), "tokens": pa.array([size], pa.int64()),
                "halves": pa.array([halves], pa.bool_()),
                "ids": pa.array([table.astype("<u4").tobytes()], pa.binary()),
                "freqs": pa.array([freqs.astype("<u4").tobytes()], pa.binary()),
                "payload": pa.array([payload], pa.binary()),
                "blocks": pa.array([marks], pa.list_(_BLOCK_TYPE)),
                "docs": pa.array([docs], pa.list_(_DOC_TYPE))})
            number, held, docs, size = number + 1, [], [], 0
            return row

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for key, ids in zip(keys, _ids(encoder, [t or "" for t in batch.column("text").to_pylist()])):
                held.append(np.append(ids, np.uint32(END_ID)))
                docs.append({"doc_id": key, "n": len(ids) + 1})
                size += len(ids) + 1
                if size >= segment_tokens:
                    yield flush()
        if docs:
            yield flush()
    return encode


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str,
                 segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode ``docs`` into ``folder``: files in ascending id order.

    Only texts move, once, to bring them in order; ids are made, coded and written
    in the same task, a segment at a time. Rows of one id, or of none, come in the order of
    their texts' hashes, and ranges are cut by both, so that many of them share no task.
    """
    order = ["doc_id", "text_key", "text"]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias(
        "text_key")).repartitionByRange("doc_id", "text_key").sortWithinPartitions(*order).drop("text_key")
    coded = ordered.mapInArrow(_segments(tokenizer_path, segment_tokens), _SEGMENT)
    coded.select(F.spark_partition_id().alias("part"), "*").write.parquet(folder)


_DOC_ROW = "part int, segment long, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: start within its segment, tokens and checksum of the decoded ids."""
    for batch in batches:
        for row in range(batch.num_rows):
            s = {name: batch.column(name)[row] for name in batch.schema.names}
            ids = as_ids(decode_segment(
                np.frombuffer(s["ids"].as_py(), "<u4"), np.frombuffer(s["freqs"].as_py(), "<u4"),
                s["payload"].as_py(), s["blocks"].as_py()), s["halves"].as_py())
            docs = s["docs"].as_py()
            ends = np.cumsum([d["n"] for d in docs])
            starts = ends - [d["n"] for d in docs]
            yield pa.record_batch({
                "part": pa.array([s["part"].as_py()] * len(docs), pa.int32()),
                "segment": pa.array([s["segment"].as_py()] * len(docs), pa.int64()),
                "place": pa.array(range(len(docs)), pa.int64()),
                "doc_id": pa.array([d["doc_id"] for d in docs], pa.int64()),
                "start": pa.array(starts, pa.int64()),
                "n_tokens": pa.array([d["n"] for d in docs], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64())})


def read_tokens(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone.

    Starts come from the segments' sizes: running sums inside a part, then over the
    parts' totals, which is one row per file.
    """
    files = spark.read.schema(f"part int, {_SEGMENT}").parquet(folder)
    sizes = files.select("part", "segment", "tokens")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens")).select(
        "part", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("part_start"))
    starts = sizes.select("part", "segment", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias(
        "segment_start")).join(parts, "part")
    decoded = files.drop("tokens").mapInArrow(_documents, _DOC_ROW)
    return decoded.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("part_start") + F.col("segment_start") + F.col("start")).cast("long").alias("start"),
        "n_tokens", "ids_crc32")
