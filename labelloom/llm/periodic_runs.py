"""Periodic runs of words: string synchronising sets propose periods, names of windows confirm them.

A run is a stretch of words with smallest period ``q`` that holds it at least twice and
that no neighbouring word extends. Runs of ``least`` words and more are found, all of
them, in time that grows with ``n log n``:

1. Every window of 1, 2, 4, ... words gets a 64-bit name. Documents of a chunk lie
   behind each other with a separator of its own after each, longest first, so that a
   scale looks at those only that are long enough for it.
2. At scale ``t`` (2, 4, 8, ...) a position is taken if the smallest name among the
   windows of ``t`` words that start at it or at the ``t`` positions after it is that of
   the first or the last. Whether it is depends on its context of ``2 * t`` words alone,
   so equal contexts are taken alike. Windows with a period of at most ``t / 3`` are left
   out of the choice. Any ``t`` positions then hold a taken one, except where ``3 * t - 1``
   words have such a small period.
3. Two taken positions of equal context at a distance in ``[3 * t, 6 * t)`` propose this
   distance as a period (at scale 2 every distance below 12). A run of such a period
   holds such a pair, or the first ``length - period`` words of it lie in one highly
   periodic region and the rest of it in the next one of the same small period.
4. The highly periodic regions are the runs that smaller scales have found (those of
   period 1 are seen directly). Two that meet or overlap fix the larger period up to
   multiples of the small one; these periods are proposed, too.
5. A proposal is extended to both sides by names of halving length. Of one stretch
   the smallest period stays.

Runs are then compared word by word; should two different windows ever share a name,
the chunk is done again with other names, so results are exact. Memory is a few
hundred bytes per word of a chunk; a chunk has 2**18 words, or one longer text.

Defined results: a null text is an empty one; a text without words has no run and an
empty collapsed text; rows are handled one by one, also without an id or with a
repeated one; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import WORD, let
from labelloom.llm.shingles import mixed_bits

LEAST = 12
_CHUNK = 1 << 18
_ATTEMPTS = 8
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def window_names(codes: np.ndarray, longest: int, seed: int) -> list[np.ndarray]:
    """Names of all windows of 1, 2, 4, ... up to at least half of ``longest`` words."""
    names = [mixed_bits(codes.astype(np.uint64) * _LEFT + np.uint64(seed))]
    size = 1
    while 2 * size <= max(longest, 4) and 2 * size <= len(codes):
        last = names[-1]
        names.append(mixed_bits(last[:-size] * _LEFT + last[size:] * _RIGHT + np.uint64(size)))
        size *= 2
    return names


def _common_after(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from ``x`` on equal those from ``y`` on, ``x < y``."""
    got = np.zeros(len(x), np.int64)
    for level in range(len(names) - 1, -1, -1):
        at = np.flatnonzero(y + got + (1 << level) <= len(names[0]))
        same = names[level][x[at] + got[at]] == names[level][y[at] + got[at]]
        got[at[same]] += 1 << level
    return got


def _common_before(names: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words before ``x`` equal those before ``y``, ``x < y``."""
    got = np.zeros(len(x), np.int64)
    for level in range(len(names) - 1, -1, -1):
        at = np.flatnonzero(x - got >= 1 << level)
        same = (names[level][x[at] - got[at] - (1 << level)] == names[level][y[at] - got[at] - (1 << level)])
        got[at[same]] += 1 << level
    return got


def synchronising_positions(names: list[np.ndarray], scale: int, n: int, left_out: np.ndarray) -> np.ndarray:
    """Positions below ``n`` that the windows of ``2**scale`` words choose; ``left_out`` marks windows."""
    width = 1 << scale
    own = names[scale][:max(0, n - width + 1)]
    if len(own) <= width:
        return np.empty(0, np.int64)
    own = np.where(left_out[:len(own)], _NONE, own)
    least = own
    for step in range(scale):
        least = np.minimum(least[:-(1 << step)], least[1 << step:])
    least = np.minimum(least[:-1], least[1:])
    first, last = own[:len(least)], own[width:width + len(least)]
    return np.flatnonzero(((least == first) | (least == last)) & (least != _NONE))


def _near_pairs(contexts: np.ndarray, places: np.ndarray, nearest: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal contexts at a distance in [nearest, reach); places ascend."""
    buckets = (contexts >> np.uint64(44)).astype(np.int64)
    several = np.bincount(buckets, minlength=1 << 20)[buckets] > 1
    contexts, places = contexts[several], places[several]
    order = np.argsort(contexts, kind="stable")
    contexts, places = contexts[order], places[order]
    found, gaps, shift = [], [], 1
    while shift < len(places):
        gap = places[shift:] - places[:-shift]
        near = (contexts[shift:] == contexts[:-shift]) & (gap < reach)
        if not near.any():
            break
        near &= gap >= nearest
        found.append(places[:-shift][near])
        gaps.append(gap[near])
        shift += 1
    none = np.empty(0, np.int64)
    return (np.concatenate(found), np.concatenate(gaps)) if found else (none, none)


def _repeats_of_one(codes: np.ndarray) -> np.ndarray:
    """Stretches of one repeated word, as rows (start, end, 1)."""
    same = np.concatenate([[False], codes[1:] == codes[:-1], [False]]).astype(np.int8)
    turns = np.flatnonzero(np.diff(same))
    return np.column_stack([turns[::2], turns[1::2] + 1, np.ones(len(turns) // 2, np.int64)])


def _seams(codes: np.ndarray, regions: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) that pairs of meeting regions of one small period propose."""
    long = regions[regions[:, 1] - regions[:, 0] >= 3 * width]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    places, periods = [], []
    meeting = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[1:, 0] > long[:-1, 0])
                             & (long[1:, 0] <= long[:-1, 1]))
    for i in meeting:
        (a1, b1, q), (a2, _, _) = long[i].tolist(), long[i + 1].tolist()
        word, tail = codes[a2:a2 + q], codes[b1 - 2 * q:b1]
        turn = next((t for t in range(q) if np.array_equal(tail[t:t + q], word)), None)
        if turn is None:
            continue
        wanted = np.arange(3 * width, 6 * width, dtype=np.int64)
        wanted = wanted[(wanted - (a2 - (b1 - 2 * q + turn))) % q == 0]
        places.append(np.maximum(a1, a2 - wanted))
        periods.append(wanted)
    none = np.empty(0, np.int64)
    return (np.concatenate(places), np.concatenate(periods)) if places else (none, none)


def _extended(names: list[np.ndarray], x: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The stretches (start, end, period) around proposals that hold the period twice."""
    inside = x + period < len(names[0])
    x, period = x[inside], period[inside]
    start = x - _common_before(names, x, x + period)
    end = x + period + _common_after(names, x, x + period)
    rows = np.column_stack([start, end, period])[end - start >= 2 * period]
    return _smallest_periods(rows)


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """One row per (start, end), of its smallest period; sorted."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def _marked(regions: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which windows of ``width`` words lie in a region."""
    long = regions[regions[:, 1] - regions[:, 0] >= width]
    border = np.zeros(n + 1, np.int64)
    np.add.at(border, long[:, 0], 1)
    np.add.at(border, long[:, 1] - width + 1, -1)
    return np.cumsum(border[:n]) > 0


def _runs(codes: np.ndarray, owners: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Runs (start, end, period) of documents of descending sizes with separators between them."""
    longest = int(sizes[0])
    names = window_names(codes, longest, seed)
    ends = np.cumsum(sizes + 1)
    found = _repeats_of_one(codes)
    scale = 1
    while 1 << scale <= max(2, longest // 6) and scale + 1 < len(names):
        width = 1 << scale
        n = int(ends[np.count_nonzero(sizes >= max(LEAST, 6 * width)) - 1])
        small = found[3 * found[:, 2] <= width]
        places = synchronising_positions(names, scale, n, _marked(small, width, len(codes)))
        places = places[places + 2 * width <= n]
        contexts = mixed_bits(names[scale + 1][places] + owners[places] * _RIGHT)
        x, period = _near_pairs(contexts, places, 1 if scale == 1 else 3 * width, 6 * width)
        seam_x, seam_period = _seams(codes, small, width)
        found = _smallest_periods(np.concatenate([found, _extended(
            names, np.concatenate([x, seam_x]), np.concatenate([period, seam_period]))]))
        scale += 1
    return found


def _holds(codes: np.ndarray, rows: np.ndarray) -> bool:
    """Whether all rows are stretches of their period that cannot be extended."""
    for start, end, period in rows.tolist():
        if not np.array_equal(codes[start:end - period], codes[start + period:end]):
            return False
        if start and codes[start - 1] == codes[start - 1 + period]:
            return False
        if end < len(codes) and codes[end] == codes[end - period]:
            return False
    return True


def runs_of(texts: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """Rows (start, length, period), sorted, of every array of word numbers.

    ``least`` is at least 12: shorter stretches need not hold a pair at the first scale.
    """
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not looked for")
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    order = sorted((i for i, t in enumerate(texts) if len(t) >= least), key=lambda i: -len(texts[i]))
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    above = max(int(texts[i].max()) for i in order) + 1
    codes = np.empty(int((sizes + 1).sum()), np.int64)
    codes[begins + sizes] = above + np.arange(len(order))
    for begin, i in zip(begins.tolist(), order):
        codes[begin:begin + len(texts[i])] = texts[i]
    owners = np.repeat(np.arange(1, len(order) + 1, dtype=np.uint64), sizes + 1)
    for seed in range(1, _ATTEMPTS + 1):
        rows = _runs(codes, owners, sizes, seed)
        if _holds(codes, rows):
            break
    else:
        raise RuntimeError("window names collide with every seed")
    rows = rows[rows[:, 1] - rows[:, 0] >= least]
    owner = np.searchsorted(begins, rows[:, 0], "right") - 1
    rows = np.column_stack([rows[:, 0] - begins[owner], rows[:, 1] - rows[:, 0], rows[:, 2]])
    cuts = np.searchsorted(owner, np.arange(len(order) + 1))
    for k, i in enumerate(order):
        if cuts[k] < cuts[k + 1]:
            part = rows[cuts[k]:cuts[k + 1]]
            out[i] = part[np.lexsort((part[:, 2], part[:, 0]))]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    border = np.zeros(len(words) + 1, np.int64)
    np.add.at(border, runs[:, 0] + runs[:, 2], 1)
    np.add.at(border, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(border[:-1]) == 0).tolist()])


def _with_runs(least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            row = 0
            while row < batch.num_rows:  # some 2**18 words at a time
                words, numbers, count = [], {}, 0
                while row + len(words) < batch.num_rows and count < _CHUNK:
                    words.append((texts[row + len(words)].as_py() or b"").split())
                    count += len(words[-1])
                yield _rows(batch.slice(row, len(words)), words, numbers, least)
                row += len(words)
    return find


def _rows(batch: pa.RecordBatch, words: list[list[bytes]], numbers: dict[bytes, int], least: int) -> pa.RecordBatch:
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in ws], np.int64) for ws in words]
    runs = runs_of(coded, least)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
    flat = np.concatenate(runs)
    listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], fields=list(_RUN)))
    texts = pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.binary()).cast(pa.string())
    return pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "runs": listed, "collapsed": texts})


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of (doc_id, text).

    ``runs`` has (start, length, period) in words, by start and period; ``collapsed`` is
    the text's words without repetitions, which keep their first period.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _with_runs(least), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text, or its words with a part repeated to the end where the id's checksum is divisible by 10.

    With ``h = crc32(doc_id as text)``, ``g = h div 10`` and ``n`` words, the word ``i``
    from ``a = g % n`` on is the word ``a + (i - a) % p`` for ``p = 1 + (n - a) div (3 + g % 8)``.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        begin = F.pmod(g, n)
        rule = F.struct(begin.alias("a"), (1 + F.floor((n - begin) / (3 + F.pmod(g, F.lit(8))))).alias("p"))
        return F.when(n > 0, let(rule, lambda r: F.array_join(F.transform(words, lambda word, i: F.when(
            i < r["a"], word).otherwise(F.get(words, (r["a"] + F.pmod(i - r["a"], r["p"])).cast("int")))), " ")))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(F.pmod(h, F.lit(10)) == 0, let(words, repeated)).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all, from ``periodic_runs``."""
    order = F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    top = F.col("top")
    return found.withColumn("top", F.array_max(order)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-top["start"]).alias("start"),
        top["length"].alias("length"), (-top["period"]).alias("period"),
        F.floor(1000 * top["length"] / (-top["period"])).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
