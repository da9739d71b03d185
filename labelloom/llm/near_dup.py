"""Near-duplicate groups: MinHash bands, odd sketches, links confirmed on full sets.

1. A text becomes the set of its distinct 5-word shingles (64-bit hashes), 120
   MinHash samples and an odd sketch: every sample toggles one of 512 bits, so two
   sketches differ where samples differ. With ``d`` differing samples of 120 about
   ``256 * (1 - exp(-d / 128))`` bits differ, and a count of bits gives the similarity.
2. Texts with equal sets are one class; only its smallest id goes on.
3. Samples are grouped to 24 bands of 5. A pair at the threshold of 0.85 misses all
   bands with a probability of ``(1 - 0.85**5)**24``, below 1e-6.
4. In a bucket every member is compared with one hub, the member that shares most
   buckets with others, which joins a group of copies with linear work. Members of
   one bucket that are still in different components are then compared with each
   other. So no pair that shares a bucket is left out, and none is formed inside a
   group that is joined already.
   What is left of a bucket may still be many texts that are not alike. It is cut into
   slices of about ``SLICE`` members, and every pair of slices is a task's share, so no
   task compares a whole bucket; their number grows with the square of its members.
5. A compared pair passes on if its sizes allow a link, if its sketches differ in no more
   bits than all but 1e-12 of the pairs at the threshold do, and if the parity bitmaps of
   the whole sets, folded the same way, differ in no more bits than the sets of a link may
   differ in elements. The last is a bound that no link breaks, and a sharp one for sets
   of a few hundred. What passes is confirmed on the whole shingle sets.

Classes are named by their smallest id; of several texts of one repeated id those that
are smallest in their class count as linked, and each row has the component of its
text. Rows without an id link with nothing and have no component. Texts without words have an empty set and link with nothing. An
empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import staged
from labelloom.llm.components import components
from labelloom.llm.shingles import mixed_bits, shingle_set

THRESHOLD_PERCENT = 85
BANDS = 24
ROWS = 5
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
PARITY_WORDS = 16
PARITY_BITS = 64 * PARITY_WORDS
MISSED = 1e-12
SLICE = 1000

_SEEDS = mixed_bits(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FEATURES = ("doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, sketch array<long>, "
             "parity array<long>")
_CHUNK = 1 << 18


def minhash(shingles: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Samples of several non-empty sets in one array; ``borders`` are their starts."""
    out = np.empty((SAMPLES, len(borders)), np.uint64)
    for i, seed in enumerate(_SEEDS):
        x = shingles * seed
        x ^= x >> np.uint64(32)
        out[i] = np.minimum.reduceat(x, borders)
    return out.T


def _parity_words(flat: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """64-bit words of the parity of hits; ``flat`` is ``row * bits + bit`` of every hit."""
    hits = np.bincount(flat.ravel(), minlength=rows * bits)
    odd = (hits & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1).view("<u8").astype(np.uint64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """One row of words per row of samples."""
    place = (mixed_bits(samples + _SEEDS) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return _parity_words(place + np.arange(len(samples))[:, None] * SKETCH_BITS, len(samples), SKETCH_BITS)


def parity_bitmaps(shingles: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same folding of whole sets: two bitmaps differ in no more bits than the sets."""
    place = (shingles % np.uint64(PARITY_BITS)).astype(np.int64)
    return _parity_words(place + np.repeat(np.arange(len(sizes)), sizes) * PARITY_BITS, len(sizes), PARITY_BITS)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number is part of the key."""
    grid = samples.reshape(len(samples), BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F)
    for i in range(ROWS):
        total = mixed_bits(total + grid[:, :, i])
    return total


def most_differing_bits(percent: int) -> int:
    """Bits in which the sketches of a pair with this similarity differ, but for ``MISSED`` of such pairs.

    Each differing sample changes two bits at most, and their number is binomial.
    """
    apart, tail, samples = 1 - percent / 100, 0.0, SAMPLES
    while samples > 0:
        tail += math.comb(SAMPLES, samples) * apart ** samples * (1 - apart) ** (SAMPLES - samples)
        if tail > MISSED:
            break
        samples -= 1
    return 2 * samples


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        row = 0
        while row < batch.num_rows:  # a few texts at a time, so that memory stays bounded
            sets, size = [], 0
            while row + len(sets) < batch.num_rows and size < _CHUNK:
                sets.append(shingle_set(texts[row + len(sets)].as_py()))
                size += len(sets[-1])
            yield _feature_rows(batch.slice(row, len(sets)), sets)
            row += len(sets)


def _feature_rows(batch: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    bands: list = [None] * len(sets)
    sketches: list = [None] * len(sets)
    parities: list = [None] * len(sets)
    if len(full):
        borders = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        shingles = np.concatenate([sets[i] for i in full])
        samples = minhash(shingles, borders)
        for i, band, sketch, parity in zip(full, *[x.view(np.int64).tolist() for x in (
                band_keys(samples), odd_sketches(samples), parity_bitmaps(shingles, sizes[full]))]):
            bands[i], sketches[i], parities[i] = band, sketch, parity
    digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
    return pa.record_batch({
        "doc_id": batch.column("doc_id").cast(pa.int64()), "text_key": batch.column("text_key").cast(pa.int64()),
        "n_shingles": pa.array(sizes),
        "digest": pa.array(digests, pa.binary()),
        "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.list_(pa.int64())),
        "parity": pa.array(parities, pa.list_(pa.int64()))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text in zip(batch.column("doc_id"), batch.column("text")):
            yield pa.record_batch({"doc_id": pa.array([key.as_py()], pa.int64()),
                                   "shingles": pa.array([shingle_set(text.as_py()).tobytes()], pa.binary())})


def _confirmed(percent: int):
    """Pairs whose whole sets reach the threshold."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch.column("set_u"), batch.column("set_v"))):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * common >= percent * (len(a) + len(b) - common):
                    kept.append(i)
            yield batch.select(["u", "v"]).take(pa.array(kept, pa.int64()))
    return confirm


def _differing(a: str, b: str, words: int) -> Column:
    """Bits in which two arrays of words differ, unrolled so that it is compiled."""
    bits = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(words)]
    return reduce(Column.__add__, bits)


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes, sketches and bitmaps that allow a link; ``a`` and ``b`` end the column names."""
    least, most = F.least(f"n{a}", f"n{b}"), F.greatest(f"n{a}", f"n{b}")
    # |A or B| = (|A| + |B| + d) / 2 for d differing elements
    bound = (100 - percent) * (F.col(f"n{a}") + F.col(f"n{b}"))
    return ((100 * least >= percent * most)
            & (_differing(f"sketch{a}", f"sketch{b}", SKETCH_WORDS) <= most_differing_bits(percent))
            & ((100 + percent) * _differing(f"parity{a}", f"parity{b}", PARITY_WORDS) <= bound))


def _linked(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (u, v) that are links."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary")
    sets = staged(sets, "dedup-sets")
    both = pairs
    for end in ("v", "u"):
        both = both.join(sets.select(F.col("doc_id").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    return staged(both.mapInArrow(_confirmed(percent), "u long, v long"), "dedup-links")


def _side(classes: DataFrame, end: str) -> DataFrame:
    return classes.select(F.col("rep").alias(end), F.col("n_shingles").alias(f"n_{end}"),
                          F.col("sketch").alias(f"sketch_{end}"), F.col("parity").alias(f"parity_{end}"))


def _with_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        pairs = pairs.join(_side(classes, end), end)
    return pairs


def _sliced(members: DataFrame) -> DataFrame:
    """Members of buckets with their ``slice``, once per pair (``low``, ``high``) that it is part of."""
    sizes = members.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    own = members.join(sizes, "bucket").withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int"))
    paired = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return paired.select("bucket", "rep", "root", "slice", F.least("slice", "other").alias("low"),
                         F.greatest("slice", "other").alias("high"))


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) for every row of ``docs``.

    ``text_key`` is ``xxhash64(text)`` and tells the rows of a repeated id apart.
    """
    features = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                                  F.xxhash64("text").alias("text_key")).mapInArrow(
        _features, _FEATURES), "dedup-features")
    usable = features.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = staged(usable.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.first("parity").alias("parity")), "dedup-classes")

    rows = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
    members = staged(rows.join(shared, "bucket"), "dedup-members")

    # one hub per bucket: the member that meets most others over all its buckets
    meets = members.groupBy("rep").agg(F.sum("members").alias("meets"))
    hubs = members.join(meets, "rep").groupBy("bucket").agg(
        F.max(F.struct(F.col("meets"), (-F.col("rep")).alias("id"))).alias("top")).select(
        "bucket", (-F.col("top.id")).alias("hub"))
    to_hub = members.join(hubs, "bucket").where(F.col("rep") != F.col("hub")).select(
        F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct()
    pairs = staged(_with_classes(to_hub, classes).where(
        _alike("_u", "_v", percent)).select("u", "v"), "dedup-pairs")
    links = _linked(pairs, docs, percent)
    roots = components(links)  # a node without a link needs no root

    placed = members.select("bucket", "rep").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    open_buckets = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where(
        F.col("a") != F.col("b")).select("bucket")
    rest = staged(_sliced(placed.join(open_buckets, "bucket")), "dedup-open")
    sides = [rest.select("bucket", "low", "high", F.col("slice").alias(f"slice_{end}"), F.col("rep").alias(end),
                         F.col("root").alias(f"root_{end}")).join(_side(classes, end), end) for end in ("u", "v")]
    # members of one slice meet once, where it is paired with itself
    once = (F.col("slice_u") != F.col("slice_v")) | (sides[0]["low"] == sides[0]["high"])
    meeting = [sides[0][c] == sides[1][c] for c in ("bucket", "low", "high")]
    crossing = sides[0].join(sides[1], meeting + [once & (F.col("u") < F.col("v")) & (
        F.col("root_u") != F.col("root_v")) & _alike("_u", "_v", percent)]).select("u", "v").distinct()
    more = staged(crossing.join(pairs, ["u", "v"], "left_anti"), "dedup-more-pairs")
    if not more.isEmpty():
        roots = components(links.unionByName(_linked(more, docs, percent)))

    found = features.select("doc_id", "text_key", "n_shingles", "digest").join(
        classes.select("digest", "rep"), "digest", "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("root", "rep", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key")
