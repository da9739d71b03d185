"""Phrases of words by a weighted de Bruijn graph of their four-word windows.

Texts are cut into pieces at punctuation and line ends, and into words with A-Z
lower-cased; each language is a graph of its own. Nodes are windows of three words, the
edge between two that overlap is a window of four, its weight the number of occurrences.

1. Links. Each pair of neighbouring words adds to one of 2**24 saturating counters, task
   by task; the counters' blocks are then summed as streams. What reaches ``least`` is a
   bitmap of 2 MB at every size of the input. A pair whose counter stays below ``least``
   is in no phrase that occurs so often, so pieces are cut there: the windows that are lost
   occur too rarely, and the words at the cut count as ends of pieces.
2. Edges and ends. Each task adds up its four-word windows and, per piece that the cuts
   leave, its last three words (or all, if fewer). They are summed by key.
3. Flow. What occurs of a node is what leaves it over its edges plus the pieces that end
   in it. The same holds one word shorter: a pair is continued by a third word or is
   the end of a piece, and so is a word. So the counts of three, two and one words follow
   from edges and ends, and no text is read again.
4. Paths. A node through which all of one edge goes on to one edge is no junction. Edges
   of ``least`` and more are joined there to unary paths by pointer doubling.
5. Phrases. A phrase of two to four words is scored by its weakest cut, and dropped when a
   longer one that contains it has ``CONTAINED_PERCENT`` of its occurrences. What contains
   a phrase of two or three words is read off the paths, which hold every word once.
6. The first of each language are found within salted parts first, so that no task sorts
   a whole language; the second step sees ``top`` rows of each of 64 parts.

Numbers are exact: the score's product is a decimal of 38 digits.

Defined results: a null text is an empty one and adds nothing; a null language is ``und``;
rows with a repeated or no id count like all others; a piece of one word adds that word;
of equal scores and counts the phrase that is smaller in UTF-8 goes first; an empty table
gives no rows. A task holds a chunk of texts, or one longer text, and about ``_HELD`` keys.
Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelloom.llm.common import staged
from labelloom.llm.shingles import mixed_bits, word_hashes

LEAST = 30
TOP = 2000
LONGEST = 4
CONTAINED_PERCENT = 80
LINK_BITS = 24
_BLOCK = 1 << 14
_CHUNK = 4 << 20
_HELD = 400_000
_SALTS = 64
_CUT = b"\xff"  # in no UTF-8 text
_TABLE = bytes(255 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b
               for b in range(256))
_F0, _F1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Chunk:
    """Words of some texts of one language, with marks between pieces.

    ``inside[i]`` tells that i is a word, ``joined[i]`` that it and the next share a piece.
    """
    lang: str
    words: list[bytes]
    inside: np.ndarray
    joined: np.ndarray
    links: np.ndarray


def _chunk(lang: str, texts: list[bytes]) -> Chunk:
    spaced = _CUT.join(texts).translate(_TABLE).replace(_CUT, b" \xff ")
    words = spaced.split()
    words.append(_CUT)
    hashes = word_hashes(words)
    inside = np.fromiter(map(_CUT.__ne__, words), bool, len(words))
    joined = np.append(inside[:-1] & inside[1:], False)
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    links = mixed_bits(hashes[:-1] * _F0 + hashes[1:] * _F1 + seed) >> np.uint64(64 - LINK_BITS)
    return Chunk(lang, words, inside, joined, np.append(links, np.uint64(0)).astype(np.int64))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Texts of a language in chunks of some megabytes, a longer text in a chunk of its own."""
    held: dict[str, list[bytes]] = {}
    sizes: Counter = Counter()
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            text = text.as_py()
            held.setdefault(lang, []).append(text)
            sizes[lang] += len(text) + 1
            if sizes[lang] >= _CHUNK or sizes.total() >= 4 * _CHUNK:
                yield _chunk(lang, held.pop(lang))
                del sizes[lang]
    for lang, texts in held.items():
        yield _chunk(lang, texts)


def _counted_links(least: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = min(255, least)
        total = np.zeros(1 << LINK_BITS, np.uint8)
        for chunk in _chunks(batches):
            places, times = np.unique(chunk.links[chunk.joined], return_counts=True)
            total[places] = np.minimum(total[places] + times, most)
        blocks = total.reshape(-1, _BLOCK)
        used = np.flatnonzero(blocks.any(axis=1)).tolist()
        yield pa.record_batch({"block": pa.array(used, pa.int64()), "counts": pa.array(
            [pa.compress(blocks[i].tobytes(), "lz4_raw", asbytes=True) for i in used], pa.binary())})
    return count


def _summed_links(least: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = min(255, least)
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(pa.decompress(packed, _BLOCK, "lz4_raw", asbytes=True), np.uint8)
                total = blocks.get(block)
                blocks[block] = counts if total is None else np.minimum(
                    total.astype(np.uint16) + counts, most).astype(np.uint8)
        yield pa.record_batch({"block": pa.array(list(blocks), pa.int64()), "bits": pa.array(
            [np.packbits(b >= most).tobytes() for b in blocks.values()], pa.binary())})
    return add


def heavy_links(pieces: DataFrame, least: int) -> bytes:
    """A bit per counter that pairs may reach ``least`` in; 2 MB, whatever the table."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = pieces.mapInArrow(_counted_links(least), "block long, counts binary").repartition(
        min(parts, (1 << LINK_BITS) // _BLOCK), "block").mapInArrow(_summed_links(least), "block long, bits binary")
    bits = np.zeros(((1 << LINK_BITS) // _BLOCK, _BLOCK // 8), np.uint8)
    for block, packed in blocks.collect():  # at most 1024 rows of 2 KB
        bits[block] = np.frombuffer(packed, np.uint8)
    return bits.tobytes()


def _rows(lang: str, counted: Counter) -> pa.RecordBatch:
    grams = pa.array(list(counted), pa.binary()).cast(pa.string())
    return pa.record_batch({"lang": pa.array([lang] * len(counted), pa.string()), "gram": grams,
                            "times": pa.array(list(counted.values()), pa.int64())})


def _edges_and_ends(bitmap):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
        held: dict[str, Counter] = {}
        for chunk in _chunks(batches):
            counted = held.setdefault(chunk.lang, Counter())
            words = chunk.words
            on = chunk.joined & heavy[chunk.links]
            before = np.append(False, on[:-1])  # linked to the word before
            second = np.append(False, before[:-1]) & before
            third = np.append(False, second[:-1]) & before
            edges = np.flatnonzero(third).tolist()
            counted.update(b" ".join(words[i - 3:i + 1]) for i in edges)
            last = chunk.inside & ~on
            for mask, size in ((last & second, 3), (last & before & ~second, 2)):
                counted.update(b" ".join(words[i - size + 1:i + 1]) for i in np.flatnonzero(mask).tolist())
            counted.update(map(words.__getitem__, np.flatnonzero(last & ~before).tolist()))
            if sum(map(len, held.values())) > _HELD:
                for lang, part in held.items():
                    yield _rows(lang, part)
                held = {}
        for lang, part in held.items():
            yield _rows(lang, part)
    return grams


def _first(words: Column, size: Column | int) -> Column:
    return F.array_join(F.slice(words, 1, size), " ")


def _without_first(words: Column) -> Column:
    return F.array_join(F.slice(words, 2, F.size(words)), " ")


def _summed(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.groupBy("lang", "gram").agg(F.sum("times").alias("times"))


def graph(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, gram, times): four words are edges, fewer the ends of pieces. Pairs below ``least`` are cut."""
    pieces = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    bitmap = docs.sparkSession.sparkContext.broadcast(heavy_links(pieces, least))
    grams = pieces.mapInArrow(_edges_and_ends(bitmap), "lang string, gram string, times long")
    return staged(_summed(grams).withColumn("size", F.size(F.split("gram", " "))), "phrase-graph")


def flow(grams: DataFrame) -> DataFrame:
    """(lang, gram, times, size): occurrences of one to four words from a graph's edges and ends."""
    words = F.split("gram", " ")
    ends = {k: grams.where(F.col("size") == k).select("lang", "gram", "times") for k in range(1, LONGEST)}
    counts = {LONGEST: grams.where(F.col("size") == LONGEST).select("lang", "gram", "times")}
    last = ends[LONGEST - 1]
    for k in range(LONGEST - 1, 0, -1):
        leaving = counts[k + 1].select("lang", _first(words, k).alias("gram"), "times")
        counts[k] = staged(_summed(leaving, last), f"phrase-flow-{k}")
        if k > 1:  # a piece that ends in k words ends in its last k - 1
            last = _summed(last.select("lang", _without_first(words).alias("gram"), "times"), ends[k - 1])
    out = counts[LONGEST].withColumn("size", F.lit(LONGEST))
    for k in range(1, LONGEST):
        out = out.unionByName(counts[k].withColumn("size", F.lit(k)))
    return out


def unary_paths(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, times): edges of ``least`` and more, joined at nodes that are no junctions.

    A node is inner if one edge brings all of its occurrences and one takes all of them
    on. Every text ends, so inner nodes form no circle. Each edge points to the one after it
    and doubles its reach until all point to their path's last edge; the rounds grow with
    the logarithm of the longest path.
    """
    words = F.split("gram", " ")
    edges = counts.where((F.col("size") == LONGEST) & (F.col("times") >= least)).select(
        "lang", "gram", "times", _first(words, LONGEST - 1).alias("source"), _without_first(words).alias("target"))
    edges = staged(edges, "phrase-edges")
    nodes = counts.where((F.col("size") == LONGEST - 1) & (F.col("times") >= least)).select(
        "lang", F.col("gram").alias("node"), "times")
    coming = edges.select("lang", "times", F.col("target").alias("node"), F.col("gram").alias("edge"))
    going = edges.select("lang", "times", F.col("source").alias("node"), F.col("gram").alias("next"))
    after = nodes.join(coming, ["lang", "node", "times"]).join(going, ["lang", "node", "times"])
    reach = staged(edges.select("lang", F.col("gram").alias("edge"), "times").join(
        after.select("lang", "edge", "next"), ["lang", "edge"], "left").select(
        "lang", "edge", "times", F.coalesce("next", "edge").alias("end"),
        F.col("next").isNotNull().cast("long").alias("steps")), "phrase-reach")
    while True:
        far = reach.select("lang", F.col("edge").alias("end"), F.col("end").alias("beyond"),
                           F.col("steps").alias("more"))
        longer = staged(reach.join(far, ["lang", "end"]).select(
            "lang", "edge", "times", F.col("beyond").alias("end"), (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("more") > 0).alias("moved")), "phrase-reach")
        moved = not longer.where("moved").isEmpty()
        reach = longer.drop("moved")
        if not moved:
            break
    path = F.reverse(F.array_sort(F.collect_list(F.struct("steps", "edge"))))["edge"]
    joined = F.concat(F.array(path[0]), F.transform(
        F.slice(path, 2, F.greatest(F.size(path) - 1, F.lit(0))), lambda e: F.element_at(F.split(e, " "), -1)))
    return reach.groupBy("lang", "end").agg(F.array_join(joined, " ").alias("phrase"),
                                            F.min("times").alias("times")).select("lang", "phrase", "times")


def _containers(paths: DataFrame, candidates: DataFrame) -> DataFrame:
    """(lang, phrase, around): the most occurrences of a longer phrase that contains a phrase."""
    def parts(table: DataFrame, size: int) -> DataFrame:
        words = F.split("phrase", " ")
        places = F.sequence(F.lit(1), F.size(words) - size + 1)
        return table.select("lang", F.col("times").alias("around"), F.explode(F.array_distinct(F.transform(
            places, lambda i: F.array_join(F.slice(words, i, size), " ")))).alias("phrase"))

    triples = candidates.where(F.col("size") == 3).select("lang", "phrase", F.col("a").alias("times"))
    both = parts(paths, 3).unionByName(parts(paths, 2)).unionByName(parts(triples, 2))
    return both.groupBy("lang", "phrase").agg(F.max("around").alias("around"))


def scored(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of every phrase of ``least`` occurrences, by its weakest cut."""
    often = counts.where(F.col("times") >= least)
    candidates = often.where(F.col("size") > 1).select(
        "lang", F.col("gram").alias("phrase"), "size", F.col("times").alias("a"))
    words = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "*", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("right"))
    for end, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(often.select("lang", F.col("gram").alias(end), F.col("times").alias(name)), ["lang", end])
    score = F.expr("cast((cast(2000000 as decimal(18, 0)) * cast(a as decimal(19, 0))) "
                   "div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as bigint)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select(
        "lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def _ranked(table: DataFrame, top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = table.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(
        F.col("rank") <= top).drop("salt", "rank")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language."""
    counts = flow(graph(docs, least))
    often = staged(counts.where(F.col("times") >= least), "phrase-counts")
    candidates = scored(often, least)
    around = _containers(unary_paths(often, least), candidates)
    free = candidates.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < CONTAINED_PERCENT * F.col("a")))
    words = counts.where(F.col("size") == 1).groupBy("lang").agg(F.sum("times").alias("n"))
    return _ranked(free, top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
