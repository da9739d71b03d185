"""Language by compression: the language whose dictionary makes a text smallest.

Every language has a zstandard raw-content dictionary made of its training texts.
A text in lower case is cut into blocks, all of it, and every block is compressed
with every dictionary; the language with the fewest bytes over all blocks is
predicted. The score is the winner's share when a byte more divides a language's weight by a fixed
factor, per block so that long texts are not certain by length alone. Predictions
whose margin over the second language is below ``MIN_MARGIN`` of the winner's bytes
are flagged ``rejected``.

Training uses a bounded sample: in each of ``BUCKETS`` hash buckets of a language
the document with the smallest hash, and of the texts in hash order the first
``DICTIONARY_BYTES`` bytes. Everything else covers all texts.

Defined results: a null text and a text without a letter are ``und`` with score 0
and rejected; without any training text so is everything; null languages are not
learned; ties go to the language that sorts first; an empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.memories import remembered

BUCKETS = 128
DICTIONARY_BYTES = 192 << 10
BLOCK_BYTES = 2048
MIN_MARGIN = 0.01
UNDETERMINED = "und"
_LEVEL = 6
_BYTES_PER_E = 4.0
_LETTER = re.compile(r"[^\W\d_]")
_PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def training_sample(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, h, text): at most ``buckets`` texts per language, none held out.

    No more of a text is sent than a dictionary can hold.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                      & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit("zstd"), "doc_id")
    picked = rows.select("lang", "doc_id", order.alias("h")).groupBy(
        "lang", F.pmod("h", F.lit(buckets)).alias("bucket")).agg(
        F.min(F.struct("h", "doc_id")).alias("first")).select("lang", "first.doc_id", "first.h")
    return rows.select("lang", "doc_id", "text").join(F.broadcast(picked), ["lang", "doc_id"]).select(
        "lang", "h", F.substring("text", 1, DICTIONARY_BYTES).alias("text"))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Raw dictionary content per language. What comes to the driver is the bounded sample."""
    rows = training_sample(docs).orderBy("lang", "h").toArrow()
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
        texts.setdefault(lang, []).append(text.lower().encode())
    return {lang: b"\n".join(parts)[:DICTIONARY_BYTES] for lang, parts in sorted(texts.items())}


class Classifier:
    def __init__(self, contents: dict[str, bytes]):
        import zstandard

        self.languages = sorted(contents)
        self._compress = []
        for lang in self.languages:
            data = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=_LEVEL)
            self._compress.append(zstandard.ZstdCompressor(
                level=_LEVEL, dict_data=data, write_checksum=False, write_content_size=False,
                write_dict_id=False).compress)

    def sizes(self, text: str) -> tuple[np.ndarray, int]:
        """Compressed bytes per language over all blocks, and the number of blocks."""
        data = text.lower().encode()
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return np.array([sum(len(c(b)) for b in blocks) for c in self._compress], np.float64), len(blocks)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin and whether the margin is too narrow."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0, True
        sizes, blocks = self.sizes(text)
        best = int(sizes.argmin())
        gaps = (sizes - sizes[best]) / (blocks * _BYTES_PER_E)
        score = 1.0 / float(np.exp(-gaps).sum())
        others = np.delete(sizes, best)
        margin = float((others.min() - sizes[best]) / sizes[best]) if len(others) else math.inf
        return self.languages[best], score, margin, margin < MIN_MARGIN


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) for every row."""
    contents = docs.sparkSession.sparkContext.broadcast(tuple(dictionaries(docs).items()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = remembered(("languages", contents.value), lambda: Classifier(dict(contents.value)))
        for batch in batches:
            found = [classifier.predict(t) for t in batch.column("text").to_pylist()]
            lang, score, margin, rejected = zip(*found) if found else ((), (), (), ())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                "margin": pa.array(margin, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(predict, _PREDICTION)
