"""Token counts through a cache of content digests.

A text is normalised (white space runs become one space, none at the ends), which
no tokenizer that drops white space can see, and digested. Digests are joined to
the counts stored for this version of the tokenizer's file; only distinct texts
without a stored count are encoded, and their counts are appended to the cache.

The cache is a Parquet folder (digest, tokenizer, n_tokens). A crashed or repeated
append can only add rows that say the same, so readers take one row per digest.
Texts never meet by key: one document per unknown digest is chosen on narrow rows,
and a copy of it that shares id and text is skipped in the task that reads it.

Defined results: a null text counts as empty; documents without an id, and several
documents of one id, are counted each; an empty table gives no rows. Other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import SPACE_RUN, staged
from labelloom.llm.tokenizing import chunk_encoder, file_digest

OVER_LIMIT = 2048
_ENTRY = "digest binary, tokenizer string, n_tokens long"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "))


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _distinct_counts(path: str):
    """Counts of a partition's texts, each digest once while it is remembered."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(path, keep_spaces=False)
        seen: set[bytes] = set()
        for batch in batches:
            digests, texts = [], []
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    texts.append(text or "")
            if len(seen) > 100_000:
                seen.clear()
            yield pa.record_batch({"digest": pa.array(digests, pa.binary()),
                                   "n_tokens": pa.array(encoder.counts(texts), pa.int64())})
    return count


def stored_counts(spark, folder: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty when the folder is new."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(_ENTRY).parquet(folder)
    except AnalysisException:
        rows = spark.createDataFrame([], _ENTRY)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, folder: str, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs``; fills the cache in ``folder``.

    The tokenizer must be one that drops white space.
    """
    spark, version = docs.sparkSession, file_digest(tokenizer_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    digested = docs.select("doc_id", text.alias("text"), content_digest(F.col("text")).alias("digest"))
    narrow = staged(digested.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")),
                    "token-digests")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    misses = narrow.join(stored_counts(spark, folder, version), "digest", "left_anti").groupBy(
        "digest").agg(F.min(key).alias("key"))
    chosen = digested.withColumn("key", key).join(misses.hint("shuffle_hash"), ["digest", "key"])
    found = chosen.select("digest", "text").mapInArrow(
        _distinct_counts(tokenizer_path), "digest binary, n_tokens long")
    found.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(folder)
    return narrow.join(stored_counts(spark, folder, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens")
