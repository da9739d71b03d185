"""A corpus made ready for training: stages over ``documents``, each by one operator.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of ``docs``; its
result is written as Parquet and read back as the next one's ``docs``. The last one
returns what is in the coded token files that it wrote and read back.

Defined results hold as the operators state them. In particular: rows without an id
are neither near copies nor contaminated and stay; rows of a repeated id are judged by
their own texts, and of those with equal texts one stays; a null text is clean; copies that
the mix emits are documents of the same id in the token files; a label or benchmark
table without rows changes nothing; an empty ``documents`` gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import mixing, near_dup, rans, templates, toxicity_gru
from labelloom.llm.common import new_folder, prepared, read, staged, unused_name, word_count

ORACLE_SQL = None  # a trained network decides in the first stage
TOKENIZER = "byte_bpe_50k.json"
NEAR_PERCENT = 80


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that tells the texts of a repeated id apart, in a column of an unused name."""
    key = unused_name(docs.columns, "text_key")
    return docs.withColumn(key, F.xxhash64("text")), key


def _among(rows: DataFrame, key: str, marked: DataFrame, how: str) -> DataFrame:
    """Rows whose id and text are among ``marked`` (doc_id, text_key), or are not."""
    names = marked.select(F.col("doc_id").alias("marked_id"), F.col("text_key").alias("marked_key"))
    return rows.join(names, (rows["doc_id"] == names["marked_id"]) & (rows[key] == names["marked_key"]), how)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the trained network does not find toxic."""
    prepared(spark)
    return toxicity_gru.tolerated(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, the one of the smallest id.

    Copies are near from a similarity of 0.8 on; a pair at 0.8 misses all bands with a
    probability of ``(1 - 0.8**5)**24``, 7e-5.

    Rows are judged by id and text: the texts of a repeated id are apart, and of rows that
    are equal in both one stays.
    """
    prepared(spark)
    found = staged(near_dup.near_duplicates(docs, percent=NEAR_PERCENT).where(F.col("doc_id").isNotNull()).groupBy(
        "doc_id", "text_key").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near-rows")
    rows, key = _with_key(docs)
    equal = found.where(F.col("kept") & (F.col("n") > 1))
    left = _among(rows, key, found.where(~F.col("kept") | (F.col("n") > 1)), "left_anti")
    if not equal.isEmpty():
        left = left.unionByName(_among(rows, key, equal, "left_semi").dropDuplicates(["doc_id", key]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, also not with other numbers or names."""
    prepared(spark)
    found = templates.contaminated_texts(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", F.col("doc_key").alias("text_key")).distinct()
    rows, key = _with_key(docs)
    return _among(rows, key, found, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    prepared(spark)
    return mixing.mixed(docs, word_count(F.col("text")))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens as the coded files give them back."""
    prepared(spark)
    folder = new_folder(spark, "corpus-tokens")
    rans.write_tokens(docs, folder, public_tokenizers.path(TOKENIZER))
    return rans.read_tokens(spark, folder)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
