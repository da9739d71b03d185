"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from labelloom.llm import (
    host_words, line_dedup, mixing, near_dup, periodic_runs, phrases, pii, rans, risk_rules, templates, token_cache,
    toxicity_gru, zstd_lang)
from labelloom.llm.common import new_folder, read, staged, word_count
from labelloom.llm.sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_odd_sketch_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dup.near_duplicates(read(spark, d, "documents")).drop("text_key")


def op2_token_cache(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of every document; a cache of its own, empty at first, for every call."""
    counts = token_cache.token_counts(read(spark, d, "documents"), new_folder(spark, "token-cache"),
                                      public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > token_cache.OVER_LIMIT)


def op3_zstd_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document by compression."""
    return zstd_lang.predictions(read(spark, d, "documents"))


URL_RULES = [
    host_words.Rule("allow", "org", "/"), host_words.Rule("block", "example.org", "/es/"),
    host_words.Rule("block", "example.org", "/en/1"), host_words.Rule("allow", "com", "/fr/"),
    host_words.Rule("block", "com", "/de/"),
]


def op4_host_words(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on every page's URL."""
    return host_words.url_verdicts(read(spark, d, "pages"), URL_RULES)


def op5_cuckoo_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every document without the lines that an earlier one holds."""
    docs = read(spark, d, "documents")
    return line_dedup.LineIndex.of(docs).digests(docs)


def op6_mixing(spark: SparkSession, d: str) -> DataFrame:
    """Words that a mix by source takes of every document."""
    sizes = staged(read(spark, d, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    out = mixing.with_copies(sizes, mixing.source_targets(sizes))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("size") * F.col("copies")).alias("taken"))


def op7_rans(spark: SparkSession, d: str) -> DataFrame:
    """Every document's tokens, written to coded files and read back from them."""
    folder = new_folder(spark, "rans")
    rans.write_tokens(read(spark, d, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return rans.read_tokens(spark, folder)


def op8_templates(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold benchmark passages, also with other numbers and names."""
    return templates.contaminated(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op9_gru_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, d, "documents")
    scored = toxicity_gru.with_score(docs.select("doc_id", "text"), toxicity_gru.fit(docs, read(spark, d, "labels")))
    return scored.select(
        "doc_id", F.coalesce(~toxicity_gru.learned(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_risk_rules(spark: SparkSession, d: str) -> DataFrame:
    """Base measures of every document and the verdict of the cutoffs of its language."""
    measures = staged(risk_rules.base_measures(read(spark, d, "documents"), "lang"), "rule-measures")
    chosen = risk_rules.cutoffs(measures, read(spark, d, "labels"))
    return risk_rules.judged(measures, chosen).drop("stratum")


def op11_sync_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of them with a part repeated to the end."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    changed = docs.withColumn("text", periodic_runs.repeated_tail(F.col("doc_id"), F.col("text")))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(changed))


def op12_phrase_graph(spark: SparkSession, d: str) -> DataFrame:
    """The best phrases of each language."""
    return phrases.collocations(read(spark, d, "documents"))


def op13_pii(spark: SparkSession, d: str) -> DataFrame:
    """Personal data in every document."""
    return pii.span_digests(pii.personal_data(read(spark, d, "documents")))


QUERIES: dict[str, Query] = {
    "op1_odd_sketch_dedup": op1_odd_sketch_dedup,
    "op2_token_cache": op2_token_cache,
    "op3_zstd_language": op3_zstd_language,
    "op4_host_words": op4_host_words,
    "op5_cuckoo_lines": op5_cuckoo_lines,
    "op6_mixing": op6_mixing,
    "op7_rans": op7_rans,
    "op8_templates": op8_templates,
    "op9_gru_toxicity": op9_gru_toxicity,
    "op10_risk_rules": op10_risk_rules,
    "op11_sync_runs": op11_sync_runs,
    "op12_phrase_graph": op12_phrase_graph,
    "op13_pii": op13_pii,
}

__all__ = ["ORACLES", "QUERIES"]
