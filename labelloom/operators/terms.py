"""Tokens, vocabulary and TF-IDF weights as tables."""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.operators.word_lists import COUNTS, bucket_counter, term_counter
from labelloom.session import stage

# Fixed limits of the vocabulary.
MAX_FEATURES = 10_000
MIN_DOCUMENTS = 2
BUCKETS = 1 << 20
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-case words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def with_bigrams(words: Column) -> Column:
    """Words followed by every pair of neighbours."""
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, pairs), F.slice(words, 2, pairs),
                                      lambda a, b: F.concat_ws(" ", a, b)))


def gram_lists(df: DataFrame, doc: str, text: Column) -> DataFrame:
    """``doc, grams``. Two projections, so the words are matched once per row."""
    return df.select(doc, tokens(text).alias("words")).select(
        doc, with_bigrams(F.col("words")).alias("grams"))


def token_counts(df: DataFrame, doc: str, text: Column) -> DataFrame:
    """Number of words and of distinct words, bigrams and distinct bigrams per document."""
    words = df.select(doc, tokens(text).alias("words"))
    grams = words.select(doc, "words", with_bigrams(F.col("words")).alias("grams"))
    return grams.select(
        doc,
        F.size("words").alias("words"),
        F.size(F.array_distinct("words")).alias("distinct_words"),
        F.size("grams").alias("grams"),
        F.size(F.array_distinct("grams")).alias("distinct_grams"),
    )


@cache
def letters() -> bytes:
    """A bit per code point that ``TOKEN`` takes for part of a word, asked of Spark itself."""
    planes = [("".join(chr(p << 16 | i) for i in range(1 << 16) if not 0xD800 <= p << 16 | i < 0xE000),) for p in range(17)]
    other = TOKEN.replace("[", "[^", 1).replace("{2,}", "+")
    kept = SparkSession.active().createDataFrame(planes, "c string").select(F.regexp_replace("c", other, "")).collect()
    bits = np.zeros(17 << 16, bool)
    bits[[ord(c) for r in kept for c in r[0]]] = True
    return np.packbits(bits).tobytes()


def lowered(text: Column) -> Column:
    """A text as its words are told: those of ``tokens`` are its runs of two and more ``letters``."""
    return F.lower(F.coalesce(text, F.lit("")))


def lowered_texts(df: DataFrame, text: Column, *carried: str) -> DataFrame:
    """``carried, lowered``: what the vocabularies take in place of gram lists; words and all neighbours are its terms."""
    return df.select(*carried, lowered(text).alias("lowered"))


def _source(grams: DataFrame) -> tuple[str, bytes | None]:
    """The column with the terms, and the letters of words where it holds texts."""
    return ("lowered", letters()) if "lowered" in grams.columns else ("grams", None)


def bucket_sums(grams: DataFrame) -> DataFrame:
    """``bucket, upper``: occurrences of all terms that hash to a bucket.

    The sum of a term's bucket is never below the term's own count. A map task sends at
    most one number per bucket, however many terms it has seen.
    """
    name, marks = _source(grams)
    own = grams.select(name).mapInArrow(bucket_counter(BUCKETS, marks), "bucket int, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias("upper"))


def _counts(grams: DataFrame, folds: int | None, buckets: DataFrame | None = None) -> DataFrame:
    """``term, corpus, documents``: counts over all rows, or outside every fold by subtraction.

    The numbers of the chosen ``buckets`` come to the driver as a bit per bucket.
    """
    name, marks = _source(grams)
    wanted = None
    if buckets is not None:
        bits = np.zeros(BUCKETS, bool)
        bits[buckets.select("bucket").toPandas()["bucket"].to_numpy(np.int64)] = True
        wanted = np.packbits(bits).tobytes()
    if folds is None:
        own = grams.select(name).mapInArrow(term_counter(BUCKETS, wanted, 1, marks), COUNTS)
        return own.groupBy("term").agg(*[F.array(F.sum(F.get(c, F.lit(0)))).alias(c) for c in ("corpus", "documents")])
    fold = F.when(F.col("fold").between(0, folds - 1), F.col("fold")).otherwise(folds).cast("int").alias("fold")
    own = grams.select(name, fold).mapInArrow(term_counter(BUCKETS, wanted, folds + 1, marks), COUNTS)
    sums = own.groupBy("term").agg(*[F.array(*[F.sum(F.get(c, F.lit(g))) for g in range(folds + 1)]).alias(c)
                                     for c in ("corpus", "documents")])
    outside = [F.array(*[reduce(Column.__add__, [F.get(c, F.lit(g)) for g in range(folds + 1) if g != f])
                         for f in range(folds)]).alias(c) for c in ("corpus", "documents")]
    return sums.select("term", *outside)


def _most_used(counts: DataFrame, groups: int, max_features: int, min_documents: int) -> DataFrame:
    """``fold, term, corpus_count, document_count`` of the first terms of every group."""
    parts = [
        counts.select(F.lit(g).alias("fold"), "term", F.get("corpus", F.lit(g)).alias("corpus_count"),
                      F.get("documents", F.lit(g)).alias("document_count"))
        .where(F.col("document_count") >= min_documents)
        .orderBy(F.desc("corpus_count"), F.asc("term")).limit(max_features)
        for g in range(groups)
    ]
    return reduce(DataFrame.unionByName, parts)


def _bounded_terms(grams: DataFrame, folds: int | None, max_features: int, min_documents: int) -> DataFrame:
    """The most used terms, counted only where a term can be one of them.

    1. Sums per hash bucket bound the count of every term in them from above.
    2. The terms of the ``2 * max_features`` largest buckets are counted exactly. If
       ``max_features`` of them qualify, the least count among those is a bound from
       below: a term that is to be chosen occurs so often at least.
    3. Where no other bucket reaches that bound, no other term does, and the choice is
       done. Else the terms of all buckets that reach it are counted as well; with too
       few qualified terms the bound is 0 and all are.

    Only counted terms are shuffled by name. Counts outside a fold are at most total
    counts, so the same sums bound every fold.
    """
    groups = 1 if folds is None else folds
    sums = stage(bucket_sums(grams), "term-buckets")
    chosen = stage(sums.orderBy(F.desc("upper"), "bucket").limit(2 * max_features), "term-buckets-first")
    rest = sums.join(chosen.select("bucket"), "bucket", "left_anti")
    counts = stage(_counts(grams, folds, chosen), "term-counts")
    tops = stage(_most_used(counts, groups, max_features, min_documents), "terms")
    found = {r["fold"]: (r["n"], r["least"]) for r in tops.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.min("corpus_count").alias("least")).collect()}
    least = min((found[g][1] if g in found and found[g][0] == max_features else 0) for g in range(groups))
    more = stage(rest.where(F.col("upper") >= least), "term-buckets-more")
    if more.isEmpty():
        return tops
    counts = counts.unionByName(_counts(grams, folds, more))
    return stage(_most_used(stage(counts, "term-counts"), groups, max_features, min_documents), "terms")


def vocabulary(grams: DataFrame, max_features: int = MAX_FEATURES,
               min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``term, corpus_count, document_count`` of the most used terms.

    ``grams`` holds ``grams``, or ``lowered`` (``lowered_texts``). Ties in corpus count fall to the
    alphabetically first term. Jobs run while the plan
    is built: see ``_bounded_terms``. Nothing is grouped by document, and a term that is
    everywhere is one row per map task.
    """
    return _bounded_terms(grams, None, max_features, min_documents).drop("fold").orderBy(
        F.desc("corpus_count"), F.asc("term"))


def fold_vocabularies(grams: DataFrame, folds: int = 5, max_features: int = MAX_FEATURES,
                      min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``fold, term, corpus_count, document_count``: the vocabulary of the rows outside each fold.

    ``grams`` carries ``fold`` and ``grams``, or ``lowered`` (``lowered_texts``). Counts are additive, so what lies outside a fold is the
    total minus the fold: all vocabularies come from the same count per term.
    """
    return _bounded_terms(grams, folds, max_features, min_documents)


def inverse_frequency(documents: Column, with_term: Column) -> Column:
    """Smoothed inverse document frequency."""
    return F.log((1 + documents) / (1 + with_term)) + 1


def tfidf_weights(grams: DataFrame, doc: str, terms: DataFrame) -> DataFrame:
    """``doc, term, weight``: sublinear TF times IDF, each document of length 1.

    The vocabulary, at most ``max_features`` rows, is collected while the plan is
    built. A document's counts, weights and norm are made inside its row, so nothing
    is exchanged by document. Terms are told by number until the last join.
    """
    documents = grams.agg(F.count(F.lit(1)).alias("n")).scalar()
    known = terms.select("term", inverse_frequency(documents, F.col("document_count")).alias("idf")).collect()
    if not known:
        return grams.select(doc, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
    counts = CountVectorizerModel.from_vocabulary([r.term for r in known], "grams", "tf")
    scale = ElementwiseProduct(inputCol="tf", outputCol="scaled", scalingVec=Vectors.dense([r.idf for r in known]))
    raw = scale.transform(counts.transform(grams.select(doc, "grams"))).select(
        doc, F.unwrap_udt("tf").alias("tf"), F.unwrap_udt("scaled").alias("scaled")).select(
        doc, F.col("tf.indices").alias("place"),
        F.zip_with("tf.values", "scaled.values", lambda n, x: (1 + F.log(n)) * x / n).alias("raw"))
    # A projection of its own: beside the generator the norm would be folded once per term.
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda total, x: total + x * x))
    rows = raw.withColumn("norm", norm).select(doc, "norm", F.inline(F.arrays_zip("place", "raw")))
    names = grams.sparkSession.createDataFrame([(i, r.term) for i, r in enumerate(known)], "place int, term string")
    return rows.join(F.broadcast(names), "place").select(doc, "term", (F.col("raw") / F.col("norm")).alias("weight"))
