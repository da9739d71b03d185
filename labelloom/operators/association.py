"""Leakage by association: terms that give a label away, and labels named in texts.

``associated_terms`` counts once how many rows of a label hold a term; the chi-square
statistic of every (term, label) follows from that table and its margins, a term's by a
window, so that no term moves for a join. Each row's distinct terms are combined before
the shuffle, and a label's first terms are found before its rows meet in one task.

``label_mentions`` looks for all labels in a text at once, by an automaton whose work
does not grow with their number. The labels, one per class, are what is sent to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.operators import terms as T
from labelloom.session import stage


def term_label_counts(rows: DataFrame, text: Column, label: str) -> DataFrame:
    """``term, label, n``: rows of a label whose text holds a term."""
    grams = rows.select(F.col(label).alias("label"), T.tokens(text).alias("words")).select(
        "label", F.explode(F.array_distinct(T.with_bigrams(F.col("words")))).alias("term"))
    return grams.groupBy("term", "label").agg(F.count(F.lit(1)).alias("n"))


def associated_terms(rows: DataFrame, text: Column, label: str, top: int = 10,
                     min_documents: int = T.MIN_DOCUMENTS) -> DataFrame:
    """``label, rank, term, n, with_term, chi_square``: the terms that speak most for each label.

    Only terms that are more frequent in the label than elsewhere count. Rows without a
    label are left out; ties fall to the alphabetically first term.
    """
    labelled = rows.where(F.col(label).isNotNull())
    # A term's rows, one per label at most, meet once; a count per term joined to them would move them twice more.
    counts = term_label_counts(labelled, text, label).withColumn(
        "with_term", F.sum("n").over(Window.partitionBy("term"))).where(F.col("with_term") >= min_documents)
    per_label = stage(labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("size")), "label-sizes")
    total = per_label.agg(F.sum("size").alias("n")).first()["n"] or 0
    joined = counts.join(per_label, "label")
    n, df, size, everything = F.col("n") * 1.0, F.col("with_term") * 1.0, F.col("size") * 1.0, F.lit(float(total))
    off = n * everything - df * size
    spread = df * (everything - df) * size * (everything - size)
    scored = joined.where(off > 0).withColumn(
        "chi_square", F.when(spread > 0, everything * off * off / spread).otherwise(0.0))
    order = Window.partitionBy("label").orderBy(F.desc("chi_square"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "label", "rank", "term", "n", "with_term", "chi_square")


def _labels_in(labels: list[tuple[str, str]]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for label, wanted in labels:
            automaton.add_word(wanted, [*automaton.get(wanted, []), label])
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({x for _, names in automaton.iter(text.as_py() or "") for x in names})
                     for text in batch.column("text")]
            yield pa.record_batch({"label": batch.column("label"), "found": pa.array(found, pa.list_(pa.string()))})
    return find


def label_mentions(rows: DataFrame, text: Column, label: str) -> DataFrame:
    """``label, mentioned, n``: rows of a label whose text names a label, in any case of letters.

    Every label that occurs in ``rows`` is looked for in every text, the empty label and
    null aside. A null text names none.
    """
    names = rows.select(F.col(label).alias("label")).where(F.length(label) > 0).distinct().select(
        "label", F.lower("label").alias("wanted")).collect()
    if not names:
        return rows.select(F.col(label).alias("label"), F.lit("").alias("mentioned"), F.lit(0).cast("long").alias("n")).limit(0)
    found = rows.select(F.col(label).alias("label"), F.lower(text).alias("text")).mapInArrow(
        _labels_in([tuple(r) for r in names]), "label string, found array<string>")
    return found.select("label", F.explode("found").alias("mentioned")).groupBy("label", "mentioned").agg(
        F.count(F.lit(1)).alias("n"))
