"""Quality rules whose cutoffs come with a guarantee on false rejections.

Every rule compares one measure of a text with a cutoff from a fixed ladder,
loosest first. Labelled good documents are the holdout. For a stratum, a rule and
a cutoff, ``k`` of its ``n`` good documents would be rejected, and the exact
binomial tail ``P(Bin(n, limit) <= k)`` is the p-value of "the rule rejects more
than ``limit`` of the good documents". A ladder is walked from its loosest cutoff
and stops at the first p-value above ``error / (strata * rules)``; the last cutoff
that passed is used. Walking in a fixed order needs no further correction, the
division by ladders is Bonferroni's, and ``limit`` is the total limit divided by
the number of rules. So, with probability ``1 - error``, no stratum loses more
than ``max_false_rejection`` of its good documents. All steps are DataFrame
functions.

Defined results: null text has no words and fails the base; a null stratum is a
stratum of its own; a stratum without enough good labels gets no cutoff and its
documents are kept; null labels are ignored; of several labels of a document the
lowest counts; repeated documents count as often as they occur; empty tables give
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import WORD, let

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
MAX_FALSE_REJECTION = 0.05
ERROR = 0.05


@dataclass(frozen=True)
class Rule:
    """Reject when ``measure`` is above the cutoff; the ladder goes from loose to strict."""
    name: str
    over: str
    per: str
    ladder: tuple[float, ...]

    def measure(self) -> Column:
        return F.coalesce(F.col(self.over) / F.nullif(F.col(self.per), F.lit(0)), F.lit(0.0))


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02)),
    Rule("repeated_lines", "n_dup_lines", "n_words", (0.5, 0.3, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02)),
    Rule("repeated_words", "n_repeat_words", "n_words", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("word_length", "word_chars", "n_words", (40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 8.0)),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first one included."""
    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        keys = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0))
                   .otherwise(covered(k)))

    def covered(keys: Column) -> Column:
        # sorted by key, equal windows are neighbours; their positions cover three words each
        placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        def marked(s: Column) -> Column:
            hit = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
                           | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)))
            spots = F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(spots))
        return let(placed, marked)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(words, of)).cast("long")


def base_measures(docs: DataFrame, stratum: str | None = None) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    group = F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "doc_id", group.alias("stratum"), text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    counted = split.select(
        "doc_id", "stratum", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"))
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series eight places further up."""
    z = x + 8.0
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (
        1680 * F.pow(z, F.lit(7.0)))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Exact ``P(Bin(n, p) <= k)`` below the mean; 1.0 from the mean on, where it never matters.

    The terms are summed downwards from ``k``, each from the one above it.
    """
    n_, k_ = n.cast("double"), k.cast("double")
    top = F.exp(log_gamma(n_ + 1) - log_gamma(k_ + 1) - log_gamma(n_ - k_ + 1)
                + k_ * math.log(p) + (n_ - k_) * math.log1p(-p))
    odds = (1 - p) / p

    def down(state: Column, i: Column) -> Column:
        term = state["term"] * (k_ - i + 1) / (n_ - k_ + i) * odds
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(
            F.array().cast("array<bigint>")),
        F.struct(top.alias("term"), top.alias("total")), down, lambda s: s["total"])
    return F.when(k_ < n_ * p, total).otherwise(1.0)


def cutoffs(measures: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES,
            max_false_rejection: float = MAX_FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """(stratum, rule, cutoff): the strictest safe cutoff; no row where none is safe.

    Documents that fail the base are not part of the holdout: the verdict on them
    does not come from here.
    """
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality")).where(F.col("quality") == 1).select("doc_id")
    held = measures.where(~F.col("base_failed")).join(good, "doc_id")
    steps = [(r, i, c) for r in rules for i, c in enumerate(r.ladder)]
    counts = held.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(r.measure() > c).alias(f"k_{r.name}_{i}") for r, i, c in steps])
    ladders = F.array(*[F.struct(
        F.lit(r.name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"),
        F.col(f"k_{r.name}_{i}").alias("k")) for r, i, c in steps])
    strata = counts.agg(F.count(F.lit(1)).alias("strata"))
    limit = max_false_rejection / len(rules)
    tested = counts.crossJoin(F.broadcast(strata)).select(
        "stratum", "strata", "n", F.inline(ladders)).withColumn(
        "passed", binomial_tail(F.col("k"), F.col("n"), limit)
        <= F.lit(error) / (F.col("strata") * len(rules)))
    walked = tested.groupBy("stratum", "rule").agg(
        F.min(F.when(~F.col("passed"), F.col("step"))).alias("stop"),
        F.collect_list(F.struct("step", "cutoff")).alias("ladder"))
    last = F.coalesce(F.col("stop"), F.size("ladder")) - 1
    return walked.where(last >= 0).select(
        "stratum", "rule", F.get(F.array_sort("ladder"), last)["cutoff"].alias("cutoff"))


def judged(measures: DataFrame, chosen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measures`` with ``kept``: passes the base and every cutoff of its stratum."""
    wide = chosen.groupBy(F.col("stratum").alias("c_stratum")).agg(*[
        F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"c_{r.name}") for r in rules])
    joined = measures.join(wide, measures["stratum"].eqNullSafe(wide["c_stratum"]), "left")
    rejected = F.lit(False)
    for r in rules:
        rejected = rejected | F.coalesce(r.measure() > F.col(f"c_{r.name}"), F.lit(False))
    return joined.select(
        *[measures[c] for c in measures.columns],
        (~F.col("base_failed") & ~rejected).alias("kept"))
