"""URL verdicts: prefix rules, and naive Bayes over the words of hosts and paths.

Host and path are cut at everything but letters; numbers become one token by their
length. Letter pieces are often words written together, so each distinct piece is
split by Viterbi search over unigram probabilities. The unigrams are counted over
the visible text of all pages without the URLs in it: there words are written apart,
while a piece counted in URLs would be its own whole word. Each word of
``BLOCKED_WORDS`` counts once more. For the search, the substrings of the pieces are
joined to the counts, so no vocabulary is held anywhere and none is cut. Multinomial naive Bayes is trained on the URLs that a rule
decides, and on those of the others whose host holds a word of ``BLOCKED_WORDS``;
it decides where no rule does. All counts are over pages.

Defined results: a null URL or one without ``://`` has empty host and path, no rule,
and the prior's verdict; with no training URLs, and at a tie, the verdict is allow;
repeated rows get the same verdict; a null html counts as empty; an empty table
gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import staged

ALLOW, BLOCK = "allow", "block"
LONGEST_WORD = 20
SMOOTHING = 1.0
BLOCKED_WORDS = ("spam", "pills", "casino", "viagra", "porn", "lottery")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return host & F.col("path").startswith(self.path)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty without ``://``."""
    pattern = r"://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        text = F.when(r.fits(), r.text).otherwise(text)
        verdict = F.when(r.fits(), r.verdict).otherwise(verdict)
    return text, verdict


# ---- words -------------------------------------------------------------------------------

def _pieces(text: Column) -> Column:
    """Letter pieces and number tokens of a host or path."""
    return F.transform(
        F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"\p{L}+|[0-9]+"), F.lit(0)),
        lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("#"), F.length(p).cast("string"))).otherwise(p))


def unigrams(pages: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(word, n) over the visible text of all pages, without URLs, and each of ``more`` once."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    plain = F.regexp_replace(text, r"(?:\b[a-z]{1,10}://|\bwww\.)\S*", " ")
    found = F.regexp_extract_all(plain, F.lit(r"\p{L}{2,}"), F.lit(0))
    words = pages.select(F.explode(found).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    extra = pages.sparkSession.createDataFrame([(w, 1) for w in sorted(set(more))], "word string, n long")
    return counted.unionByName(extra).groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(piece: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split; an unknown word is the less likely the longer it is."""
    best, back = [0.0], [0]
    for end in range(1, len(piece) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = piece[start:end]
            n = counts.get(word)
            cost = math.log(n / total) if n else math.log(1 / total) - 2.3 * len(word)
            options.append((best[start] + cost, -start))
        score, start = max(options)
        best.append(score)
        back.append(-start)
    words, end = [], len(piece)
    while end:
        words.append(piece[back[end]:end])
        end = back[end]
    return words[::-1]


def segmented(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) for distinct pieces; a piece that is one word stays whole."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    starts = F.sequence(F.lit(1), F.length("piece"))
    cuts = F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("piece") - s + 1)),
        lambda n: F.substring("piece", s, n))))
    letters = pieces.where(~F.col("piece").startswith("#"))
    known = letters.select("piece", F.explode(F.array_distinct(cuts)).alias("word")).join(counts, "word")
    gathered = known.groupBy("piece").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [viterbi(p, {k["word"]: k["n"] for k in known or []}, total)
                     for p, known in zip(batch.column("piece").to_pylist(), batch.column("known").to_pylist())]
            yield pa.record_batch({"piece": batch.column("piece"), "words": pa.array(words, pa.list_(pa.string()))})

    numbers = pieces.where(F.col("piece").startswith("#")).select("piece", F.array("piece").alias("words"))
    return letters.join(gathered, "piece", "left").mapInArrow(split, "piece string, words array<string>").unionByName(numbers)


# ---- verdicts --------------------------------------------------------------------------------

def url_verdicts(pages: DataFrame, rules: list[Rule], blocked_words: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); the score is the log-odds of block."""
    host, path = url_parts(F.col("url"))
    rule, ruled = rule_of(rules)
    placed = staged(pages.select("page_id", host.alias("host"), path.alias("path")), "url-pages")
    urls = staged(placed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).select(
        "host", "path", "n", rule.alias("rule"), ruled.alias("ruled")), "urls")

    def on_side(name: str) -> Column:  # a default argument here would be taken for the index of the piece
        return F.transform(_pieces(F.col(name)), lambda p: F.struct(F.lit(name).alias("side"), p.alias("piece")))

    sides = F.concat(on_side("host"), on_side("path"))
    cut = urls.select("host", "path", "n", "ruled", F.inline(sides))
    pieces = staged(cut.select("piece").distinct(), "url-pieces")
    counts = staged(unigrams(pages, blocked_words), "url-unigrams")
    words = staged(segmented(pieces, counts), "url-words")

    # a token tells its side apart, as a word means another thing in a host
    token = F.concat("side", F.lit(":"), "word")
    tokens = cut.join(words, "piece").withColumn("word", F.explode("words")).groupBy("host", "path").agg(
        F.first("n").alias("n"), F.first("ruled").alias("ruled"), F.collect_list(token).alias("tokens"))
    bad = F.exists("tokens", lambda t: t.isin(*[f"host:{w}" for w in blocked_words]))
    tokens = staged(tokens.withColumn("label", F.coalesce("ruled", F.when(bad, BLOCK))), "url-tokens")

    count = {v: F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)) for v in (ALLOW, BLOCK)}
    seen = tokens.select("n", "label", F.explode("tokens").alias("token")).groupBy("token").agg(
        count[ALLOW].alias("a"), count[BLOCK].alias("b")).where(F.col("a") + F.col("b") > 0)
    seen = staged(seen, "url-counts")
    sums = seen.agg(F.sum("a"), F.sum("b"), F.count(F.lit(1))).first()
    docs = tokens.agg(count[ALLOW], count[BLOCK]).first()
    all_a, all_b, size = (x or 0 for x in sums)
    prior = math.log(((docs[1] or 0) + SMOOTHING) / ((docs[0] or 0) + 2 * SMOOTHING))
    weight = F.log((F.col("b") + SMOOTHING) / (all_b + SMOOTHING * (size + 1))) - F.log(
        (F.col("a") + SMOOTHING) / (all_a + SMOOTHING * (size + 1)))
    scored = tokens.select("host", "path", F.explode("tokens").alias("token")).join(
        seen.select("token", weight.alias("weight")), "token").groupBy("host", "path").agg(
        F.sum("weight").alias("weight"))
    score = F.lit(prior) + F.coalesce("weight", F.lit(0.0))
    judged = urls.join(scored, ["host", "path"], "left").select(
        "host", "path", "rule", score.alias("score"),
        F.coalesce("ruled", F.when(score > 0, BLOCK).otherwise(ALLOW)).alias("verdict"))
    return placed.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score")
