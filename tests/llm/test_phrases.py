"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.llm import phrases


def plain_counts(rows):
    n, times = Counter(), defaultdict(Counter)
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                times[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return n, times


def plain_collocations(rows, least, top):
    n, times = plain_counts(rows)
    out = []
    for lang, count in times.items():
        kept = []
        often = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        for p, a in often.items():
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(
                q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items())
            score, _, left, right = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]])
                                        for k in range(1, len(p)))
            if not inside:
                kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts():
    dice = random.Random(11)
    words = ["a", "B", "c", "É", "d'e", "ÿ", "x-y"]
    rows = [(None, None), ("en", ""), ("en", " . ,,"), (None, "solo"), ("fr", "\t"), ("xx", "One two\tthree!four")]
    for lang in ("en", "en", "en", "fr", None):
        for _ in range(60):
            rows.append((lang, "".join(dice.choice(words) + dice.choice([" "] * 6 + ["\t", ". ", ",", "\x0b", "\n", "\r\n"])
                                       for _ in range(dice.randrange(40)))))
    rows += [("en", "the long passage that many documents share word by word without a stop")] * 9
    rows += [("fr", "le long passage, que tous ont")] * 5 + [("fr", "z " * 300)]
    return rows


@pytest.mark.parametrize("least,top", [(5, 2000), (3, 7), (300, 2000)])
def test_collocations_equal_plain_counting(llm, documents, least, top):
    rows = texts()
    docs = documents(*[(i, text, lang) for i, (lang, text) in enumerate(rows)])
    got = phrases.collocations(docs, least, top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, least, top)


def test_flow_gives_the_counts_of_frequent_phrases_and_all_words(llm, documents):
    rows = texts()
    docs = documents(*[(i, text, lang) for i, (lang, text) in enumerate(rows)])
    counts = phrases.flow(phrases.graph(docs, 4))
    got = {(r.lang, tuple(r.gram.split(" "))): r.times for r in counts.collect()}
    _, times = plain_counts(rows)
    wanted = {(lang, p): a for lang, c in times.items() for p, a in c.items() if a >= 4 or len(p) == 1}
    assert {k: got.get(k) for k in wanted} == wanted


def test_unary_paths_join_what_has_no_junction(llm, documents):
    passage = "the long passage that many documents share word by word"
    rows = [(1, passage, "en")] * 4 + [(2, "many documents share word for ever", "en")] * 3 + [(3, "q q q q q q", "en")] * 3
    counts = phrases.flow(phrases.graph(documents(*rows), 3))
    got = {(r.phrase, r.times) for r in phrases.unary_paths(counts, 3).collect()}
    assert got == {
        ("the long passage that many documents share", 4), ("many documents share word", 7),
        ("documents share word by word", 4), ("documents share word for ever", 3), ("q q q q", 9)}


def test_links_of_rare_pairs_are_cut_and_of_frequent_ones_never(llm, documents):
    docs = documents(*[(i, f"one two w{i}") for i in range(40)])
    grams = {(r.gram, r.times) for r in phrases.graph(docs, 30).select("gram", "times").collect()}
    assert ("one two", 40) in grams and ("w7", 1) in grams


def test_no_rows_and_no_texts(llm, documents):
    assert phrases.collocations(documents((1, "a b")).limit(0), 1).count() == 0
    assert phrases.collocations(documents((1, None), (None, "")), 1).count() == 0
    assert [tuple(r)[:3] for r in phrases.collocations(documents((None, "a b")).withColumn("lang", F.lit(None).cast(
        "string")), 1).collect()] == [("und", 1, "a b")]
