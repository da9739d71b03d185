import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from labelloom.functions import text as X
from labelloom.functions import tiers
from labelloom.functions.cleaning import STABLE_RANGES, clean_text
from labelloom.operators import terms
from labelloom.operators.candidates import best_candidates, with_quality
from labelloom.plans import checks

ALPHABET = ("ab Éß \t\n\n\r.,;!?^§�​\x07\x85ﬁ①漢字😀が゙ｱ́x1_9½"
            " 　\x1f\U000f0001͸")


def _texts(n=400, seed=5):
    rng = random.Random(seed)
    fixed = ["", " ", "a", "ab", "x\n1\nab", "\n\n\n\nab\n\n\n\n", "12345", "!" * 10, "!" * 9,
             "ab " + "§" * 25 + " cd", "ok\n \n-\nfine", "a b c", " ab ", "Ⅷ½²"]
    return fixed + ["".join(rng.choices(ALPHABET, k=rng.randint(1, 60))) for _ in range(n)]


CLEANED = {
    "": "", "a": "", "ab": "ab", "12345": "", "x\n1\nab": "ab", "ok\n \n-\nfine": "ok\n \nfine",
    "ab\ufffdcd": "abcd", "ab\x07cd": "abcd", "ab\u200bcd": "abcd", "x\uf8ffy": "xy", "\ufb01ne": "fine",
    "\u2460ab": "1ab", "ab \t cd": "ab cd", "ab\n\n\n\ncd": "ab\n\ncd", "  ab  ": "ab", "\u6f22\u5b57": "\u6f22\u5b57",
    "ab \U0001f600": "ab \U0001f600", "a 1 b": "a 1 b",
}


def test_cleaning_cases(spark):
    df = spark.createDataFrame([(t,) for t in CLEANED], "t string")
    assert {r.t: r.c for r in df.select("t", clean_text(F.col("t")).alias("c")).collect()} == CLEANED


def test_cleaned_texts_hold_nothing_unwanted(spark):
    df = spark.createDataFrame([(t,) for t in _texts()], "t string")
    for r in df.select("t", clean_text(F.col("t")).alias("c")).collect():
        assert not [c for c in r.c if c not in "\n\r\t" and unicodedata.category(c)[0] == "C"], repr(r.t)
        assert "  " not in r.c and r.c == r.c.strip()
        for line in r.c.split("\n"):
            assert not line.strip() or sum(c.isalpha() for c in line) >= 2, repr(r.t)


def test_cleaning_of_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(clean_text(F.col("t"))).first()[0] == ""


def test_stable_ranges_need_no_normalisation():
    for low, high in STABLE_RANGES:
        for code in range(low, high + 1):
            c = chr(code)
            assert unicodedata.normalize("NFKC", c) == c
            assert unicodedata.category(c) != "Cn"
            # Nothing that composes with the character before it.
            assert unicodedata.combining(c) == 0
            assert unicodedata.normalize("NFKC", "A" + c) == "A" + c


# text: letters, words, special, runs, score, reason; worked out by hand
MEASURED = {
    "abcd": (1.0, 1.0, 0.0, 0, 1.0, "clean"),
    "12345": (0.0, 0.0, 0.0, 0, 0.35, "alpha=0%"),
    "!" * 10: (0.0, 0.0, 0.0, 1, 0.345, "alpha=0%"),
    "!" * 9: (0.0, 0.0, 0.0, 0, 0.35, "alpha=0%"),
    "ab \u00a7": (0.5, 0.5, 0.25, 0, 0.425, "alpha=50%"),
    "abc d": (0.8, 0.5, 0.0, 0, 0.795, "clean"),
}


def test_quality_cases(spark):
    df = spark.createDataFrame([(t,) for t in MEASURED], "t string")
    for r in with_quality(df, "t").collect():
        got = (r.letter_ratio, r.word_ratio, r.special_ratio, r.garbled_runs, r.quality_score)
        assert got == pytest.approx(MEASURED[r.t][:5]), r.t
        assert r.quality_reason == MEASURED[r.t][5]


def test_quality_bounds(spark):
    df = spark.createDataFrame([(t,) for t in _texts(seed=6) if t], "t string")
    for r in with_quality(df, "t").collect():
        assert all(0 <= x <= 1 for x in (r.letter_ratio, r.word_ratio, r.special_ratio, r.quality_score)), r.t
        assert (r.quality_reason == "clean") == (r.letter_ratio > 0.5)


def test_quality_of_nothing(spark):
    df = spark.createDataFrame([("",), (None,)], "t string")
    assert {(r.quality_score, r.quality_reason) for r in with_quality(df, "t").collect()} == {
        (0.0, "No text")}


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(1)
    values = [2.675, 1.005, 0.005, 0.0005, 0.0015, 0.5, 1.5, 12345.675, -2.675, 0.0, -0.004, 1e-9]
    values += [rng.uniform(-1000, 1000) for _ in range(2000)] + [i / 1000 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 2, 3):
        rows = df.select("v", X.round_binary(F.col("v"), digits).alias("r")).collect()
        assert [r.r for r in rows] == [float(round(r.v, digits)) for r in rows]


def test_name_stem(spark):
    cases = {"A.b.PDF": "a.b", ".pdf": "", "a.": "a.", "noext": "noext", "x.y/z": "x"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "n string")
    got = {r.n: r.s for r in df.select("n", X.name_stem(F.col("n")).alias("s")).collect()}
    assert got == {**cases, None: None}


def test_feature_text_of_nothing(spark):
    df = spark.createDataFrame([(None, None, None, None)],
                               "a string, b string, c string, d array<string>")
    row = df.select(X.feature_text(*map(F.col, "abcd")), X.baseline_text(F.col("a"), F.col("b")),
                    X.summary_text(F.col("a"), F.col("b")),
                    X.scoring_text(F.col("c"), F.col("d"))).first()
    assert tuple(row) == ("   ", " ", "", " ")


def test_buckets_and_bands(spark):
    lengths = {199: "< 200", 200: "200-1000", 999: "200-1000", 1000: "1000-3000",
               2999: "1000-3000", 3000: "> 3000"}
    df = spark.createDataFrame([("x" * n,) for n in lengths], "t string")
    rows = df.select(F.length("t").alias("n"), tiers.length_bucket(F.col("t")).alias("b")).collect()
    assert {r.n: r.b for r in rows} == lengths
    assert {r.bucket: r.n for r in checks.length_buckets(df, "t").collect()} == {
        "< 200": 1, "200-1000": 2, "1000-3000": 2, "> 3000": 1}
    bands = {0.70: "HIGH", 0.6999: "MEDIUM", 0.40: "MEDIUM", 0.3999: "LOW", None: None}
    df = spark.createDataFrame([(p,) for p in bands], "p double")
    rows = df.select("p", tiers.confidence_band(F.col("p")).alias("b")).collect()
    assert {r.p: r.b for r in rows} == bands


def test_review_rules(spark):
    df = spark.createDataFrame([("low", 0.9), ("high", 0.3999), ("low", 0.1), ("high", 0.4),
                                (None, 0.8)], "c string, p double")
    rows = df.select(tiers.needs_review(F.col("c"), F.col("p")).alias("n"),
                     tiers.review_reason(F.col("c"), F.col("p")).alias("r")).collect()
    assert [tuple(r) for r in rows] == [
        (True, "LLM confidence low"), (True, "Prediction probability low"),
        (True, "LLM confidence low"), (False, None), (False, None)]
    verdicts = spark.createDataFrame([(0.03,), (0.02,), (0.0,), (-0.1,)], "d double").select(
        tiers.uplift_verdict(F.col("d"))).collect()
    assert [r[0] for r in verdicts] == ["improves", "marginal", "no improvement", "no improvement"]


def test_best_candidate_rules(spark):
    good, fair = "plain words here", "plain words 12 34 56"
    candidates = spark.createDataFrame([
        (1, "first", 1, good, 3), (1, "second", 2, good, 4),   # tie: smaller number
        (2, "first", 1, fair, 1), (2, "second", 2, good, 2),   # higher score
        (3, "first", 1, "", 1), (3, "second", 2, None, 1),     # all zero
        (4, "second", 2, good, 9),                              # one method failed
    ], "doc_id int, method string, priority int, text string, pages int")
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id int")
    got = {r.doc_id: (r.method, r.pages, r.text) for r in best_candidates(docs, candidates).collect()}
    assert got == {1: ("first", 3, good), 2: ("second", 2, good), 3: (None, None, ""),
                   4: ("second", 9, good), 5: (None, None, "")}


def test_best_extraction_is_chosen_without_texts(spark):
    """The choice keeps one number per document; ties go to the row stored first."""
    text = "A clean line of words that scores well enough."
    rows = [(1, "m", 1, text, 1), (1, "n", 1, text + " ", 2), (2, "m", None, text, 3), (2, "n", 5, text, 4)]
    candidates = spark.createDataFrame(rows, "doc_id int, method string, priority int, text string, pages int").coalesce(1)
    best = best_candidates(candidates.select("doc_id").distinct(), candidates)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert not any("text" in line for line in plan.splitlines() if "Aggregate" in line)
    assert {r.doc_id: (r.method, r.pages) for r in best.collect()} == {1: ("m", 1), 2: ("n", 4)}


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("A b_1 Été, x 42!",), ("",), (None,), ("one",)], "t string")
    words = [r[0] for r in df.select(terms.tokens(F.col("t"))).collect()]
    assert words == [["b_1", "été", "42"], [], [], ["one"]]
    grams = [r[0] for r in df.select(terms.with_bigrams(terms.tokens(F.col("t")))).collect()]
    assert grams == [["b_1", "été", "42", "b_1 été", "été 42"], [], [], ["one"]]


def test_vocabulary_limits_and_ties(spark):
    df = spark.createDataFrame([(1, "bb aa aa cc"), (2, "aa bb dd"), (3, "dd bb")], "id int, t string")
    vocab = terms.vocabulary(terms.gram_lists(df, "id", F.col("t")), max_features=3)
    assert [tuple(r) for r in vocab.collect()] == [("aa", 3, 2), ("bb", 3, 3), ("dd", 2, 2)]


@pytest.mark.parametrize("column", ["label"])
def test_distribution_percentages(spark, column):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)], f"{column} string")
    rows = checks.distribution(df, column).collect()
    assert [(r.label, r.n, float(r.pct)) for r in rows] == [("a", 2, 66.7), ("b", 1, 33.3)]


def test_no_stable_character_is_unwanted():
    """So one search tells the texts that cleaning could change before it looks at lines."""
    for first, last in STABLE_RANGES[1:]:
        assert not [c for c in range(first, last + 1) if unicodedata.category(chr(c)) in ("Cc", "Cf", "Co", "Cs")]


def test_quality_counts_the_words_once(spark):
    plan = with_quality(spark.createDataFrame([("a b",)], "t string"), "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?U)[^\s\x1c-\x1f]++") == 1


def test_cleaning_leaves_plain_texts_to_one_search(spark):
    df = spark.createDataFrame([("plain",)], "t string").select(clean_text(F.col("t")).alias("c"))
    assert "CASE WHEN RLIKE(coalesce(t" in df._jdf.queryExecution().optimizedPlan().toString().replace("#0", "")


def test_bucket_sums_make_every_list_once(spark):
    """A plain explode filters on the list's size, below the projection that makes it."""
    df = spark.createDataFrame([(1, "bb aa aa"), (2, ""), (3, None)], "id int, t string").repartition(2)
    sums = terms.bucket_sums(terms.gram_lists(df, "id", F.col("t")))
    assert sorted(r.upper for r in sums.collect()) == [1, 1, 1, 2]
    assert sums._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
