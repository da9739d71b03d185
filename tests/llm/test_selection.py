"""Mixing, rules with guarantees, templates and URL verdicts against plain computations."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import host_words, mixing, risk_rules, templates
from labelloom.llm.common import word_count
from labelloom.llm.queries import URL_RULES


# ---- mixing ----------------------------------------------------------------------------

def filled(sizes, share=1.5, weights=(3, 1, 2), ceiling=2.0):
    """Targets by repeated sharing: stop whoever passes the ceiling, share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, stopped = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        level = (budget - sum(stopped.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if level * weight[s] >= ceiling * sizes[s]]
        if not over:
            return {**stopped, **{s: level * weight[s] for s in rest}}
        stopped |= {s: ceiling * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 10}, {"only": 3},
    {f"s{i}": (i * 7919) % 500 for i in range(40)}])
def test_targets(llm, sizes):
    rows = llm.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == pytest.approx(filled(sizes))
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_keeps_columns_and_repeats(documents):
    rows = [(i, f"word {i} " * (i % 5 + 1), "en", ["a", "b", None][i % 3]) for i in range(300)]
    docs = documents(*rows, (None, None, None, "a"), (1, "again", "en", "z"))
    mixed = mixing.mixed(docs, word_count(F.col("text")))
    assert mixed.columns == docs.columns and mixed.schema == docs.schema
    plan = mixing.with_copies(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")),
                              mixing.source_targets(docs.select("source", word_count(F.col("text")).alias("size"))))
    assert sorted(map(str, mixed.groupBy("doc_id").count().collect())) == sorted(map(str, (
        plan.groupBy("doc_id").agg(F.sum("copies").alias("count")).where("count > 0").collect())))
    assert plan.where("copies > 2 or copies < 0").isEmpty()
    assert mixing.mixed(docs.limit(0), word_count(F.col("text"))).count() == 0


# ---- rules --------------------------------------------------------------------------------

def measures_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_base_measures(documents):
    texts = [None, "", " \n\t", "a", "a b c a b c", "x x x x x", "a\na\nb\n\n \n a", "a b a b a b c d", "é# 漢|字 😀 <b>",
             "one two three " * 40, "y " * 20_000, "l\x0b1\nl\x0b1"]
    got = risk_rules.base_measures(documents(*enumerate(texts)), "lang").collect()
    for r in got:
        n, chars, symbols, lines, repeats = measures_by_hand(texts[r.doc_id]) if r.doc_id != 10 else (20_000, 20_000, 0, 0, 20_000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), r
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)


def test_binomial_tail_is_exact(llm):
    cases = [(k, n) for n in (1, 10, 500, 3000) for k in range(0, max(1, n // 40))]
    rows = llm.createDataFrame(cases, "k long, n long")
    p = 0.03
    for r in rows.select("k", "n", risk_rules.binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect():
        want = sum(math.comb(r.n, i) * p ** i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        assert r.t == pytest.approx(want if r.k < r.n * p else 1.0, rel=1e-9)


def test_cutoffs_keep_their_promise(llm):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2] if i < 9000 else "few", 100, 500, int(rng.integers(0, 20 if i % 2 else 120)), 0, 0, False)
            for i in range(9020)]
    measures = llm.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, "
                                         "n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = llm.createDataFrame([(i, 1 if i % 10 else None) for i in range(9020)], "doc_id long, quality int")
    chosen = risk_rules.cutoffs(measures, labels)
    assert {r.stratum for r in chosen.collect()} == {"a", "b"}
    judged = risk_rules.judged(measures, chosen)
    lost = {r.stratum: r.lost for r in judged.groupBy("stratum").agg(F.avg((~F.col("kept")).cast("int")).alias("lost")).collect()}
    assert lost["few"] == 0 and max(lost.values()) <= risk_rules.MAX_FALSE_REJECTION
    cut = {(r.stratum, r.rule): r.cutoff for r in chosen.collect()}
    assert cut["b", "symbols"] < cut["a", "symbols"]
    none = risk_rules.judged(measures, risk_rules.cutoffs(measures, labels.limit(0)))
    assert none.where("kept").count() == 9020 and none.limit(0).count() == 0


# ---- templates -------------------------------------------------------------------------------

ITEM = ("On Monday morning Alice Brown bought 12 apples and 30 pears for 45 dollars at the old market, then "
        "she walked 7 km to see Robert and gave him 12 apples before the evening train left the town.")


def found(documents, llm, texts, items=((1, ITEM),)):
    bench = llm.createDataFrame(list(items), "item_id long, text string").withColumn("slots", F.lit("clash"))
    return {(r.doc_id, r.item_id): r for r in templates.contaminated(documents(*enumerate(texts)), bench).collect()}


def test_passages_with_other_numbers_and_names_are_found(llm, documents):
    changed = ITEM.replace("12", "88").replace("30", "31").replace("45", "46").replace("7 km", "9 miles").replace(
        "Alice Brown", "Mary").replace("Robert", "Peter").replace("Monday", "Friday")
    crossed = ITEM.replace("12 apples and", "88 apples and")  # the second 12 stays: slots disagree
    half = " ".join(ITEM.split()[:14])
    got = found(documents, llm, [ITEM, "intro text here. " + changed + " More follows.", "Nothing of it at all is here.",
                                 half, None, "", "z " * 50_000 + ITEM, ITEM + "\n" + ITEM])
    assert set(got) == {(0, 1), (1, 1), (6, 1), (7, 1)}
    assert got[0, 1].same_values and not got[1, 1].same_values
    assert got[0, 1].matched == got[0, 1].windows
    crossed_hit = found(documents, llm, [crossed]).get((0, 1))
    assert crossed_hit is None or crossed_hit.matched < got[0, 1].matched


def test_short_items_and_empty_tables(llm, documents):
    items = [(1, "where does the river end"), (2, "too short"), (3, None), (None, ITEM), (4, "")]
    got = found(documents, llm, ["So where does the river end today?", "too short", ITEM], items)
    assert set(got) == {(0, 1), (1, 2)}  # fewer than four tokens are found as a whole text
    assert found(documents, llm, [ITEM], [(3, None)]) == {}
    blocks = templates.contaminated(documents((0, ITEM)), llm.createDataFrame([(1, ITEM)], "item_id long, text string"), block=3)
    assert blocks.count() == 1


def test_units_and_attached_numbers_are_placeholders():
    a, b = (templates.TemplateReader().read([t])[0] for t in ("it is 5 kg heavy", "it is 71kg heavy"))
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == [0, 0, 1, 2, 0]


def test_partial_passages_of_long_items_are_found(llm, documents):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    got = found(documents, llm, ["Before it " + " ".join(words[100:130]) + " and after", " ".join(words[100:112]),
                                 " ".join(words[5:12]) + " x " + " ".join(words[13:20])], [(1, " ".join(words))])
    assert set(got) == {(0, 1)}
    assert set(found(documents, llm, [" ".join(ITEM.split()[12:])])) == {(0, 1)}


def test_items_without_usable_templates_are_found_exactly(llm, documents):
    items = [(1, "12 + 45 - 30 = 27"), (2, "Alice Brown, Carol White, Dave Green, Erin Black"), (3, "今天天气很好我们去公园散步吧"),
             (4, "The Title Of Every Important Word Written Here")]
    texts = ["We have 12 + 45 - 30 = 27 here.", "so Alice Brown, Carol White, Dave Green, Erin Black came", "他说今天天气很好我们去公园散步吧然后走了",
             "see The Title Of Every Important Word Written Here", "We have 12 + 45 - 31 = 26 here."]
    assert set(found(documents, llm, texts, items)) == {(0, 1), (1, 2), (2, 3), (3, 4)}


def test_names_at_sentence_starts_embedding_and_upper_case(llm, documents):
    items = [(1, "Natalia sold 48 clips in the shop. Natalia then sold half of them. Natalia was glad."),
             (2, "The capital of the country is large")]
    texts = ["Robert sold 31 clips in the shop. Robert then sold half of them. Robert was glad.",
             "see The capital of the country is large", items[0][1].upper(), items[1][1].upper()]
    assert set(found(documents, llm, texts, items)) == {(0, 1), (1, 2), (2, 1), (3, 2)}


def test_one_changed_occurrence_and_repeated_ids(llm, documents):
    item = ("Tom paid 12 coins for a red box and later paid 12 coins for a blue box at the old shop near the river "
            "where people said that 12 coins were too much for such a small thing")
    typo = item.replace("12", "13", 1)
    got = found(documents, llm, [typo], [(1, item)])
    assert got[0, 1].matched < got[0, 1].windows and got[0, 1].same_values
    bench = llm.createDataFrame([(1, item)], "item_id long, text string")
    twice = documents((5, item), (5, item.replace("12", "40", 2).replace("Tom", "Tim")))
    row = templates.contaminated(twice, bench).collect()
    assert [(r.doc_id, r.matched == r.windows) for r in row] == [(5, True)]
    pairs = [(1, 2)] * 3 + [(1, 1)] + [(7, 2)]
    assert templates._majority(pairs) == {(1, 2)}


# ---- URLs --------------------------------------------------------------------------------------

def rule_by_hand(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


def test_rules_and_verdicts(llm):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1", "https://example.org/en/12?x=/es/", "http://notexample.org/es/",
            "http://org", "http://x.org/", "ftp://shop.com/fr/a#b", "http://shop.com/de/", "http://shop.com:80/de/", "http://a.net/x",
            "http://cheappills.net/en/7", "http://spam.net/en/8", "http://É.com/fr/", "http://a.net/" + "q" * 3000, "http://a.net/x"]
    pages = llm.createDataFrame([(i, u, None if i % 3 else "<p>cheap pills spam the shop</p>", "c") for i, u in enumerate(urls)],
                                "page_id long, url string, html string, verdict string")
    rows = host_words.url_verdicts(pages, URL_RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = rule_by_hand(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text), r
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    verdict = {r.page_id: r.verdict for r in rows}
    assert verdict[13] == verdict[14] == "block" and verdict[12] == verdict[17]
    assert host_words.url_verdicts(pages.limit(0), URL_RULES).count() == 0


def test_words_of_a_piece():
    counts = {"cheap": 50, "pills": 40, "che": 1, "ap": 1}
    assert host_words.viterbi("cheappills", counts, 1000) == ["cheap", "pills"]
    assert host_words.viterbi("xq", counts, 1000) == ["xq"] and host_words.viterbi("", counts, 1) == []


def test_concatenated_hosts_are_split_on_a_large_table(llm):
    plain = "".join(f"<p>word{'abcdefghij'[i % 10]} the cheap garden chairs and pills of the house</p>" for i in range(200))
    rows = [(i, f"http://{'cheappillsshop' if i % 3 == 0 else 'gardenchairs'}.net/x/{i}", plain) for i in range(90)]
    rows += [(90, "http://bestcasinohouse.net/x/1", plain + "<p>see http://bestcasinohouse.net/ and www.gardenchairs.net</p>"),
             (91, "http://thehouse.net/x/1", plain), (92, "http://cheapshop.org/", plain)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string")
    counts = host_words.unigrams(pages, host_words.BLOCKED_WORDS)
    pieces = llm.createDataFrame([("cheappillsshop",), ("gardenchairs",), ("bestcasinohouse",), ("house",)], "piece string")
    words = {r.piece: r.words for r in host_words.segmented(pieces, counts).collect()}
    assert words["gardenchairs"] == ["garden", "chairs"] and words["house"] == ["house"]
    assert "pills" in words["cheappillsshop"] and "casino" in words["bestcasinohouse"]
    rules = [host_words.Rule("allow", "gardenchairs.net", "/")]
    verdict = {r.page_id: r.verdict for r in host_words.url_verdicts(pages, rules).collect()}
    assert verdict[0] == verdict[92] == "block" and verdict[1] == "allow"
