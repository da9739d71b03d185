"""Personal data against plain expressions and checks of Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from labelloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def holds(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
            "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def plain_spans(text):
    found = [(m.start(), place, m.end(), kind) for place, (kind, pattern) in enumerate(PLAIN.items())
             for m in re.finditer(pattern, text or "") if holds(kind, m.group())]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def with_check_digit(digits):
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def account(country, rest):
    turned = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{rest}"


def texts():
    dice = random.Random(2)
    parts = ["a@b.c", "x.y+z@mail-1.example.org", "@", "a@b", "a@b.c@d.e", "é@b.c", "a@b..c", "a@b.c_d@e.f.", "..@x.y",
             "1.2.3.4", "300.1.1.1", "1.2.3", "01.002.3.255", "1.2.3.4.5.6.7.8", "99999999999999999999.1.1.1",
             "4111 1111 1111 1111", "4111-1111 11111111", "4111 1111 1111 1112", "4111  1111", "1", "+1 (017) 555-7713",
             "+4915112345678", "+1 2", "++49 30 123456 7890", "+49.(30).1234567", "+12-", "12345678901234567890",
             with_check_digit("1234567890123"), with_check_digit("123456789012345678"), "é", "漢字", "😀", "-", ".", "+", ",",
             "word", "\n", "\t"]
    out = [None, "", "word", *parts]
    for _ in range(300):
        out.append("".join(dice.choice(parts) + dice.choice(["", " ", " ", ", "]) for _ in range(dice.randrange(14))))
    for _ in range(300):
        out.append("".join(dice.choice("a1@.+- (é😀92") for _ in range(dice.randrange(60))))
    return out


@pytest.fixture(scope="module")
def found(llm):
    rows = list(enumerate(texts()))
    docs = llm.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("extra"))
    return rows, pii.personal_data(docs)


def test_base_spans_equal_plain_expressions(found):
    rows, spans = found
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in spans.collect()}
    assert got == {i: plain_spans(text) for i, text in rows}
    assert sum(map(len, got.values())) > 500


def test_digests(found):
    rows, spans = found
    for row, (i, text) in zip(sorted(pii.span_digests(spans).collect()), rows):
        base = plain_spans(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert tuple(row)[:6] == (i, *[sum(k == kind for k, _, _ in base) for kind in PLAIN],
                                  hashlib.sha256(listed.encode()).hexdigest())
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))


def kinds_of(llm, *texts):
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[(s.kind, texts[r.doc_id][s.start:s.end], round(s.score, 2)) for s in r.spans]
            for r in sorted(pii.personal_data(docs).collect())]


def test_accounts_by_mod_97(llm):
    good = account("DE", "370400440532013000")
    assert good == "DE89370400440532013000"
    spaced = "GB82 WEST 1234 5698 7654 32"
    wrong = good[:-1] + "1"
    got = kinds_of(llm, f"see {good}.", f"Konto {spaced} BIC", f"{wrong}", f"x{good}", f"invoice {good}", account("NO", "86011117947"))
    assert got == [[("iban", good, 0.7)], [("iban", spaced, 1.0)], [], [], [], [("iban", account("NO", "86011117947"), 0.7)]]


def test_words_around_decide_on_weak_kinds(llm):
    short = with_check_digit("50180000000")
    got = kinds_of(llm, "SSN: 123-45-6789", "part 123-45-6789", "ssn 000-45-6789", "Call (555) 123-4567 now",
                   "id 555 123 4567", f"Karte {short}", f"number {short}", "téléphone 555-123-4567",
                   "2001:db8:0:0:0:0:0:1", "mail joe.d [at] example [dot] org!", "ssn version 123-45-6789")
    assert got == [[("ssn", "123-45-6789", 0.6)], [], [], [("local_phone", "(555) 123-4567", 0.6)], [],
                   [("short_card", short, 0.6)], [], [("local_phone", "555-123-4567", 0.6)],
                   [("ip6", "2001:db8:0:0:0:0:0:1", 0.6)],
                   [("spelled_email", "joe.d [at] example [dot] org", 1.0)], []]


def test_base_spans_stay_whatever_is_around(llm):
    assert kinds_of(llm, "version 1.2.3.4", "ip 1.2.3.4") == [[("ip", "1.2.3.4", 0.3)], [("ip", "1.2.3.4", 0.9)]]


@pytest.mark.parametrize("text", [
    "a" * 300_000, "1" * 300_000, "1 " * 150_000, "+" * 100_000, "+1" + "(" * 200_000, "a@" * 100_000, "1." * 100_000,
    "a@b" + ".c" * 100_000, "-" * 200_000, "ab.c " * 60_000])
def test_very_long_runs(llm, text):
    docs = llm.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.personal_data(docs).collect()[0]
    expected = [("email", 0, len(text))] if text.startswith("a@b") else []
    if text.startswith("1."):
        expected = [("ip", 8 * i, 8 * i + 7) for i in range(25_000)]
    assert [(s.kind, s.start, s.end) for s in row.spans] == expected


def test_rows_without_ids_repeated_and_none(llm):
    rows = [(None, "a@b.c"), (5, "a@b.c"), (5, "a@b.c"), (5, None)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.spans) for r in pii.span_digests(pii.personal_data(docs)).collect())
    assert got == [("5", ""), ("5", "email:0:5"), ("5", "email:0:5"), ("None", "email:0:5")]
    assert pii.personal_data(docs.limit(0)).count() == 0
