"""Personal data: patterns propose spans, checks confirm them, words around them adjust a score.

All of it is column expressions. For every kind a regular expression proposes leftmost
matches that do not overlap; a proposal that fails its check (Luhn, mod-97, ranges,
numbers of digits) is dropped and not tried again. A confirmed proposal starts from its
kind's score; words of the kind within ``AROUND`` characters on either side raise it,
words that point to something else lower it.

Base kinds (``email``, ``ip``, ``card``, ``phone``) stay whatever their score. The others
stay from ``LEAST_SCORE`` on: ``iban`` (length by country, mod-97), ``ssn``,
``local_phone``, ``short_card`` (12 or 13 digits, Luhn), ``ip6`` and ``spelled_email``.
Some of them start below it, so they need a word around that supports them.

Places are code points: sums of the lengths of matches and of the texts between them,
added up by doubling steps inside the row, so that a text with many matches takes
``n log n``. The expressions are written so that they neither recurse nor look twice at a
long run of letters or digits: possessive, and started at the beginning of a run or where
the last match ended.

Defined results: a null or empty text has no spans; rows are judged one by one, also
without an id or with a repeated one; spans of different kinds may overlap, and equal
starts go by the order of kinds; the text around reaches to the next match of the same
pattern at most; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import let

AROUND = 40
LEAST_SCORE = 0.5
SUPPORT, DOUBT = 0.3, 0.3
DOUBTFUL = ("version", "release", "isbn", "issn", "doi", "invoice", "order", "serial", "build", "sha", "md5",
            "rechnung", "bestellung", "facture", "commande", "factura", "pedido")
SPAN = "array<struct<start:int,place:int,end:int,kind:string,score:double,base:boolean>>"

# lengths of account numbers by country, fixed by the registry of the standard
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC"}


@dataclass(frozen=True)
class Kind:
    """A pattern, what a text must hold for it, the check of a match and the words that support it."""
    name: str
    pattern: str
    needed: str
    check: Callable[[Column], Column]
    score: float
    words: tuple[str, ...]
    base: bool = False


def _digits(hit: Column) -> Column:
    return F.translate(hit, " -().+", "")


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda hit: F.length(_digits(hit)).between(low, high)


def _luhn(low: int, high: int) -> Callable[[Column], Column]:
    return lambda hit: F.length(_digits(hit)).between(low, high) & F.call_function("luhn_check", _digits(hit))


def _octets(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False)))


def mod97(number: Column) -> Column:
    """Whether an account number with its country and check digits in front leaves 1."""
    turned = F.concat(F.substring(number, 5, 64), F.substring(number, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), step) == 1


def _account(hit: Column) -> Column:
    return let(F.translate(hit, " ", ""), mod97)


_LOCAL = "[A-Za-z0-9._%+-]"
_IBAN = "|".join(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}"
                 for length, countries in IBAN_LENGTHS.items())
_CALL = ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "handy", "mobil", "anruf",
         "téléphone", "portable", "teléfono", "móvil", "llamar")
_CARD = ("card", "visa", "mastercard", "maestro", "credit", "debit", "kreditkarte", "karte", "carte", "tarjeta")

KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda hit: F.lit(True), 0.9, ("mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel"), True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", _octets, 0.6,
         ("ip", "address", "host", "server", "login", "adresse", "dirección"), True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", _luhn(14, 19), 0.8, _CARD, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _digit_count(10, 15), 0.7, _CALL, True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", _account, 0.7,
         ("iban", "account", "bank", "konto", "compte", "banque", "cuenta", "banco")),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         "[0-9]-[0-9]{2}-[0-9]", lambda hit: F.lit(True), 0.3, ("ssn", "social security", "social-security")),
    Kind("local_phone", r"(?<![0-9.+)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]*[0-9])",
         r"[0-9][\x20.-][0-9]{4}", lambda hit: F.lit(True), 0.3, _CALL),
    Kind("short_card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,12}+(?![\x20-]?[0-9])",
         r"[0-9][\x20-]?[0-9]", _luhn(12, 13), 0.3, _CARD),
    Kind("ip6", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
         "[0-9A-Fa-f]:[0-9A-Fa-f]", lambda hit: F.lit(True), 0.6, ("ip", "address", "host", "server")),
    Kind("spelled_email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++"
         r"(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]++)++", r"[\[(](?:at|AT)[\])]",
         lambda hit: F.lit(True), 0.8, ("mail", "email", "contact")),
)
BASE_KINDS = tuple(k.name for k in KINDS if k.base)


def running_sums(numbers: Column) -> Column:
    """Sums of an array's first elements: the step k adds what lies 2**k before."""
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(numbers))))
    return F.aggregate(steps, numbers, lambda sums, k: F.transform(sums, lambda x, i: x + F.coalesce(
        F.get(sums, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))))


def _any_word(words: tuple[str, ...]) -> str:
    return rf"(?<![\p{{L}}0-9])(?:{'|'.join(w.replace('-', '[-]') for w in words)})(?![\p{{L}}0-9])"


def _kind_spans(text: Column, place: int, kind: Kind) -> Column:
    """The confirmed proposals of a kind with their places and scores."""
    def spans(hits: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        return F.when(F.size(hits) > 0, let(gaps, lambda g: placed(hits, g)))

    def placed(hits: Column, gaps: Column) -> Column:
        moves = F.transform(hits, lambda hit, i: F.length(F.get(gaps, i)) + F.coalesce(
            F.length(F.get(hits, i - 1)), F.lit(0)))
        return let(running_sums(moves), lambda starts: F.filter(F.transform(
            hits, lambda hit, i: judged(hit, F.get(starts, i), F.get(gaps, i), F.get(gaps, i + 1))),
            lambda span: span.isNotNull()))

    def judged(hit: Column, start: Column, before: Column, after: Column) -> Column:
        around = F.lower(F.concat_ws(" ", F.right(before, F.lit(AROUND)), F.left(after, F.lit(AROUND))))
        score = F.when(around.rlike(_any_word(kind.words)), F.lit(kind.score + SUPPORT)).otherwise(F.lit(kind.score))
        score = F.least(F.lit(1.0), score - F.when(
            around.rlike(_any_word(DOUBTFUL)), F.lit(DOUBT)).otherwise(F.lit(0.0)))
        return F.when(kind.check(hit), let(F.struct(
            start.alias("start"), F.lit(place).alias("place"), (start + F.length(hit)).alias("end"),
            F.lit(kind.name).alias("kind"), score.alias("score"), F.lit(kind.base).alias("base")),
            lambda span: F.when(span["base"] | (span["score"] >= LEAST_SCORE), span)))

    found = let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), spans)
    return F.coalesce(F.when(text.rlike(kind.needed), found), F.lit(None).cast(SPAN), F.array().cast(SPAN))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of (doc_id, text); spans by start and order of kinds, with scores."""
    text = F.coalesce("text", F.lit(""))
    columns = [_kind_spans(text, place, kind) for place, kind in enumerate(KINDS)]
    return docs.select("doc_id", F.array_sort(F.concat(*columns)).alias("spans"))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of base spans and the list of all."""
    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    base = listed(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
