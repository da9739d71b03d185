"""Text quality measures and their weighted score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.text import percent_label, round_binary

# Fixed values of the score: weights, scale factors and the punctuation that
# does not count as special.
LETTER_WEIGHT = 0.40
SPECIAL_WEIGHT = 0.25
WORD_WEIGHT = 0.25
GARBLED_WEIGHT = 0.10
SPECIAL_FACTOR = 10
GARBLED_LIMIT = 20
CLEAN_ABOVE = 0.5
ALLOWED_PUNCTUATION = " \t\n\r.,;:!?'\"()-/\\@#$%&*+=[]{}|<>~`_"

# A space here is what Python's str.split() splits on.
_GAP = r"\s\x1c-\x1f"
_WORD = rf"(?U)[^{_GAP}]++"
# A word start, its first two letters and whatever lies between them.
_LETTERED_WORD = (rf"(?U)(?<![^{_GAP}])[^{_GAP}\p{{L}}]*+\p{{L}}"
                  rf"[^{_GAP}\p{{L}}]*+\p{{L}}")
_SPECIAL = r"[^\p{L}\p{N}" + "".join("\\" + c if c in "\\[]-&^" else c
                                     for c in ALLOWED_PUNCTUATION) + "]+"
_GARBLED = rf"(?U)[^\p{{L}}\p{{N}}_{_GAP}]{{10,}}+"


def _count_removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def letter_ratio(text: Column) -> Column:
    return _count_removed(text, r"\p{L}+") / F.length(text)


def word_ratio(text: Column) -> Column:
    """Share of words with at least two letters; 0 for a text without words."""
    words, lettered = F.regexp_count(text, F.lit(_WORD)), F.regexp_count(text, F.lit(_LETTERED_WORD))
    return F.coalesce(F.try_divide(lettered, words), F.lit(0.0))  # each is counted once


def special_ratio(text: Column) -> Column:
    return _count_removed(text, _SPECIAL) / F.length(text)


def garbled_runs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_GARBLED))


def quality_columns(text: Column) -> dict[str, Column]:
    """The four measures, to be materialised before they are combined."""
    some = F.length(text) > 0
    return {
        "letter_ratio": F.when(some, letter_ratio(text)),
        "word_ratio": F.when(some, word_ratio(text)),
        "special_ratio": F.when(some, special_ratio(text)),
        "garbled_runs": F.when(some, garbled_runs(text)),
    }


def quality_score(letters: Column, words: Column, special: Column, garbled: Column) -> Column:
    """Score in [0, 1] at three decimals; 0 for an empty text (null measures)."""
    raw = (
        F.lit(LETTER_WEIGHT) * letters
        + F.lit(SPECIAL_WEIGHT) * (F.lit(1.0) - F.least(special * SPECIAL_FACTOR, F.lit(1.0)))
        + F.lit(WORD_WEIGHT) * words
        + F.lit(GARBLED_WEIGHT) * (F.lit(1.0) - F.least(garbled / F.lit(GARBLED_LIMIT), F.lit(1.0)))
    )
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), round_binary(raw, 3)))
    return F.when(letters.isNull(), 0.0).otherwise(bounded)


def quality_reason(letters: Column) -> Column:
    return (
        F.when(letters.isNull(), "No text")
        .when(letters > CLEAN_ABOVE, "clean")
        .otherwise(F.concat(F.lit("alpha="), percent_label(letters)))
    )
