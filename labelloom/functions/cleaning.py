"""Cleaning of extracted text.

All steps are JVM column expressions except compatibility normalisation, which
Spark has no function for. Only rows holding a character that normalisation
could touch are handed to Python; the others send a null.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from labelloom.functions.text import empty_if_null

# Control, format, private-use and surrogate characters plus U+FFFD, without
# line feed, carriage return and tab. Unassigned characters go in the Python
# step, where the Unicode version is the newer one.
UNWANTED = r"[\p{Cc}\p{Cf}\p{Co}\p{Cs}\x{FFFD}&&[^\n\r\t]]"

# Ranges of assigned characters that compatibility normalisation leaves alone
# and that never combine with a neighbour from these ranges.
STABLE_RANGES = (
    (0x0000, 0x007F), (0x00A1, 0x00A7), (0x00A9, 0x00A9), (0x00AB, 0x00AC),
    (0x00AE, 0x00AE), (0x00B0, 0x00B1), (0x00B6, 0x00B7), (0x00BB, 0x00BB),
    (0x00BF, 0x0131), (0x0134, 0x013E), (0x0141, 0x0148), (0x014A, 0x017E),
    (0x0391, 0x03A1), (0x03A3, 0x03CE), (0x0400, 0x0482), (0x048A, 0x052F),
    (0x05D0, 0x05EA), (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2022),
    (0x20AC, 0x20AC), (0x3001, 0x3003), (0x3041, 0x3096), (0x30A1, 0x30FE),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
)


def _outside(characters: str, stable: tuple[tuple[int, int], ...]) -> str:
    """The ``characters`` outside all ranges. Those come first, as they settle most of a text in one check."""
    return f"[{characters}&&[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in stable) + "]]"


_UNSTABLE = _outside(r"\x{80}-\x{10FFFF}", STABLE_RANGES)
# What is unwanted or unstable: beyond ASCII no unwanted character is in a stable range.
_ODD = _outside(r"\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{10FFFF}", STABLE_RANGES[1:])


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Character class of the code points this Python's Unicode leaves unassigned."""
    ranges, start = [], None
    for code in range(sys.maxunicode + 2):
        free = code <= sys.maxunicode and unicodedata.category(chr(code)) == "Cn"
        if free and start is None:
            start = code
        elif not free and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return re.compile("[" + "".join(ranges) + "]+")


@pandas_udf(StringType())
def _compatibility_form(texts: pd.Series) -> pd.Series:
    free = _unassigned()
    return texts.map(lambda t: unicodedata.normalize("NFKC", free.sub("", t)),
                     na_action="ignore")


def compatibility_form(text: Column) -> Column:
    """NFKC of ``text``, computed in Python only where it can differ."""
    return F.coalesce(_compatibility_form(F.when(text.rlike(_UNSTABLE), text)), text)


def drop_unwanted(text: Column) -> Column:
    return F.regexp_replace(text, UNWANTED, "")


def squeeze_blanks(text: Column) -> Column:
    """Runs of blanks become one space, three or more line feeds become two."""
    return F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n")


def drop_stray_lines(text: Column) -> Column:
    """Drop lines that hold something but fewer than two letters, then trim."""
    lines = F.filter(
        F.split(text, "\n"),
        lambda line: ~line.rlike(r"(?U)\S") | line.rlike(r"(?s)\p{L}[^\p{L}]*+\p{L}"),
    )
    # The look behind follows the character, as most characters are no white space.
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)\A\s+|\s(?<!\s\s)\s*+\z", "")


def clean_text(text: Column) -> Column:
    """The whole cleaning chain; null becomes an empty string.

    One search tells the texts that the first two steps could change; the others pass them by.
    """
    whole = empty_if_null(text)
    changed = compatibility_form(F.when(whole.rlike(_ODD), drop_unwanted(whole)))
    return drop_stray_lines(squeeze_blanks(F.coalesce(changed, whole)))
