"""Scalar text expressions used when tables are joined and features are built."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def name_stem(name: Column) -> Column:
    """File name in lower case without its last extension; the join key."""
    return F.lower(F.regexp_replace(name, r"\.[^.]+$", ""))


def has_text(text: Column) -> Column:
    """True when something other than spaces is there."""
    return F.length(F.trim(empty_if_null(text))) > 0


def feature_text(subtype: Column, classification: Column, summary: Column,
                 key_terms: Column) -> Column:
    """Model input. Every part keeps its separating space, also when empty."""
    parts = (subtype, classification, summary, F.array_join(key_terms, " "))
    return F.concat_ws(" ", *[empty_if_null(part) for part in parts])


def baseline_text(title: Column, object_name: Column) -> Column:
    """Model input of the comparison run: names only."""
    return F.concat_ws(" ", empty_if_null(title), empty_if_null(object_name))


def summary_text(summary: Column, subtype: Column) -> Column:
    """Model input of the summary-only run."""
    joined = F.concat(empty_if_null(summary), F.lit(" "), empty_if_null(subtype))
    return F.regexp_replace(joined, r"(?U)^\s+|(?<!\s)\s++\z", "")


def scoring_text(summary: Column, key_terms: Column, subtype: Column | None = None,
                 classification: Column | None = None) -> Column:
    """Model input at scoring time; give the metadata where it is known."""
    if subtype is None and classification is None:
        return F.concat_ws(" ", empty_if_null(summary),
                           empty_if_null(F.array_join(key_terms, " ")))
    missing = F.lit("")
    return feature_text(missing if subtype is None else subtype,
                        missing if classification is None else classification,
                        summary, key_terms)


def leading_terms(terms: Column, n: int, otherwise: str = "") -> Column:
    """The first ``n`` terms as one comma-separated string."""
    return F.when(F.size(terms) > 0, F.array_join(F.slice(terms, 1, n), ", ")).otherwise(otherwise)


def round_binary(value: Column, digits: int) -> Column:
    """Round a double by its exact binary value, ties to even.

    ``round`` and ``bround`` go through the shortest decimal form, where 2.675
    is a tie although the stored double lies below it. Decimal formatting looks
    at the stored value. It drops numbers below one unit of the last place to
    zero, so those are compared with half a unit instead.
    """
    unit = float(Decimal(1).scaleb(-digits))
    half = float(Decimal(5).scaleb(-digits - 1))
    up_at_half = Decimal(half) > Decimal(5).scaleb(-digits - 1)
    size = F.abs(value)
    above = size >= half if up_at_half else size > half
    pattern = "0." + "0" * digits if digits else "0"
    formatted = F.call_function("format_number", value, F.lit(pattern)).cast("double")
    small = F.when(above, F.signum(value) * F.lit(unit)).otherwise(F.lit(0.0))
    return F.when(size < unit, small).otherwise(formatted)


def percent_label(ratio: Column) -> Column:
    """A ratio as a whole percentage, such as ``37%``."""
    return F.concat(F.call_function("format_number", ratio * 100, F.lit("0")), F.lit("%"))
