"""Discounts over a table of invoices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import round_binary


def reject_reason(subtotal: Column, percent: Column) -> Column:
    """Why an invoice is refused; null for a valid one. NaN compares as large."""
    return (
        F.when(subtotal.isNull() | F.isnan(subtotal), "subtotal missing")
        .when(subtotal <= 0, "subtotal not positive")
        .when(F.isnan(percent) | (percent < 0) | (percent > 100), "discount outside 0 to 100")
    )


def checked(invoices: DataFrame) -> DataFrame:
    """Add the defaulted discount and ``reject_reason``. An absent percentage is 0."""
    percent = F.coalesce(F.col("discount_percent"), F.lit(0.0)).cast("double")
    return invoices.withColumn("discount_percent", percent).withColumn(
        "reject_reason", reject_reason(F.col("subtotal"), F.col("discount_percent")))


def invoices(requests: DataFrame) -> DataFrame:
    """Discount and total of the valid invoices, rounded to cents.

    The percentage is divided by 100, as a percentage discount means.
    """
    keep = [c for c in requests.columns if c not in ("subtotal", "discount_percent")]
    subtotal, percent = F.col("subtotal"), F.col("discount_percent")
    amount = subtotal * (percent / 100)
    figures = {"subtotal": subtotal, "discount_percent": percent, "discount_amount": amount,
               "total": subtotal - amount}
    valid = checked(requests).where(F.col("reject_reason").isNull())
    return valid.select(*keep, *[round_binary(v, 2).alias(name) for name, v in figures.items()])


def rejects(requests: DataFrame) -> DataFrame:
    """The refused invoices with the reason."""
    return checked(requests).where(F.col("reject_reason").isNotNull())
