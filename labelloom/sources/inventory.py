"""Listing of input documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder_listing(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """Files under ``folder`` with a suffix in any case: ``path, bytes``.

    The suffix is applied while listing and only path and length are selected,
    so no file is opened.
    """
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return documents_with_suffix(files, F.col("path"), F.col("length"), suffix)


def documents_with_suffix(listing: DataFrame, path: Column, size: Column,
                          suffix: str = ".pdf") -> DataFrame:
    """``path, bytes`` of the listed documents with a suffix, in path order."""
    return (
        listing.select(path.alias("path"), size.cast("long").alias("bytes"))
        .where(F.lower("path").endswith(suffix.lower()))
        .orderBy("path")
    )
