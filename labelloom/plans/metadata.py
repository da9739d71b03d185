"""Document metadata with resolved label sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.operators.keyed import smallest_per_key
from labelloom.operators.set_join import names_of_ids

KEYS = ["source_id", "title", "classification", "doc_subtype", "object_name", "attachment_path"]


def metadata(documents: DataFrame, attachments: DataFrame, source_details: DataFrame,
             areas: DataFrame, regulations: DataFrame) -> DataFrame:
    """One row per document with its area and regulation names as sets.

    Grouping is on all six columns, so copies of a document that agree in them
    merge, and nulls in them group together.
    """
    titled = documents.where(F.col("title").isNotNull() & F.col("classification").isNotNull())
    base = (
        titled.join(smallest_per_key(attachments, "source_id", "attachment_path"),
                    "source_id", "left")
        .join(smallest_per_key(source_details, "source_id", "object_name"), "source_id", "left")
    )
    return names_of_ids(base, KEYS, {"area_names": ("area_ids", areas),
                                     "regulation_names": ("regulation_ids", regulations)})


def one_row_per_label(meta: DataFrame) -> DataFrame:
    """Metadata exploded to one row per area name; documents without one drop out."""
    others = [c for c in meta.columns if c != "area_names"]
    return meta.select(*others, F.explode("area_names").alias("label")).where(
        F.col("label").isNotNull())
