"""Table scans and the overwrite sink.

A stored table is a catalog view on a folder with one version of its rows. Overwriting
writes a new version beside the old one, reads back how many rows arrived, and only
then points the name to it, which is one catalog operation. So a job that fails halfway
leaves the old rows readable, a reader of the old version goes on undisturbed, and a table
may be overwritten with rows that are read from itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from labelloom.session import shared_folder


class IncompleteWrite(RuntimeError):
    """Fewer or more rows were read back than written."""


def table(spark: SparkSession, name: str) -> DataFrame:
    """Rows of a catalog table (``a.b.c``) or of a Parquet path."""
    if "/" in name:
        return spark.read.parquet(name)
    return spark.table(name)


def named_view(df: DataFrame, name: str) -> DataFrame:
    """Register ``df`` as a session view; nothing is computed yet."""
    df.createOrReplaceTempView(name)
    return df


def write_version(df: DataFrame, folder: str, source_format: str = "parquet") -> tuple[str, int]:
    """Write ``df`` to a new folder below ``folder`` and check it; the path and its rows.

    The count rides on the write itself, so the rows are computed once.
    """
    path = f"{folder.rstrip('/')}/version-{uuid.uuid4().hex}"
    written = Observation(f"rows written to {path}")
    df.observe(written, F.count(F.lit(1)).alias("n")).write.format(source_format).save(path)
    rows = written.get["n"]
    arrived = df.sparkSession.read.format(source_format).schema(df.schema).load(path).count()
    if arrived != rows:
        raise IncompleteWrite(f"{path}: {rows} rows written, {arrived} read back")
    return path, rows


def overwrite_table(df: DataFrame, name: str, source_format: str = "parquet", folder: str | None = None) -> int:
    """Replace a table, schema included, and return how many rows went in.

    Versions lie below ``folder``, by default in the shared folder. A name that is taken
    by a table that this sink did not make is refused.
    """
    spark = df.sparkSession
    base = folder or f"{shared_folder(spark).rstrip('/')}/tables/{name}"
    path, rows = write_version(df, base, source_format)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {source_format}.`{path}`")
    return rows


def remove_table(spark: SparkSession, name: str) -> None:
    """Take the name out of the catalog; the versions' files stay for readers at work."""
    spark.sql(f"DROP VIEW IF EXISTS {name}")


def stored_rows(spark: SparkSession, name: str) -> int:
    """Read-back row count of a stored table."""
    return spark.table(name).count()
