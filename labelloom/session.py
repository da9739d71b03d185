"""Session settings and the shared staging folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime SQL settings the jobs rely on. AQE sizes reduce tasks, turns a join
# into a broadcast only after it has seen the real size of a side, and splits
# hot partitions of a shuffled join; the force flag keeps that split even when
# a later aggregate then needs one more exchange.
# Collecting label sets by hash instead of by sort pays up to far more groups
# per task than the default of 128.
# Texts may be long, so a batch for a Python function is bounded by rows and bytes.
RUNTIME_SETTINGS = {
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python functions import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="labelloom-"), "labelloom"), "zip",
        root_dir=os.path.dirname(package), base_dir=os.path.basename(package))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and ship the package."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(app: str, cores: str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", extra: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    A local session that names none gets a temporary folder; elsewhere executors
    would each write to a disk of their own, so there it is an error.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError(f"name a folder that all executors share in {key}")
        folder = tempfile.mkdtemp(prefix="labelloom-")
        spark.conf.set(key, folder)
    return folder


def stage(df: DataFrame, name: str, files: int | None = None, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several later jobs need the same rows: the lineage is cut, lost
    executors only re-read files, and each reader still prunes columns. ``files``
    deals the rows over that many files when they are written, for tables whose
    readers do CPU-bound work. A reader knows the table's size in bytes, so Spark
    broadcasts a small one by its own threshold. ``schema`` names the types to read the
    columns as, where they are stored alike, such as a vector for its struct.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df if files is None else df.repartition(files)).write.parquet(path)
    return spark.read.schema(df.schema if schema is None else schema).parquet(path)
