"""Intermediate tables on the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder exists, a local session
    (as in tests) gets a private folder; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's ``options``, to shared scratch and read it back.

    Cuts the lineage: whatever is lost later is recomputed from the written
    table, and stages that use the frame twice do not run its plan twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever it lies on the driver; once per Spark context."""
    import os
    import zipfile

    context = spark.sparkContext
    # rows are whole documents: batches for Python are bounded by bytes, unless the user has set a bound
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    if getattr(context, "_quayside_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="quayside-"), "quayside.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    context._quayside_shipped = True
