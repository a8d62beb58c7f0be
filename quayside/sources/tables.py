"""Parquet table access for the test star schema.

Reads are lazy; callers ``select`` what they need and Catalyst prunes the
Parquet ``ReadSchema`` and pushes filters into the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

DEFAULT_SF_DIR = "/root/testdata/sf0.001"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_RELATIONS: dict[tuple[int, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet relation, resolved once per session and path.

    Resolving a relation lists files and reads footers on the driver; the
    report builds many plans over the same few tables, so the (immutable,
    lazy) DataFrame is reused instead of re-resolved.
    """
    key = (id(spark._jsparkSession), table_path(sf_dir, name))
    df = _RELATIONS.get(key)
    if df is None:
        df = spark.read.parquet(key[1])
        _RELATIONS[key] = df
    return df


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose every table as a temp view (for ``spark.sql`` paths)."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
