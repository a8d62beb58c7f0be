"""Co-located fact layout: bucket the fact tables on their join key once.

The report joins order lines to orders on the order key in several marts.
Writing both tables bucketed (and sorted) by that key into the same
number of buckets lets every later join read matching buckets side by
side: no shuffle of either fact table, however large. The tables are
external (their files live under the shared folder given by the caller,
e.g. ``spark.checkpoint.dir`` or a warehouse path), registered in the
session catalog by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """Write ``df`` as an external table bucketed and sorted by ``key``; return it."""
    (df.write.mode("errorifexists").format("parquet")
     .bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def colocate_facts(spark: SparkSession, facts: dict, buckets: int, base_path: str, prefix: str) -> dict:
    """Bucket several fact tables on their join keys with the same bucket count.

    ``facts`` maps name -> (DataFrame, key). Returns name -> catalog table name.
    Pick ``buckets`` so one bucket is a few hundred MB at full scale.
    """
    names = {}
    for name, (df, key) in facts.items():
        table = f"{prefix}_{name}"
        write_bucketed(df, table, key, buckets, f"{base_path.rstrip('/')}/{name}")
        names[name] = table
    return names
