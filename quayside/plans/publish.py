"""Publishing a report as one commit: a folder for each version, checks while writing, a manifest last.

A reader follows the manifest, so it sees all tables of one version or all of
another, never a mixture. A publisher that fails, or whose figures do not meet
the expectations, leaves a folder that no manifest names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from .marts import PUBLISHED_COLUMNS
from . import params as P

ALLOWED = PUBLISHED_COLUMNS | set(P.CHANNELS)
MANIFEST = "version bigint, run string, mart string, folder string, n_rows bigint"

#: What the write of each mart observes, by check name; each metric is taken by the write itself, in its one pass.
METRICS: dict[str, dict[str, Column | str]] = {
    "channel_summary": {"business_orders": "sum(orders)", "total_revenue": "sum(revenue)"},
    "calendar_stats": {"calendar_days": "max(calendar_days)", "zero_sales_days": "max(zero_sales_days)"},
    "weekday_calendar": {"weekday_days": "sum(days)"},
    "returns_by_reason": {"completed_returns": "sum(returns)", "refund_total": "sum(refund)"},
    "supplier_overall": {"completed_purchase_orders": "max(completed_orders)", "late_purchase_orders": "max(late_orders)"},
    "supplier_scores": {"supplier_orders": "sum(orders)"},
    "loyal_customers": {"listed_customers": "count(*)"},
}


def observed_write(df: DataFrame, path: str, metrics: dict) -> dict:
    """Write ``df`` in a total order and return the metrics (and ``n_rows``) that the write observed.

    The metrics are taken after the sort: in front of it, the job that
    samples the sort's ranges would be observed as well.
    """
    seen = Observation()
    columns = [F.count(F.lit(1)).alias("n_rows"), *[F.expr(e).alias(k) for k, e in metrics.items()]]
    df.orderBy(*df.columns).observe(seen, *columns).write.mode("errorifexists").parquet(path)
    return seen.get


def facts_frame(spark: SparkSession, facts: dict) -> DataFrame:
    """(check_name, value) of observed metrics: one row for each."""
    rows = [(k, None if v is None else float(v)) for k, v in facts.items()]
    return spark.createDataFrame(rows, "check_name string, value double")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def latest(spark: SparkSession, out_dir: str) -> list:
    """The manifest rows of the newest version; none where nothing was published."""
    if not _exists(spark, f"{out_dir}/manifests"):
        return []
    manifest = spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifests")
    newest = manifest.agg(F.max(F.struct("version", "run")).alias("m")).collect()[0]["m"]
    return [] if newest is None else manifest.where((F.col("version") == newest["version"]) & (F.col("run") == newest["run"])).collect()


def read_report(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """{mart: frame} of the newest version that was published whole."""
    return {r["mart"]: spark.read.parquet(f"{out_dir}/{r['folder']}/{r['mart']}") for r in latest(spark, out_dir)}


class Version:
    """A version being written: :meth:`write` tables, then :meth:`commit`."""

    def __init__(self, spark: SparkSession, out_dir: str, allowed=ALLOWED, metrics: dict | None = None):
        self.spark, self.out_dir, self.allowed = spark, out_dir.rstrip("/"), allowed
        self.metrics = METRICS if metrics is None else metrics
        self.run = uuid.uuid4().hex
        self.folder = f"versions/{self.run}"
        self.rows: dict[str, int] = {}
        self.facts: dict[str, object] = {}

    def path(self, name: str) -> str:
        return f"{self.out_dir}/{self.folder}/{name}"

    def write(self, marts: dict[str, DataFrame]) -> dict[str, str]:
        """Write marts, observing their metrics; one with a column that is not listed refuses them all before any write."""
        leaks = {name: found for name, df in marts.items() if (found := quality.aggregate_only(df, self.allowed))}
        if leaks:
            raise ValueError(f"marts have columns that are not listed for publishing: {leaks}")
        for name, df in marts.items():
            seen = observed_write(df, self.path(name), self.metrics.get(name, {}))
            self.rows[name] = seen.pop("n_rows")
            self.facts |= seen
        return {name: self.path(name) for name in marts}

    def read(self) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(self.path(name)) for name in self.rows}

    def checked(self, expected: DataFrame, tolerance: float = 0.0) -> DataFrame:
        """Every expectation (check_name, label, expected) against the observed metrics, failures included."""
        return quality.evaluate_expectations(facts_frame(self.spark, self.facts), expected, tolerance)

    def require(self, expected: DataFrame, tolerance: float = 0.0) -> None:
        failed = sorted(r["check_name"] for r in self.checked(expected, tolerance).where(~F.col("ok")).collect())   # a row a check
        if failed:
            raise AssertionError(f"report expectations failed: {failed}")

    def commit(self) -> int:
        """Make this version the one that readers see; returns its number. One small file, written at once."""
        before = latest(self.spark, self.out_dir)
        number = 1 + max((r["version"] for r in before), default=0)
        rows = [(number, self.run, name, self.folder, n) for name, n in sorted(self.rows.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.out_dir}/manifests")
        return number


def publish_report(spark: SparkSession, marts: dict[str, DataFrame], out_dir: str, expected: DataFrame | None = None,
                   tolerance: float = 0.0, allowed=ALLOWED, metrics: dict | None = None) -> int:
    """Write, check and commit; raises with every failed expectation at once, and then nothing is published."""
    version = Version(spark, out_dir, allowed, metrics)
    version.write(marts)
    if expected is not None:
        version.require(expected, tolerance)
    return version.commit()
