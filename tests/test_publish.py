"""Versioned publishing: one commit, checks observed while writing, gates."""

import pytest
from pyspark.sql import functions as F

from quayside.plans import marts, publish
from quayside.plans.model import star_model

SF = "/root/testdata/sf0.001"
EXPECTED = "check_name string, label string, expected double"


def frames(spark, n):
    return {"channel_summary": spark.range(n).select(F.format_string("c%d", "id").alias("channel"), F.col("id").alias("orders"), (F.col("id") * 1.5).alias("revenue")),
            "calendar_stats": spark.sql(f"SELECT {n} AS calendar_days, 2 AS zero_sales_days")}


def read(spark, out):
    return {name: df.count() for name, df in publish.read_report(spark, out).items()}


def test_a_reader_sees_the_newest_whole_version(spark, scratch):
    assert publish.read_report(spark, scratch) == {}
    assert publish.publish_report(spark, frames(spark, 5), scratch) == 1
    assert read(spark, scratch) == {"channel_summary": 5, "calendar_stats": 1}
    assert publish.publish_report(spark, frames(spark, 7), scratch) == 2
    assert read(spark, scratch) == {"channel_summary": 7, "calendar_stats": 1}


def test_a_publisher_that_fails_midway_changes_nothing(spark, scratch):
    publish.publish_report(spark, frames(spark, 5), scratch)
    broken = frames(spark, 9)
    broken["calendar_stats"] = spark.range(1).select(F.lit(1).alias("calendar_days"), F.raise_error(F.lit("lost")).cast("int").alias("zero_sales_days"))
    with pytest.raises(Exception, match="lost"):
        publish.publish_report(spark, broken, scratch)
    assert read(spark, scratch) == {"channel_summary": 5, "calendar_stats": 1}


def test_metrics_are_those_of_the_written_rows(spark, scratch):
    version = publish.Version(spark, scratch)
    version.write(frames(spark, 300))
    assert version.facts == {"business_orders": 44850, "total_revenue": 67275.0, "calendar_days": 300, "zero_sales_days": 2}
    assert version.rows == {"channel_summary": 300, "calendar_stats": 1}


def test_every_failed_expectation_is_named_and_nothing_published(spark, scratch):
    publish.publish_report(spark, frames(spark, 5), scratch)
    expected = spark.createDataFrame([("business_orders", "a", 10.0), ("calendar_days", "b", 99.0), ("missing_figure", "c", 1.0)], EXPECTED)
    with pytest.raises(AssertionError, match=r"\['calendar_days', 'missing_figure'\]"):
        publish.publish_report(spark, frames(spark, 5), scratch, expected)
    assert publish.latest(spark, scratch)[0]["version"] == 1
    assert publish.publish_report(spark, frames(spark, 5), scratch, expected.where("check_name = 'business_orders'")) == 2


def test_a_column_that_is_not_listed_refuses_the_whole_report(spark, scratch):
    leak = frames(spark, 5) | {"z": spark.sql("SELECT 1 AS orders, 'a@b' AS email")}
    with pytest.raises(ValueError, match="email"):
        publish.publish_report(spark, leak, scratch)
    assert publish.read_report(spark, scratch) == {}


def test_snapshot_expectations_hold_for_the_report(spark, scratch):
    model = star_model(spark, SF)
    version = publish.Version(spark, scratch)
    version.write(marts.build_marts(model))
    rows = version.checked(marts.snapshot_expectations(spark, model)).collect()
    assert len(rows) == 9 and all(r["ok"] for r in rows)
    assert version.facts["listed_customers"] <= 10


def test_raw_figures_count_physical_tables(spark):
    model = star_model(spark, SF)
    n, counts = marts.raw_counts(model)
    assert n == 4 and sorted(c.first()["n"] for c in counts) == sorted(spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "lineitem", "part", "supplier"))
