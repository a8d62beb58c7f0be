"""Incremental daily sales: stream result equals the batch aggregate."""

import datetime as dt
import os
from decimal import Decimal

from pyspark.sql import functions as F

from quayside.streaming import incremental


def test_incremental_partials_match_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    rows = [(dt.datetime(2024, 1, d % 3 + 1, 10), "pos" if d % 2 else "web", float(d)) for d in range(1, 13)]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, channel string, total double")
    first = df.orderBy("total").limit(6)
    first.coalesce(1).write.parquet(src)
    df.subtract(first).coalesce(1).write.mode("append").parquet(src)
    stream = incremental.order_stream(spark, src, df.schema, max_files_per_trigger=1)
    q = incremental.daily_partials_stream(stream, os.path.join(scratch, "out"), os.path.join(scratch, "ck"))
    q.awaitTermination()
    got = {(r["date"], r["channel"]): (r["revenue"], r["orders"])
           for r in incremental.daily_totals(spark, os.path.join(scratch, "out")).collect()}
    want = {(r["date"], r["channel"]): (r["revenue"], r["orders"]) for r in
            df.groupBy(F.to_date("created_at").alias("date"), "channel")
              .agg(F.sum(F.col("total").cast("decimal(18,2)")).alias("revenue"), F.count("*").alias("orders")).collect()}
    assert {k: (Decimal(v[0]), v[1]) for k, v in got.items()} == {k: (Decimal(v[0]), v[1]) for k, v in want.items()}
    monthly = incremental.monthly_from_daily(incremental.daily_totals(spark, os.path.join(scratch, "out")))
    assert monthly.agg(F.sum("orders")).first()[0] == 12


def test_windowed_variant_is_a_valid_streaming_plan(spark, scratch):
    src = os.path.join(scratch, "in2")
    spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), "pos", 1.0)],
                          "created_at timestamp_ntz, channel string, total double").write.parquet(src)
    schema = spark.read.parquet(src).schema
    agg = incremental.windowed_daily_sales(incremental.order_stream(spark, src, schema))
    assert agg.isStreaming and agg.columns == ["date", "channel", "revenue", "orders"]


def test_a_table_that_is_a_folder_of_part_files_streams_like_a_file(spark, scratch):
    from quayside.plans.queries import QUERIES
    from quayside.sources.tables import read_table
    read_table(spark, "/root/testdata/sf0.001", "orders").repartition(3).write.parquet(f"{scratch}/orders.parquet")
    one, many = ({tuple(r) for r in QUERIES["streaming_monthly_channel_sales"](spark, d).collect()} for d in ("/root/testdata/sf0.001", scratch))
    assert one == many and one
