"""Incremental daily / monthly sales with Structured Streaming.

The batch report recomputes everything from the cutoff; as orders arrive
as new files, the same daily (E5) and month x channel (E8) totals can be
kept up to date incrementally:

* ``daily_partials_stream``: each micro-batch aggregates its own rows per
  (day, channel) and writes them under ``batch_id=<n>`` with overwrite —
  a replayed batch after an executor or driver loss rewrites the same
  folder, so the sink is idempotent (exactly-once with the checkpoint).
  No streaming state is kept, so late or out-of-order files are simply
  more partials.
* ``daily_totals``: re-aggregates the partials (small: days x channels per
  batch) into final totals; ``monthly_from_daily`` rolls them up.
* ``windowed_daily_sales``: the stateful alternative with an event-time
  watermark, for append-mode sinks that must emit each day once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.money import to_money


def order_stream(spark: SparkSession, directory: str, schema, glob: str = "*.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files arriving at ``directory`` as a stream (explicit schema).

    ``directory`` is a folder of part files or a single file. It is passed as
    a pattern that matches only itself, because the file source takes plain
    paths of folders only.
    """
    directory = directory.rstrip("/")
    if not set("*?[{") & set(directory):
        directory = f"{directory[:-1]}[{directory[-1]}]"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def _partials(batch: DataFrame, ts: str, channel: str, total: str) -> DataFrame:
    return (batch.groupBy(F.to_date(ts).alias("date"), F.col(channel).alias("channel"))
            .agg(F.sum(to_money(total)).alias("revenue"), F.count("*").alias("orders")))


def daily_partials_stream(stream: DataFrame, out_dir: str, checkpoint: str, ts: str = "created_at",
                          channel: str = "channel", total: str = "total",
                          available_now: bool = True) -> StreamingQuery:
    """Start the incremental job; returns the running query."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (_partials(batch, ts, channel, total)
         .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def daily_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """Final (date, channel, revenue, orders) from all written partials."""
    parts = spark.read.parquet(out_dir)
    return parts.groupBy("date", "channel").agg(F.sum("revenue").alias("revenue"),
                                                F.sum("orders").alias("orders"))


def monthly_from_daily(daily: DataFrame) -> DataFrame:
    return (daily.groupBy(F.trunc("date", "MM").alias("month"), "channel")
            .agg(F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders")))


def windowed_daily_sales(stream: DataFrame, ts: str = "created_at", channel: str = "channel",
                         total: str = "total", lateness: str = "2 days") -> DataFrame:
    """Stateful event-time version: one row per closed (day, channel) window.

    Watermarks need a zoned timestamp; with the UTC session clock the cast
    from ``timestamp_ntz`` keeps the wall-clock value.
    """
    return (stream.withColumn("_event_time", F.col(ts).cast("timestamp"))
            .withWatermark("_event_time", lateness)
            .groupBy(F.window("_event_time", "1 day").alias("w"), F.col(channel).alias("channel"))
            .agg(F.sum(to_money(total)).alias("revenue"), F.count("*").alias("orders"))
            .select(F.to_date(F.col("w.start")).alias("date"), "channel", "revenue", "orders"))
