"""Supplier punctuality.

A purchase order is complete at its *last* receipt not after the cutoff;
delay is whole days between that receipt's date and the promised date;
on time means delay <= 0. Orders with no such receipt, or with no
promised date, drop out. Mean delay is over late orders only (0.0 if none).

Plan: receipts are reduced to ``max`` per order (partial aggregation
map-side), then inner-joined to the eligible orders on the same keys —
both sides come out of the aggregation hash-partitioned by those keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import not_after
from ..functions.fmt import display_name, supplier_label


def completed_orders(purchase_orders: DataFrame, receipts: DataFrame, cutoff_day: str | dt.date,
                     keys=("po_id",), received_status: str = "received") -> DataFrame:
    """keys..., supplier_id, completed_at, expected_delivery_at, delay_days, on_time."""
    keys = list(keys)
    pos = purchase_orders.where((F.col("status") == received_status)
                                & not_after(F.col("placed_at"), cutoff_day)
                                & F.col("expected_delivery_at").isNotNull())
    # max per order first (map-side partial: many receipts -> one row per
    # order before the shuffle); the inner join below keeps eligible orders
    rec = (receipts.where(not_after(F.col("received_at"), cutoff_day))
           .groupBy(*keys).agg(F.max("received_at").alias("completed_at")))
    return with_delay(pos.join(rec, keys), keys)


def with_delay(completed: DataFrame, keys) -> DataFrame:
    """Delay and punctuality of orders with their last receipt and promised date (both not null)."""
    delay = F.date_diff(F.to_date("completed_at"), F.to_date("expected_delivery_at"))
    extra = [k for k in keys if k != "supplier_id"]
    return (completed.where(F.col("completed_at").isNotNull() & F.col("expected_delivery_at").isNotNull())
            .select(*extra, "supplier_id", "completed_at", "expected_delivery_at", delay.alias("delay_days"))
            .withColumn("on_time", F.col("delay_days") <= 0))


def completed_orders_of(model, cutoff_day: str | dt.date) -> DataFrame:
    """Completed orders of a model: from its one-pass form where it has one, else by joining orders and receipts."""
    one_pass = getattr(model, "received_orders", None)
    if one_pass is not None:
        return with_delay(one_pass(cutoff_day), model.po_keys)
    return completed_orders(model.purchase_orders, model.receipts, cutoff_day, keys=model.po_keys)


def _late_mean(delay: str = "delay_days"):
    return F.coalesce(F.avg(F.when(F.col(delay) > 0, F.col(delay))), F.lit(0.0))


def supplier_scores(completed: DataFrame, suppliers: DataFrame) -> DataFrame:
    """supplier_id, label, orders, on_time_rate, avg_late_days."""
    per = completed.groupBy("supplier_id").agg(
        F.count("*").alias("orders"),
        F.avg(F.col("on_time").cast("double")).alias("on_time_rate"),
        _late_mean().alias("avg_late_days"))
    names = suppliers.select("supplier_id",
                             display_name(F.col("trade_name"), F.col("legal_name")).alias("supplier_name"))
    return (per.join(names, "supplier_id", "left")
            .select("supplier_id", supplier_label(F.col("supplier_id"), F.col("supplier_name")).alias("label"),
                    "orders", "on_time_rate", "avg_late_days"))


def worst_suppliers(scores: DataFrame, k: int = 8) -> DataFrame:
    """Bottom-k: on-time rate asc, orders desc, supplier id asc."""
    return scores.orderBy(F.col("on_time_rate").asc(), F.col("orders").desc(),
                          F.col("supplier_id").asc()).limit(k)


def supplier_overall(completed: DataFrame) -> DataFrame:
    """completed_orders, late_orders, on_time_rate, avg_late_days (one row)."""
    return completed.agg(F.count("*").alias("completed_orders"),
                         F.count_if(~F.col("on_time")).alias("late_orders"),
                         F.avg(F.col("on_time").cast("double")).alias("on_time_rate"),
                         _late_mean().alias("avg_late_days"))
