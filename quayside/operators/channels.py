"""Channel performance: month x channel, per-channel summary, yearly pivot.

Shares use an uncorrelated scalar subquery for the grand total (one row,
computed once) instead of a window over all rows or a cross join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start, not_after
from ..functions.money import mean_half_up, to_money


def business_orders(orders: DataFrame, statuses, cutoff_day: str | dt.date,
                    status: str = "status", ts: str = "created_at") -> DataFrame:
    """Orders in the given statuses (``None`` = all) up to the end of the cutoff day."""
    cond = not_after(F.col(ts), cutoff_day)
    if statuses is not None:
        cond = cond & F.col(status).isin(list(statuses))
    return orders.where(cond)


def channel_monthly(orders: DataFrame, channel: str = "channel", ts: str = "created_at",
                    total: str = "total") -> DataFrame:
    """month, channel, revenue, orders."""
    return (orders.groupBy(month_start(F.col(ts)).alias("month"), F.col(channel).alias("channel"))
            .agg(F.sum(to_money(total)).alias("revenue"), F.count("*").alias("orders")))


def channel_summary(orders: DataFrame, channel: str = "channel", total: str = "total") -> DataFrame:
    """channel, revenue, orders, avg_ticket (half up, 2), share of revenue."""
    agg = (orders.groupBy(F.col(channel).alias("channel"))
           .agg(F.sum(to_money(total)).alias("revenue"), F.count("*").alias("orders")))
    grand = agg.select(F.sum("revenue").cast("double")).scalar()   # from the per-channel rows
    return agg.select("channel", "revenue", "orders",
                      mean_half_up(F.col("revenue"), F.col("orders")).alias("avg_ticket"),
                      (F.col("revenue").cast("double") / grand).alias("share"))


def channel_yearly_pivot(monthly: DataFrame, channels, value: str = "revenue",
                         names: dict | None = None) -> DataFrame:
    """year x channel pivot of ``value`` with explicit channel values, 0 when absent.

    Roll-up month -> year happens before the pivot; the explicit value list
    avoids the extra distinct job Spark runs to discover pivot columns.
    """
    yearly = monthly.groupBy(F.year("month").alias("year"), "channel").agg(F.sum(value).alias("v"))
    piv = yearly.groupBy("year").pivot("channel", list(channels)).agg(F.first("v"))
    names = names or {}
    out = [F.col("year")]
    for ch in channels:
        out.append(F.coalesce(F.col(f"`{ch}`"), F.lit(0).cast("decimal(28,2)")).alias(names.get(ch, ch)))
    return piv.select(*out)


def ticket_gap(summary: DataFrame, a: str, b: str) -> DataFrame:
    """|avg ticket of channel a - avg ticket of channel b| in one aggregate pass."""
    return summary.agg(F.abs(F.max(F.when(F.col("channel") == a, F.col("avg_ticket")))
                             - F.max(F.when(F.col("channel") == b, F.col("avg_ticket")))).alias("ticket_gap"))
