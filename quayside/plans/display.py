"""pt-BR display tables (the report's seven text tables), built from the marts.

Only column expressions: formatting runs inside the executors' generated
code, not in Python per row. Positions are numbered after the top-k limit, so
the un-partitioned window sees at most k rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fmt


def channels_table(summary: DataFrame) -> DataFrame:
    """channel, revenue, revenue_compact, orders, avg_ticket, share."""
    return summary.select(
        "channel",
        fmt.format_brl(F.col("revenue")).alias("revenue"),
        fmt.format_compact_brl(F.col("revenue")).alias("revenue_compact"),
        fmt.format_int_pt(F.col("orders")).alias("orders"),
        fmt.format_brl(F.col("avg_ticket")).alias("avg_ticket"),
        fmt.format_percent_pt(F.col("share")).alias("share"))


def channels_yearly_table(yearly: DataFrame) -> DataFrame:
    """year and each channel's revenue (the report's channel table)."""
    return yearly.select(F.col("year").cast("string").alias("year"),
                         *[fmt.format_brl(F.col(f"`{c}`")).alias(c) for c in yearly.columns if c != "year"])


def customers_table(top: DataFrame) -> DataFrame:
    """customer_id, average ticket, orders, categories."""
    return top.select(F.col("customer_id").cast("string").alias("customer_id"), fmt.format_brl(F.col("avg_ticket")).alias("avg_ticket"),
                      fmt.format_int_pt(F.col("frequency")).alias("orders"), fmt.format_int_pt(F.col("category_diversity")).alias("categories"))


def weekday_table(profile: DataFrame) -> DataFrame:
    """weekday, average sale, days in the calendar."""
    return profile.select("weekday_name", fmt.format_brl(F.col("avg_sale")).alias("avg_sale"), fmt.format_int_pt(F.col("days")).alias("days"))


def recommendations_table(similar: DataFrame) -> DataFrame:
    """position, name, similarity with 6 decimals — for a top-k frame (bounded) with names."""
    w = Window.orderBy(F.col("similarity").desc(), F.col("product_id").asc())
    return similar.select(F.row_number().over(w).cast("string").alias("position"), "name",
                          fmt.format_decimal_pt(F.col("similarity"), 6).alias("similarity"))


def suppliers_table(worst: DataFrame) -> DataFrame:
    """label, on-time share, orders, mean delay of late orders in days."""
    return worst.select(
        "label", fmt.format_percent_pt(F.col("on_time_rate")).alias("on_time"),
        fmt.format_int_pt(F.col("orders")).alias("orders"),
        F.concat(fmt.format_decimal_pt(F.col("avg_late_days"), 1), F.lit(" dias")).alias("avg_late_days"))


def forecast_table(walk: DataFrame) -> DataFrame:
    """month (yyyy-MM), actual, forecast (2 decimals), rounded, absolute error (2 decimals)."""
    return walk.select(
        "product_name", F.date_format("month", "yyyy-MM").alias("month"),
        fmt.format_int_pt(F.col("actual")).alias("actual"),
        fmt.format_decimal_pt(F.col("forecast"), 2).alias("forecast"),
        fmt.format_int_pt(F.col("forecast_rounded")).alias("forecast_rounded"),
        fmt.format_decimal_pt(F.col("abs_error"), 2).alias("abs_error"))


def returns_table(by_reason: DataFrame) -> DataFrame:
    return by_reason.select("reason", fmt.format_int_pt(F.col("returns")).alias("returns"),
                            fmt.format_brl(F.col("refund")).alias("refund"))
