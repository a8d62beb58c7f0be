"""Gap-free daily calendars and weekday profiles.

The spine is generated from one aggregated row (``sequence`` + ``explode``)
so its size is the number of days in the range — independent of the fact
table. Daily sales are aggregated (partial + final) before the spine join,
so the join sees at most one row per day on each side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, not_after, weekday_name, weekday_number
from ..functions.money import mean_half_up, to_money


def daily_totals(facts: DataFrame, ts: str = "created_at", value: str = "total",
                 where: Column | None = None) -> DataFrame:
    """date, sales: exact decimal sum per calendar day."""
    src = facts.where(where) if where is not None else facts
    return src.groupBy(F.to_date(ts).alias("date")).agg(F.sum(to_money(value)).alias("sales"))


def date_spine(bounds: DataFrame, start: str, end: str | dt.date) -> DataFrame:
    """One row per day from ``bounds[start]`` to ``end`` (inclusive).

    ``bounds`` is a one-row frame (e.g. ``agg(min(...))``); ``end`` is a
    literal date — the report never reads the clock implicitly.
    """
    end_lit = F.lit(as_date(end))
    days = F.when(F.col(start) <= end_lit, F.sequence(F.col(start), end_lit, F.expr("INTERVAL 1 DAY")))
    return bounds.select(F.explode(days).alias("date"))     # start after end (or no facts): no days


def sales_calendar(facts: DataFrame, end: str | dt.date, ts: str = "created_at", value: str = "total",
                   where: Column | None = None, spine_where: Column | None = None) -> DataFrame:
    """date, sales (0 on days without sales), weekday_number.

    The spine starts at the first day over *all* facts (or ``spine_where``),
    while sales are only the rows matching ``where`` up to ``end``.
    """
    end_d = as_date(end)
    bounds_src = facts.where(spine_where) if spine_where is not None else facts
    bounds = bounds_src.agg(F.min(F.to_date(ts)).alias("start"))
    spine = date_spine(bounds, "start", end_d)
    in_range = not_after(F.col(ts), end_d)          # ts < next midnight: pushed into the scan
    cond = in_range if where is None else (where & in_range)
    daily = daily_totals(facts, ts, value, cond)
    return (spine.join(daily, "date", "left")
            .select("date", F.coalesce(F.col("sales"), F.lit(0).cast("decimal(28,2)")).alias("sales"),
                    weekday_number(F.col("date")).alias("weekday_number")))


def weekday_profile(calendar: DataFrame) -> DataFrame:
    """weekday_number, weekday_name, avg_sale (half up, 2), days."""
    agg = calendar.groupBy("weekday_number").agg(F.sum("sales").alias("_s"), F.count("*").alias("days"))
    return agg.select("weekday_number", weekday_name(F.col("weekday_number")).alias("weekday_name"),
                      mean_half_up(F.col("_s"), F.col("days")).alias("avg_sale"), "days")


def weekday_profile_sale_days(daily: DataFrame) -> DataFrame:
    """Weekday means over days *with* sales only (the biased comparison)."""
    agg = (daily.withColumn("weekday_number", weekday_number(F.col("date")))
           .groupBy("weekday_number").agg(F.sum("sales").alias("_s"), F.count("*").alias("sale_days")))
    return agg.select("weekday_number", mean_half_up(F.col("_s"), F.col("sale_days")).alias("avg_sale_sale_days"),
                      "sale_days")


def worst_weekday(profile: DataFrame) -> DataFrame:
    """Lowest rounded mean; ties -> lowest weekday number (Monday first)."""
    return profile.orderBy(F.col("avg_sale").asc(), F.col("weekday_number").asc()).limit(1)


def calendar_stats(calendar: DataFrame) -> DataFrame:
    """calendar_days, zero_sales_days, first_day, last_day."""
    return calendar.agg(F.count("*").alias("calendar_days"),
                        F.count_if(F.col("sales") == 0).alias("zero_sales_days"),
                        F.min("date").alias("first_day"), F.max("date").alias("last_day"))
