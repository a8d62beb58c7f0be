"""Monthly demand series and moving-average forecasts, for every key at once.

Each series is made gap-free from its first month to a given end month
in one pass (each sale month emits the empty months up to the next sale).
Because the series is dense, a row frame ``rowsBetween(-w, -1)`` is
exactly "the w previous months". Windows are always partitioned by the
series key, so one task holds one product's months (tens to hundreds of
rows after the monthly aggregation), never the whole table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_months, as_date, month_floor, month_start, ntz_literal


def monthly_demand(lines: DataFrame, key: str = "name", ts: str = "created_at",
                   quantity: str = "quantity", before=None) -> DataFrame:
    """key, month, quantity: sum per calendar month, rows with ts < ``before``."""
    src = lines
    if before is not None:
        bound = as_date(before)
        src = src.where(F.col(ts) < ntz_literal(dt.datetime(bound.year, bound.month, bound.day)))
    return (src.groupBy(F.col(key), month_start(F.col(ts)).alias("month"))
            .agg(F.sum(quantity).alias("quantity")))


def dense_months(monthly: DataFrame, end_month, key: str = "name") -> DataFrame:
    """Fill every month from each key's first month to ``end_month`` (0 if absent).

    One pass, no self-join: each sale month emits itself plus the empty
    months up to the key's next sale month (``lead``), the last one up to
    ``end_month``. The window is partitioned by key over already
    aggregated months.
    """
    end = month_floor(end_month)
    w = Window.partitionBy(key).orderBy("month")
    rows = monthly.where(F.col("month") <= F.lit(end))
    stop = F.coalesce(F.add_months(F.lead("month").over(w), -1), F.lit(end))
    spans = rows.select(key, "month", "quantity", stop.alias("_stop"))
    filled = spans.select(key, F.col("month").alias("_sale"), "quantity",
                          F.explode(F.sequence("month", "_stop", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return filled.select(key, "month", F.when(F.col("month") == F.col("_sale"), F.col("quantity"))
                         .otherwise(F.lit(0)).alias("quantity"))


def trailing_mean(dense: DataFrame, key: str = "name", window: int = 3, min_periods: int = 1) -> DataFrame:
    """Adds ``forecast``: mean of the ``window`` previous months.

    ``min_periods=1`` is "up to w months of history" (walk-forward with a
    growing history); ``min_periods=window`` is the strict rolling mean.
    """
    w = Window.partitionBy(key).orderBy("month").rowsBetween(-window, -1)
    n = F.count("quantity").over(w)
    return dense.withColumn("forecast", F.when(n >= min_periods, F.avg("quantity").over(w)))


def forecast_frame(dense: DataFrame, train_end, test_months: int, key: str = "name", window: int = 3,
                   min_periods: int = 1) -> DataFrame:
    """Test months with both protocols side by side, from one pass over the series.

    ``forecast``: walk-forward mean of the ``window`` previous months (each
    test month sees the actuals of earlier test months). ``forecast_fixed``:
    one mean of the last ``window`` training months, repeated (a
    partition-wide conditional mean, so no join back to the series).
    """
    end = month_floor(train_end)
    first, last = add_months(end, 1), add_months(end, test_months)
    tail = (F.col("month") > F.lit(add_months(end, -window))) & (F.col("month") <= F.lit(end))
    fixed = F.avg(F.when(tail, F.col("quantity"))).over(Window.partitionBy(key))
    fc = trailing_mean(dense, key, window, min_periods).withColumn("forecast_fixed", fixed)
    return (fc.where(F.col("month").between(F.lit(first), F.lit(last)))
            .select(key, "month", F.col("quantity").alias("actual"), "forecast", "forecast_fixed"))


def walk_forward(dense: DataFrame, train_end, test_months: int, key: str = "name", window: int = 3,
                 min_periods: int = 1) -> DataFrame:
    """key, month, actual, forecast, forecast_rounded (half even), abs_error."""
    return _walk_columns(forecast_frame(dense, train_end, test_months, key, window, min_periods), key)


def _walk_columns(frame: DataFrame, key: str) -> DataFrame:
    return frame.select(key, "month", "actual", "forecast",
                        F.bround("forecast", 0).cast("bigint").alias("forecast_rounded"),
                        F.abs(F.col("actual") - F.col("forecast")).alias("abs_error"))


def fixed_origin(dense: DataFrame, train_end, test_months: int, key: str = "name",
                 window: int = 3) -> DataFrame:
    """One mean of the last ``window`` training months, repeated over the test months."""
    frame = forecast_frame(dense, train_end, test_months, key, window)
    return frame.select(key, "month", "actual", F.col("forecast_fixed").alias("forecast"),
                        F.abs(F.col("actual") - F.col("forecast_fixed")).alias("abs_error"))


def forecast_metrics(frame: DataFrame, key: str = "name", digits: int = 6) -> DataFrame:
    """Per key, from ``forecast_frame``: MAE of both protocols, totals, gap."""
    walk_err = F.abs(F.col("actual") - F.col("forecast"))
    fixed_err = F.abs(F.col("actual") - F.col("forecast_fixed"))
    return (frame.groupBy(key).agg(
        F.round(F.avg(walk_err), digits).alias("mae_walk_forward"),
        F.sum("actual").alias("total_actual"),
        F.sum(F.bround("forecast", 0).cast("bigint")).alias("total_forecast"),
        F.round(F.avg(fixed_err), digits).alias("mae_fixed_origin"))
        .withColumn("gap", F.col("total_forecast") - F.col("total_actual")))


def last_periods(dense: DataFrame, n: int, key: str = "name", order: str = "month") -> DataFrame:
    """The last ``n`` periods of every series (``tail(n)`` per key), one window per key."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return dense.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sale_span(lines: DataFrame, key: str = "name", ts: str = "created_at") -> DataFrame:
    """key, first_sale, last_sale, sale_lines — one job for all keys."""
    return lines.groupBy(key).agg(F.min(F.to_date(ts)).alias("first_sale"),
                                  F.max(F.to_date(ts)).alias("last_sale"),
                                  F.count("*").alias("sale_lines"))


def sold_before_registration(span: DataFrame, registry: DataFrame, key: str = "name",
                             registered_at: str = "created_at") -> DataFrame:
    """Keys whose first sale precedes their own registration date."""
    return (span.join(registry.select(key, F.to_date(registered_at).alias("registered_on")), key)
            .where(F.col("first_sale") < F.col("registered_on")))
