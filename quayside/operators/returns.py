"""Returns by cleaned reason."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import not_after
from ..functions.money import to_money
from ..functions.text import clean_reason


def returns_by_reason(returns: DataFrame, cutoff_day: str | dt.date, status_value: str = "completed",
                      status: str = "status", reason: str = "reason", refund: str = "refund",
                      ts: str = "created_at", strict: bool = True) -> DataFrame:
    """reason, returns, refund; ordered refund desc, reason asc.

    Unknown reasons fail the job in strict mode (``raise_error``); use
    ``quayside.functions.text.unknown_reasons`` to audit first.
    """
    done = returns.where((F.col(status) == status_value) & not_after(F.col(ts), cutoff_day))
    # each distinct text is cleaned once
    spelled = done.groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("returns"), F.sum(to_money(refund)).alias("refund"))
    cleaned = clean_reason(spelled, "reason", "reason_clean", strict=strict)
    return (cleaned.groupBy(F.col("reason_clean").alias("reason"))
            .agg(F.sum("returns").alias("returns"), F.sum("refund").alias("refund"))
            .orderBy(F.col("refund").desc(), F.col("reason").asc()))
