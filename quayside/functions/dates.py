"""Date helpers: cutoff rule, month bucket, Monday-first weekday."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Weekday labels, Monday = 0.
WEEKDAY_NAMES_PT = ("Segunda-feira", "Terça-feira", "Quarta-feira", "Quinta-feira",
                    "Sexta-feira", "Sábado", "Domingo")
# ---------------------------------------------------------------------------


def as_date(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])


def month_floor(value) -> dt.date:
    """First day of the month of a date (or ISO date string)."""
    d = as_date(value)
    return dt.date(d.year, d.month, 1)


def add_months(d: dt.date, n: int) -> dt.date:
    """First day of the month ``n`` months after ``d``'s month."""
    m = d.year * 12 + d.month - 1 + n
    return dt.date(m // 12, m % 12 + 1, 1)


def cutoff_bound(cutoff_day: str | dt.date) -> dt.datetime:
    """Exclusive upper bound for "up to the end of ``cutoff_day``".

    The report's rule is end of day minus one microsecond, inclusive;
    ``ts < next midnight`` keeps exactly the same rows and is a plain
    range predicate that Parquet can push down.
    """
    d = as_date(cutoff_day) + dt.timedelta(days=1)
    return dt.datetime(d.year, d.month, d.day)


def ntz_literal(value: dt.datetime) -> Column:
    """A ``timestamp_ntz`` literal built from text, so neither the driver's
    local zone nor the session zone can shift it."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def not_after(col: Column, cutoff_day: str | dt.date) -> Column:
    return col < ntz_literal(cutoff_bound(cutoff_day))


def after(col: Column, cutoff_day: str | dt.date) -> Column:
    return col >= ntz_literal(cutoff_bound(cutoff_day))


def month_start(col: Column) -> Column:
    """First day of the month as DATE (``date_trunc`` would give a zoned ts)."""
    return F.trunc(F.to_date(col), "MM")


def weekday_number(col: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(F.to_date(col))


def weekday_name(num: Column) -> Column:
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES_PT])
    return F.element_at(names, num + 1)
