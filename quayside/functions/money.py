"""Exact money arithmetic and the two rounding rules the reports use.

Money is summed as ``decimal(18,2)`` so totals do not depend on the order
in which partitions are combined (double sums do). Averages round half up
(the SQL ``ROUND(numeric)`` rule); forecast units round half to even (the
float rule). Both are plain column expressions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def to_money(col: Column | str) -> Column:
    """Cast an amount to ``decimal(18,2)`` (half up on the third decimal)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(MONEY)


def cents(col: Column | str) -> Column:
    """Unscaled integer cents of a money column, as ``decimal(38,0)``."""
    return (to_money(col) * 100).cast("decimal(38,0)")


def mean_half_up(total: Column, count: Column, scale: int = 2) -> Column:
    """``round(total / count, scale)`` half away from zero, exactly.

    ``total`` is an exact decimal sum. The quotient is formed in integer
    units of ``10**-scale`` — ``(2|u| + n) div 2n`` with the sign put back —
    so there is no intermediate decimal rounding that could round twice,
    whatever the group size. Result is ``decimal(38, scale)``.
    """
    units = (total * (10 ** scale)).cast("decimal(38,0)")
    n = count.cast("decimal(38,0)")
    a = F.abs(units) * 2 + n
    b = n * 2
    # (a - a % b) is a multiple of b, so this division is exact.
    q = ((a - a % b) / b).cast("decimal(38,0)")
    q = F.when(units < 0, -q).otherwise(q)
    return F.when(count > 0, (q / (10 ** scale)).cast(f"decimal(38,{scale})"))


def round_half_up(col: Column, scale: int = 2) -> Column:
    """ROUND on a decimal value (Spark rounds decimals half up)."""
    return F.round(col, scale)


def round_half_even(col: Column, scale: int = 0) -> Column:
    """Banker's rounding, as Python/pandas ``round`` does on floats."""
    return F.bround(col, scale)
