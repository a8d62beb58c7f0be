"""pt-BR display formats as column expressions (no Python per row).

Python's ``format`` and Spark's ``format_number`` both round the exact
binary value half to even, so ``1.234,56`` style strings agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (display text of the report).
CURRENCY_PREFIX = "R$ "
COMPACT_SUFFIXES = ((1_000_000_000, 2, " bi"), (1_000_000, 2, " mi"), (1_000, 1, " mil"))
SUPPLIER_LABEL = "F%02d · %s"
DATE_PATTERN = "dd/MM/yyyy"
MONTH_PATTERN = "MM/yyyy"
# ---------------------------------------------------------------------------


def _swap_separators(text: Column) -> Column:
    # 1,234.56 -> 1.234,56 in one pass
    return F.translate(text, ",.", ".,")


def format_decimal_pt(col: Column, decimals: int = 2) -> Column:
    return _swap_separators(F.format_number(col.cast("double"), decimals))


def format_brl(col: Column) -> Column:
    return F.concat(F.lit(CURRENCY_PREFIX), format_decimal_pt(col, 2))


def format_compact_brl(col: Column) -> Column:
    x = col.cast("double")
    out = format_brl(x)
    for threshold, decimals, suffix in reversed(COMPACT_SUFFIXES):
        out = F.when(F.abs(x) >= threshold,
                     F.concat(F.lit(CURRENCY_PREFIX), format_decimal_pt(x / threshold, decimals), F.lit(suffix))
                     ).otherwise(out)
    return out


def format_int_pt(col: Column) -> Column:
    return F.translate(F.format_number(F.bround(col.cast("double"), 0), 0), ",", ".")


def format_percent_pt(col: Column, decimals: int = 1) -> Column:
    pattern = "0." + "0" * decimals if decimals else "0"
    # the SQL form takes a DecimalFormat pattern (no digit grouping here)
    text = F.call_function("format_number", col.cast("double") * 100, F.lit(pattern))
    return F.concat(F.replace(text, F.lit("."), F.lit(",")), F.lit("%"))


def format_date_pt(col: Column) -> Column:
    return F.date_format(col, DATE_PATTERN)


def format_month_pt(col: Column) -> Column:
    return F.date_format(col, MONTH_PATTERN)


def supplier_label(id_col: Column, name_col: Column) -> Column:
    return F.format_string(SUPPLIER_LABEL, id_col, F.coalesce(name_col, F.lit("")))


def display_name(trade: Column | None, legal: Column) -> Column:
    """Trade name unless blank, else legal name (both trimmed)."""
    legal_t = F.trim(legal)
    if trade is None:
        return legal_t
    return F.coalesce(F.nullif(F.trim(trade), F.lit("")), legal_t)
