"""Column type inference over raw text columns, from *all* rows.

The ladder (most specific first): boolean -> timestamp -> date ->
integer / bigint -> numeric -> text. Empty or whitespace-only cells are
ignored; a column with no value at all is text. Integers with a leading
zero are identifiers (text); integers beyond the bigint range are text.

Plan: every cell's tests become one bit mask, and a column is the ``bit_and``
and ``bit_or`` of its cells' masks with the most digits seen before and after
the point. Each column is a branch that reads nothing but its column as text;
the tests stand behind the union of all branches, so their code is generated
and compiled once, and one aggregate leaves one row per task and column before
its shuffle. Row formats are parsed once per column; write them as Parquet first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHITESPACE

# ---------------------------------------------------------------------------
# Fixed values of the inference rules.
INTEGER_MAX = 2_147_483_647
BIGINT_MAX = 9_223_372_036_854_775_807
KEY_COLUMN = "id"
TS_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
DATE_PATTERN = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"
INT_PATTERN = r"^[+-]?[0-9]+$"
LEADING_ZERO_PATTERN = r"^[+-]?0[0-9]"
PLAIN_PATTERN = r"^[+-]?[0-9]*\.?[0-9]*$"
# float(): decimal digits with optional '_' separators, optional point and
# exponent, or inf / infinity / nan (any case)
FLOAT_PATTERN = (r"^[+-]?((([0-9](_?[0-9])*)?\.[0-9](_?[0-9])*|[0-9](_?[0-9])*\.?)([eE][+-]?[0-9](_?[0-9])*)?"
                 r"|inf|infinity|nan)$")
# ---------------------------------------------------------------------------



def strip(col: Column) -> Column:
    """Remove leading/trailing whitespace of any kind (not only spaces).

    A text that begins and ends with a visible ASCII character has none, and
    most cells do: they are not searched for each of the list's characters.
    """
    visible = F.substring(col, 1, 1).between("!", "~") & F.substring(col, -1, 1).between("!", "~")
    return F.when(visible, col).otherwise(F.btrim(col, F.lit(WHITESPACE)))


#: Bits of a cell's mask. Those of the first line must hold for all cells of a column, those of the second for any.
IS_BOOL, IS_TS, IS_DATE, IS_INT, IS_FLOAT = 1, 2, 4, 8, 16
LEAD_ZERO, OVER_INTEGER, OVER_BIGINT, NOT_PLAIN = 32, 64, 128, 256


def _bits(cond: Column, bits: int) -> Column:
    return F.when(cond, bits).otherwise(0)


def _cell_parts(cells: DataFrame) -> DataFrame:
    """``v`` (text), ``t`` (stripped, null if nothing is left) and, of plain numbers, ``n`` characters, ``sign`` and ``dot``."""
    texts = cells.withColumn("t", F.nullif(strip(F.col("v")), F.lit("")))
    t = F.col("t")
    # a number begins with a sign, a point or a digit: most texts need no pattern to be told apart
    plain = F.substring(t, 1, 1).between("+", "9") & t.rlike(PLAIN_PATTERN)
    parts = texts.select("*", plain.alias("plain"), F.length(t).alias("n"), (t.startswith("+") | t.startswith("-")).cast("int").alias("sign"))
    return parts.withColumn("dot", F.when(F.col("plain"), F.instr("t", ".")))


def _mask() -> Column:
    """The tests of a cell. Plain numbers are told by arithmetic on their length, other cells by patterns for texts that can match.

    The timestamp and date patterns see only cells of a possible length, the
    grammar of floats only cells with a possible first and last character.
    """
    v, t, n, sign, dot = (F.col(name) for name in ("v", "t", "n", "sign", "dot"))
    digits = n - sign - F.when(dot > 0, 1).otherwise(0)
    whole = (dot == 0) & (digits > 0)
    value = F.abs(t.try_cast("decimal(38,0)"))

    def over(limit: int, few: int) -> Column:
        return whole & (digits > few) & F.coalesce(value > F.lit(limit).cast("decimal(38,0)"), F.lit(True))

    plain = (_bits(whole, IS_INT) + _bits(digits > 0, IS_FLOAT) + _bits(whole & (digits > 1) & (F.substring(t, sign + 1, F.lit(1)) == "0"), LEAD_ZERO)
             + _bits(over(INTEGER_MAX, 9), OVER_INTEGER) + _bits(over(BIGINT_MAX, 18), OVER_BIGINT))
    length = F.length(v)
    is_ts = (length >= 13) & (length <= 19) & v.rlike(TS_PATTERN) & v.try_cast("timestamp_ntz").isNotNull()
    is_date = (length >= 8) & (length <= 10) & v.rlike(DATE_PATTERN) & v.try_cast("date").isNotNull()
    may_be = F.substring(t, 1, 1).isin(*"-+.0123456789iInN") & F.substring(t, -1, 1).isin(*".0123456789fFyYnN")
    other = (F.when(((n == 4) | (n == 5)) & F.upper(t).isin("TRUE", "FALSE"), IS_BOOL).when(is_ts, IS_TS).when(is_date, IS_DATE)
             .when(may_be & t.rlike("(?i)" + FLOAT_PATTERN), IS_FLOAT).otherwise(0)) + NOT_PLAIN
    return F.when(t.isNull(), None).when(F.col("plain"), plain).otherwise(other)


def _union(frames: list[DataFrame]) -> DataFrame:
    """One union of many frames of one schema, paired up so that no plan is analysed over and over."""
    while len(frames) > 1:
        frames = [frames[k].union(frames[k + 1]) if k + 1 < len(frames) else frames[k] for k in range(0, len(frames), 2)]
    return frames[0]


def _column_names(spark, tables: dict) -> DataFrame:
    """(branch, table_name, position, column_name): one row per input column (width-bounded), numbered from 0."""
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"))
            for name, df in tables.items() for i, c in enumerate(df.columns)]
    return spark.range(1).select(F.posexplode(F.array(*rows)).alias("branch", "c")).select("branch", "c.*")


def _ladder() -> Column:
    every, some = F.col("every"), F.col("some")
    has = lambda mask, bit: mask.bitwiseAND(F.lit(bit)) != 0
    return (F.when(every.isNull(), "text")
            .when(has(every, IS_BOOL), "boolean")
            .when(has(every, IS_TS), "timestamp")
            .when(has(every, IS_DATE), "date")
            .when(has(every, IS_INT) & (has(some, LEAD_ZERO) | has(some, OVER_BIGINT)), "text")
            .when(has(every, IS_INT) & ~has(some, OVER_INTEGER), "integer")
            .when(has(every, IS_INT), "bigint")
            .when(has(every, IS_FLOAT), "numeric")
            .otherwise("text"))


def _spark_type(inferred: Column) -> Column:
    scale = F.col("frac_digits")
    precision = F.greatest(F.col("int_digits") + scale, scale + 1, F.lit(1))
    # no decimal holds more than 38 digits: such a column stays text, so that no digit is lost
    numeric = (F.when(F.col("some").bitwiseAND(F.lit(NOT_PLAIN)) != 0, "double").when(precision > 38, "string")
               .otherwise(F.format_string("decimal(%d,%d)", precision, scale)))
    return (F.when(inferred == "boolean", "boolean").when(inferred == "timestamp", "timestamp_ntz")
            .when(inferred == "date", "date").when(inferred == "integer", "int")
            .when(inferred == "bigint", "bigint").when(inferred == "numeric", numeric).otherwise("string"))


def infer_catalogue_many(tables: dict) -> DataFrame:
    """Schema catalogue of several tables (all columns read as text) in one job.

    (table_name, position, column_name, inferred_type, is_key, spark_type);
    ``spark_type`` sizes numeric columns as decimal(p,s) from the digits seen
    (double when exponents / nan / inf occur).
    """
    columns = [df.select(F.col(f"`{c}`").cast("string").alias("v")) for df in tables.values() for c in df.columns]
    # every cell is grouped by its branch, which is a number
    branches = [df.withColumn("branch", F.lit(k)) for k, df in enumerate(columns)]
    plain, n, sign, dot = (F.col(name) for name in ("plain", "n", "sign", "dot"))
    tests = _cell_parts(_union(branches)).select(
        "branch", _mask().alias("mask"), F.when(plain, F.when(dot > 0, dot - 1).otherwise(n) - sign).alias("int_digits"),
        F.when(plain, F.when(dot > 0, n - dot).otherwise(0)).alias("frac_digits"))
    stats = tests.groupBy("branch").agg(F.bit_and("mask").alias("every"), F.bit_or("mask").alias("some"),
                                        F.max("int_digits").alias("int_digits"), F.max("frac_digits").alias("frac_digits"))
    # a column of a table without rows has no row of statistics
    stats = _column_names(branches[0].sparkSession, tables).join(stats, "branch", "left")
    inferred = _ladder()
    return stats.select("table_name", "position", "column_name", inferred.alias("inferred_type"), (F.col("column_name") == KEY_COLUMN).alias("is_key"),
                        _spark_type(inferred).alias("spark_type"))


def infer_catalogue(raw: DataFrame, table_name: str) -> DataFrame:
    return infer_catalogue_many({table_name: raw})


def infer_types(raw: DataFrame, table_name: str) -> DataFrame:
    """(table_name, position, column_name, inferred_type, is_key) — the reference's view."""
    return infer_catalogue(raw, table_name).drop("spark_type")


def ddl_from_catalogue(rows) -> str:
    """DDL schema string (``a int, b decimal(18,2)``) from one table's catalogue rows.

    The catalogue has one row per column, so collecting it is bounded by
    the table's width, not its length.
    """
    ordered = sorted((r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows), key=lambda d: d["position"])
    return ", ".join(f"`{d['column_name']}` {d['spark_type']}" for d in ordered)
