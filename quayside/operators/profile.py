"""Table profiling: summary row, nulls, frequencies, describe, IQR outliers.

Each profile is a single aggregate pass (partial aggregation per task,
one small final merge). Column-wise results are produced wide in one
pass and turned long with ``unpivot`` — never one job per column.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import after
from ..functions.money import mean_half_up, to_money


def summary_row(df: DataFrame, ts: str, amount: str) -> DataFrame:
    """total_rows, date_min, date_max, amount_min, amount_max, amount_mean (half up, 2)."""
    money = to_money(amount)
    agg = df.agg(F.count("*").alias("total_rows"),
                 F.min(F.to_date(ts)).alias("date_min"), F.max(F.to_date(ts)).alias("date_max"),
                 F.min(money).alias("amount_min"), F.max(money).alias("amount_max"),
                 F.sum(money).alias("_sum"), F.count(money).alias("_n"))
    return agg.select("total_rows", "date_min", "date_max", "amount_min", "amount_max",
                      mean_half_up(F.col("_sum"), F.col("_n")).alias("amount_mean"))


def null_counts(df: DataFrame, table_name: str | None = None) -> DataFrame:
    """(table_name, column_name, null_count) for every column, one pass."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = wide.unpivot([], list(df.columns), "column_name", "null_count")
    return long.select(F.lit(table_name).alias("table_name"), "column_name", "null_count")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """value, n — nulls dropped (as a frequency table does), count desc."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
            .agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("value").asc()))


def crosstab(df: DataFrame, row: str, col: str, values, names: dict | None = None) -> DataFrame:
    """row x col counts with an explicit value list for the columns; 0 when absent."""
    names = names or {}
    piv = df.groupBy(row).pivot(col, list(values)).count()
    out = [F.col(row)]
    for v in values:
        out.append(F.coalesce(F.col(f"`{v}`"), F.lit(0)).cast("bigint").alias(names.get(v, str(v))))
    return piv.select(*out)


def null_crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """row x (col is null) counts: columns ``not_null`` and ``is_null``."""
    return df.groupBy(row).agg(F.count_if(F.col(col).isNotNull()).alias("not_null"),
                               F.count_if(F.col(col).isNull()).alias("is_null"))


#: Size of the sketches; their ranks are off by about 1.5 / SKETCH of the rows, rarely more.
SKETCH = 4096
#: Sketches are merged in two steps, so that no task merges those of all other tasks.
MERGERS = 64
#: Values that are sorted in one place to pick a rank.
MOST = 20_000


class _Bracket:
    """Open interval of values in which the value of a rank (from 1) must lie; None is no bound."""

    def __init__(self, rank: int, inside: int):
        self.rank, self.low, self.high, self.below, self.inside = rank, None, None, 0, inside
        self.margin, self.value = 3.0 / SKETCH, None

    def holds(self, x: Column) -> Column:
        conds = [x > self.low] if self.low is not None else []
        conds += [x < self.high] if self.high is not None else []
        return reduce(lambda a, b: a & b, conds, x.isNotNull())

    def counted(self, low: float, high: float, below: int, at_low: int, between: int, at_high: int) -> None:
        """Take [low, high] if the counts prove that it holds the rank, else try a wider one the next time."""
        if below < self.rank <= below + at_low:
            self.value = low
        elif below + at_low < self.rank <= below + at_low + between:
            self.low, self.high, self.below, self.inside, self.margin = low, high, below + at_low, between, 3.0 / SKETCH
        elif below + at_low + between < self.rank <= below + at_low + between + at_high:
            self.value = high
        else:
            self.margin *= 8


def _narrow(values: DataFrame, brackets: list[_Bracket], mergers: int) -> None:
    """One round: a sketch of what each bracket holds proposes narrower ends, and counts prove or refuse them."""
    x = F.col("x")
    parts = values.groupBy((F.spark_partition_id() % mergers).alias("m")).agg(
        *[F.kll_sketch_agg_double(F.when(b.holds(x), x), F.lit(SKETCH)).alias(f"s{i}") for i, b in enumerate(brackets)])
    merged = parts.agg(*[F.kll_merge_agg_double(f"s{i}", F.lit(SKETCH)).alias(f"s{i}") for i in range(len(brackets))])
    ends = []
    for i, b in enumerate(brackets):
        share = (b.rank - b.below - 0.5) / b.inside
        ends += [F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.lit(min(1.0, max(0.0, at)))).alias(f"{name}{i}")
                 for name, at in (("lo", share - b.margin), ("hi", share + b.margin))]
    ends = merged.select(*ends).collect()[0]
    aggs = []
    for i in range(len(brackets)):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        aggs += [F.count_if(x < low).alias(f"b{i}"), F.count_if(x == low).alias(f"l{i}"), F.count_if((x > low) & (x < high)).alias(f"c{i}"),
                 F.count_if((x == high) & (x > low)).alias(f"h{i}")]
    counts = values.agg(*aggs).collect()[0]
    for i, b in enumerate(brackets):
        b.counted(ends[f"lo{i}"], ends[f"hi{i}"], *(counts[f"{k}{i}"] for k in "blch"))


def ranked_values(df: DataFrame, col: str, ranks, mergers: int = MERGERS) -> tuple[int, dict[int, float]]:
    """(n, values) of the given ranks of ``n`` (from 1), exactly; ``ranks`` may be a function of n.

    Each rank is bracketed by a sketch's quantiles; a pass counts what lies
    below, at the ends of and inside the bracket, which proves it (or asks for
    a wider one); a bracket that holds too much is narrowed in the same way,
    and one of at most :data:`MOST` values is sorted and gives up its
    rank. Only counts, ends and the picked values reach the driver, and only
    sketches and the insides of the last brackets are shuffled. NaN sorts last.
    """
    x = F.col("x")
    values = df.select(F.col(col).cast("double").alias("x")).where(x.isNotNull())
    row = values.agg(F.count("*").alias("n"), F.count_if(F.isnan(x)).alias("nan"), F.count_if(x == float("inf")).alias("inf"),
                     F.count_if(x == float("-inf")).alias("least")).collect()[0]
    n, least = row["n"], row["least"]
    finite = n - row["nan"] - row["inf"] - least
    wanted = {r for r in (ranks(n) if callable(ranks) else ranks) if 1 <= r <= n}
    found = {r: float("-inf") if r <= least else float("nan") if r > n - row["nan"] else float("inf") for r in wanted if not least < r <= least + finite}
    brackets = [_Bracket(r - least, finite) for r in sorted(wanted - set(found))]
    values = values.where((x > float("-inf")) & (x < float("inf")))
    while waiting := [b for b in brackets if b.value is None and b.inside > MOST]:
        _narrow(values, waiting, mergers)
    pick = [b for b in brackets if b.value is None]
    if pick:
        lists = [F.element_at(F.array_sort(F.collect_list(F.when(b.holds(x), x))), b.rank - b.below).alias(f"v{i}") for i, b in enumerate(pick)]
        row = values.agg(*lists).collect()[0]
        for i, b in enumerate(pick):
            b.value = row[f"v{i}"]
    return n, found | {b.rank + least: b.value for b in brackets}


def quantiles(df: DataFrame, col: str, probs, mergers: int = MERGERS) -> list[float | None]:
    """Exact quantiles with linear interpolation between the sorted values around (n - 1) p; None without values."""
    places = lambda n: [(n - 1) * float(p) for p in probs]
    n, value = ranked_values(df, col, lambda n: {r for h in places(n) for r in (floor(h) + 1, ceil(h) + 1)}, mergers)
    out = []
    for h in places(n) if n else []:
        a, b = value[floor(h) + 1], value[ceil(h) + 1]
        out.append(a if ceil(h) == floor(h) else (ceil(h) - h) * a + (h - floor(h)) * b)
    return out or [None] * len(probs)


def exact_quantiles(df: DataFrame, col: str, probs, partitions: int = MERGERS) -> DataFrame:
    """One row ``q0..qk`` of :func:`quantiles`; ``partitions`` is the number of tasks that merge sketches."""
    return df.sparkSession.range(1).select(*[F.lit(q).cast("double").alias(f"q{i}") for i, q in enumerate(quantiles(df, col, probs, partitions))])


def _quantile_columns(df: DataFrame, col: str, probs, approx: bool) -> list[Column]:
    if approx:
        q = df.select(F.percentile_approx(F.col(col).cast("double"), list(probs), 10000).alias("q")).scalar()
        return [q[i] for i in range(len(probs))]
    return [F.lit(q).cast("double") for q in quantiles(df, col, probs)]


def describe(df: DataFrame, col: str, digits: int = 4, approx: bool = False) -> DataFrame:
    """count, mean, std (sample), min, 25%, 50%, 75%, max.

    Quantiles are exact (:func:`quantiles`); ``approx`` takes Spark's sketch as it is.
    """
    x = F.col(col).cast("double")
    money = to_money(col)
    q25, q50, q75 = _quantile_columns(df, col, (0.25, 0.5, 0.75), approx)
    agg = df.agg(F.count(x).alias("count"), F.sum(money).alias("_sum"),
                 F.stddev_samp(x).alias("_std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return agg.select("count", mean_half_up(F.col("_sum"), F.col("count"), digits).cast("double").alias("mean"),
                      F.round("_std", digits).alias("std"), "min",
                      F.round(q25, digits).alias("q25"), F.round(q50, digits).alias("q50"),
                      F.round(q75, digits).alias("q75"), "max")


def iqr_outliers(df: DataFrame, col: str, factors=(1.5,), digits: int = 4, approx: bool = False) -> DataFrame:
    """factor, q1, q3, iqr, upper_fence, n_above — one row per factor.

    Quartiles are exact (:func:`quantiles`); the count above each fence is one
    more pass over the column.
    """
    x = F.col(col).cast("double")
    q1, q3 = _quantile_columns(df, col, (0.25, 0.75), approx)
    counts = df.agg(*[F.count_if(x > q3 + F.lit(k) * (q3 - q1)).alias(f"n{i}") for i, k in enumerate(factors)])
    rows = [F.struct(F.lit(float(k)).alias("factor"), F.col(f"n{i}").alias("n_above")) for i, k in enumerate(factors)]
    long = counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.select("factor", F.round(q1, digits).alias("q1"), F.round(q3, digits).alias("q3"),
                       F.round(q3 - q1, digits).alias("iqr"),
                       F.round(q3 + F.col("factor") * (q3 - q1), digits).alias("upper_fence"), "n_above")


def distinct_values(df: DataFrame, cols) -> DataFrame:
    """(column_name, value): sorted distinct values of each column, one shuffle."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                     F.col(c).cast("string").alias("value")) for c in cols])).alias("s"))
    return stacked.select("s.*").distinct().orderBy("column_name", "value")


def conditional_sums(df: DataFrame, by: str, value: str, groups: dict) -> DataFrame:
    """Per ``by``: sum of ``value`` for each named status group, plus the total."""
    aggs = [F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0)).alias(name) for name, cond in groups.items()]
    return df.groupBy(by).agg(*aggs, F.sum(value).alias("total"))


def rows_after_cutoff(df: DataFrame, ts: str, cutoff_day: str | dt.date) -> DataFrame:
    """total_rows, future_rows (strictly after the end of the cutoff day)."""
    return df.agg(F.count("*").alias("total_rows"), F.count_if(after(F.col(ts), cutoff_day)).alias("future_rows"))


def profile_report(df: DataFrame, ts: str, amount: str, key, category_cols, cutoff_day) -> DataFrame:
    """Long-form table profile: (metric, value_num, value_text), one aggregate pass.

    Rows, columns, date range, amount min/max/mean, non-positive amounts,
    null cells, rows after the cutoff, duplicate keys, and the sorted value
    list of each low-cardinality column in ``category_cols``: one row for
    every value, from a distinct over all tasks.
    """
    money = to_money(amount)
    key = [key] if isinstance(key, str) else list(key)
    aggs = [F.count("*").alias("rows"), F.min(F.to_date(ts)).cast("string").alias("date_min"),
            F.max(F.to_date(ts)).cast("string").alias("date_max"),
            F.min(money).alias("amount_min"), F.max(money).alias("amount_max"),
            F.sum(money).alias("_sum"), F.count(money).alias("_n"),
            F.count_if(money <= 0).alias("nonpositive_amounts"),
            sum(F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns).alias("null_cells"),
            F.count_if(after(F.col(ts), cutoff_day)).alias("future_rows")]
    dup = duplicate_keys_count(df, key)
    one = df.agg(*aggs).withColumn("amount_mean", mean_half_up(F.col("_sum"), F.col("_n")))
    num = lambda name, c: F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value_num"),
                                   F.lit(None).cast("string").alias("value_text"))
    txt = lambda name, c: F.struct(F.lit(name).alias("metric"), F.lit(None).cast("double").alias("value_num"),
                                   c.alias("value_text"))
    rows = [num("rows", F.col("rows")), num("columns", F.lit(len(df.columns))),
            txt("date_min", F.col("date_min")), txt("date_max", F.col("date_max")),
            num("amount_min", F.col("amount_min")), num("amount_max", F.col("amount_max")),
            num("amount_mean", F.col("amount_mean")), num("nonpositive_amounts", F.col("nonpositive_amounts")),
            num("null_cells", F.col("null_cells")), num("future_rows", F.col("future_rows")),
            num("duplicate_keys", dup)]
    report = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    for c in category_cols:
        values = df.select(F.col(c).cast("string").alias("value_text")).where(F.col("value_text").isNotNull()).distinct()
        report = report.unionByName(values.select(F.lit(f"value_{c}").alias("metric"), F.lit(None).cast("double").alias("value_num"), "value_text"))
    return report


def duplicate_keys_count(df: DataFrame, key) -> Column:
    """Scalar: rows minus distinct keys (extra occurrences), via a group-by on the key."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("_c"))
    return per_key.select(F.coalesce(F.sum("_c") - F.count("*"), F.lit(0))).scalar()


def table_counts(frames: dict) -> DataFrame:
    """(table_name, n_rows, n_columns) for several tables via unionByName."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows",
                                                         F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
             for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
