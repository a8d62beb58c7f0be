"""Data-quality and reconciliation checks as DataFrame jobs.

All checks return small result frames (counts, differences) computed by
distributed aggregates and joins; nothing is pulled to the driver to be
compared there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys, table_name: str) -> DataFrame:
    """(table_name, key_columns, n_rows, n_distinct_keys, n_duplicates).

    Duplicates are extra occurrences (rows minus distinct keys); repeated
    null keys count as equal, as a row-wise ``duplicated`` does. Computed
    as a group-by on the key (partial aggregation absorbs a hot key).
    """
    keys = list(keys)
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_c"))
    return per_key.agg(F.sum("_c").alias("n_rows"), F.count("*").alias("n_distinct_keys")).select(
        F.lit(table_name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"), "n_distinct_keys",
        (F.coalesce("n_rows", F.lit(0)) - F.col("n_distinct_keys")).cast("bigint").alias("n_duplicates"))

def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str,
            child_name: str, parent_name: str) -> DataFrame:
    """Referential integrity: child rows whose non-null key has no parent.

    Child keys are pre-aggregated (key, rows) before the anti-join, so a
    hot key is one row on the join's shuffle, not a third of the table.
    """
    keyed = (child.select(F.col(child_key).alias("_k")).where(F.col("_k").isNotNull())
             .groupBy("_k").agg(F.count("*").alias("_n")))
    parents = parent.select(F.col(parent_key).alias("_k"))
    missing = keyed.join(parents, "_k", "left_anti")
    return (missing.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("n_orphans"))
            .select(F.lit(child_name).alias("child_table"), F.lit(child_key).alias("child_column"),
                    F.lit(parent_name).alias("parent_table"), "n_orphans"))


def all_orphans(tables: dict, relations) -> DataFrame:
    """:func:`orphans` of many relations at once: each table is read once, whatever number of keys it has.

    ``relations`` holds (child, child_key, parent, parent_key) names. A child's
    row becomes one (relation, key) for each of its keys, counted map-side, so
    a hot key is one row of the shuffle; one anti-join finds the keys without
    a parent. Null keys are no orphans; a relation without orphans counts 0.
    """
    relations = list(relations)
    kinds = {dict(tables[t].dtypes)[k] for c, ck, p, pk in relations for t, k in ((c, ck), (p, pk))}
    kind = "bigint" if kinds <= {"tinyint", "smallint", "int", "bigint"} else "string"

    def keys(side: int) -> DataFrame:
        """(relation, key) of the children (0) or the parents (2)."""
        frames = []
        for name in dict.fromkeys(r[side] for r in relations):
            cells = [F.struct(F.lit(i).alias("relation"), F.col(f"`{r[side + 1]}`").cast(kind).alias("key"))
                     for i, r in enumerate(relations) if r[side] == name]
            frames.append(tables[name].select(F.explode(F.array(*cells)).alias("r")).select("r.*").where("key is not null"))
        return reduce(DataFrame.unionByName, frames)

    children = keys(0).groupBy("relation", "key").agg(F.count("*").alias("n"))
    missing = children.join(keys(2), ["relation", "key"], "left_anti").groupBy("relation").agg(F.sum("n").alias("n"))
    names = [F.struct(F.lit(i).alias("relation"), F.lit(c).alias("child_table"), F.lit(ck).alias("child_column"), F.lit(p).alias("parent_table"))
             for i, (c, ck, p, _) in enumerate(relations)]
    spark = next(iter(tables.values())).sparkSession
    return (spark.range(1).select(F.explode(F.array(*names)).alias("r")).select("r.*").join(missing, "relation", "left")
            .select("child_table", "child_column", "parent_table", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_orphans")))


def identity_mismatches(df: DataFrame, lhs, rhs: str, tolerance: str = "0.01",
                        label: str = "identity") -> DataFrame:
    """Rows where |sum(lhs terms) - rhs| > tolerance, on exact decimals.

    ``lhs`` is a list of (column, sign) pairs, e.g. [("subtotal", 1),
    ("discount", -1)] for subtotal - discount = total.
    """
    exact = lambda c: F.col(c).cast("decimal(38,6)")
    left = None
    for col, sign in lhs:
        term = exact(col) * sign
        left = term if left is None else left + term
    diff = F.abs(left - exact(rhs))
    return df.agg(F.count("*").alias("n_rows"),
                  F.count_if(diff > F.lit(tolerance).cast("decimal(18,2)")).alias("n_mismatches"),
                  F.max(diff).alias("max_abs_diff")).select(F.lit(label).alias("check_name"), "*")

def reconcile(left: DataFrame, right: DataFrame, key, value: str, check_name: str) -> DataFrame:
    """Key-aligned comparison of two results of the same metric.

    Full outer join so keys missing on either side are counted, then the
    largest absolute difference over common keys.
    """
    key = [key] if isinstance(key, str) else list(key)
    a = left.select(*key, F.col(value).alias("_a"))
    b = right.select(*key, F.col(value).alias("_b"))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count("*").alias("n_keys"),
                 F.count_if(F.col("_a").isNull()).alias("missing_left"),
                 F.count_if(F.col("_b").isNull()).alias("missing_right"),
                 F.coalesce(F.max(F.abs(F.col("_a") - F.col("_b"))), F.lit(0)).alias("max_abs_diff")
                 ).select(F.lit(check_name).alias("check_name"), "*")


def bucket_digests(df: DataFrame, key, buckets: int) -> DataFrame:
    """(bucket, n, total, mixed) over the rows of each hash bucket of the key; independent of order and partitioning."""
    h = F.xxhash64(F.lit(1), *[F.col(f"`{c}`") for c in df.columns])
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    return df.select(bucket.alias("bucket"), h.alias("h")).groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"), F.bit_xor("h").alias("mixed"))


def differing_buckets(left: DataFrame, right: DataFrame, key, buckets: int) -> DataFrame:
    """The buckets whose digests differ, or that only one side has: at most ``buckets`` rows."""
    columns = ["n", "total", "mixed"]
    a = bucket_digests(left, key, buckets).select("bucket", F.struct(*columns).alias("a"))
    b = bucket_digests(right, key, buckets).select("bucket", F.struct(*columns).alias("b"))
    return a.join(b, "bucket", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def located_differences(left: DataFrame, right: DataFrame, key, buckets: int = 4096) -> DataFrame:
    """Where two versions of a table differ: key, ``kind`` and ``columns``, one row for every differing key.

    ``kind`` is 'added' (only right), 'removed' (only left) or 'changed', with
    the names of the columns that differ, in order and joined by commas. Both
    sides are reduced to a digest for each hash bucket of the key first; only
    the rows of buckets that differ are joined, so two large tables with few
    differences shuffle little more than their digests. Columns are compared
    by name, nulls equal nulls; the sides must have the same columns and the key must be unique.
    """
    key = [key] if isinstance(key, str) else list(key)
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    right = right.select(left.columns)
    values = [c for c in left.columns if c not in key]
    touched = F.broadcast(differing_buckets(left, right, key, buckets))       # at most `buckets` numbers
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(bucket, *key, F.struct(F.lit(True).alias("here"), *[F.col(f"`{c}`") for c in values]).alias(name))
        return rows.join(touched, "bucket", "left_semi").drop("bucket")

    a, b = side(left, "a").alias("l"), side(right, "b").alias("r")
    same = reduce(lambda x, y: x & y, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key])
    both = a.join(b, same, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    changed = F.concat_ws(",", *[F.when(~F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")), F.lit(c)) for c in values])
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return both.select(*[F.when(F.col("a").isNull(), F.col(f"r.{k}")).otherwise(F.col(f"l.{k}")).alias(k) for k in key], kind.alias("kind"),
                       F.when(kind == "changed", changed).otherwise(F.lit(None).cast("string")).alias("columns"))


def same_ordered_list(left: DataFrame, right: DataFrame, position: str, check_name: str) -> DataFrame:
    """(check_name, n_left, n_right, n_different, equal): do both hold the same rows at the same positions?

    ``position`` is a column of both (1, 2, ...), so the comparison is a
    full outer join, not a sort on the driver.
    """
    columns = [c for c in left.columns if c != position]
    a = left.select(position, F.struct(*columns).alias("_a"))
    b = right.select(position, F.struct(*columns).alias("_b"))
    return (a.join(b, position, "full_outer")
            .agg(F.count("_a").alias("n_left"), F.count("_b").alias("n_right"),
                 F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_different"))
            .select(F.lit(check_name).alias("check_name"), "*", (F.col("n_different") == 0).alias("equal")))

def _decimal_digits(kind: str) -> tuple[int, int]:
    """Digits before and after the point that a type can hold; (0, 0) for other types than decimals and short integers."""
    if kind.startswith("decimal"):
        precision, scale = (int(x) for x in kind[len("decimal("):-1].split(","))
        return precision - scale, scale
    return {"tinyint": 3, "smallint": 5, "int": 10}.get(kind, 0), 0


def row_text(df: DataFrame, fractions=()) -> Column:
    """One text for a row: its columns in order, joined by '|'; numbers with a fraction have 6 decimals, null is \\N.

    Columns in ``fractions`` are printed so whatever their type.
    """
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        whole, scale = _decimal_digits(kind)
        if (name in fractions or kind.startswith("decimal")) and scale <= 6 and 0 < whole + scale <= 15:
            # a double holds these digits and prints them, so that they are printed without a double and its format
            text = c.cast(f"decimal({whole + 6},6)").cast("string")
        elif name in fractions or kind in ("double", "float") or kind.startswith("decimal"):
            x = c.cast("double")
            text = F.format_string("%.6f", F.when(F.abs(x) < 5e-7, F.lit(0.0)).otherwise(x))
            text = F.when(x.isNotNull(), text)
        else:
            text = c.cast("string")
        parts.append(F.coalesce(text, F.lit("\\N")))
    return F.concat_ws("|", *parts)


def content_hash(df: DataFrame, fractions=()) -> DataFrame:
    """Order-insensitive fingerprint: (n_rows, hash_sum).

    Every row's text is hashed with md5, whose first 15 hex digits are a
    whole number; ``hash_sum`` is the exact sum as text. It does not depend on
    partitioning, row order or engine.
    """
    h = F.conv(F.substring(F.md5(F.encode(row_text(df, fractions), "UTF-8")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("hash_sum"))

def aggregate_only(df: DataFrame, allowed) -> list[str]:
    """Privacy gate for published marts: columns that are not on the allow-list (schema only)."""
    return sorted(set(df.columns) - set(allowed))

def evaluate_expectations(actual: DataFrame, expected: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Join (check_name, value) facts to (check_name, expected, label); all failures at once.

    Every expectation yields a row with ``ok``; a missing fact fails.
    """
    j = expected.join(actual, "check_name", "left")
    ok = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.lit(tolerance), F.lit(False))
    return j.select("check_name", "label", "expected", "value", ok.alias("ok"))
