"""Bounded samples of labelled rows for fitting, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; false for a null id, which cannot be told apart."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def bounded_sample(rows: DataFrame, class_col: str, id_col: str, per_class: int, max_classes: int = 256) -> DataFrame:
    """About ``per_class`` rows of every class (all of a smaller class), the same rows on every run.

    A row is in if its id's hash falls below the share of its class that is
    wanted, so nothing is sorted or gathered: one count per class reaches the
    driver. More than ``max_classes`` classes is an error.
    """
    counts = rows.groupBy(class_col).agg(F.count("*").alias("n")).limit(max_classes + 1).collect()
    if len(counts) > max_classes:
        raise ValueError(f"{class_col} has more than {max_classes} classes")
    bucket = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(BUCKETS))
    keep = F.lit(False)
    for r in counts:
        keep = keep | (F.col(class_col).eqNullSafe(F.lit(r[class_col])) & (bucket < int(BUCKETS * min(1.0, per_class / r["n"]))))
    return rows.where(keep)
