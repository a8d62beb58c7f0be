r"""Counting the records of CSV files without reading them as tables.

A quoted cell may hold newlines, so whether a line ends a record depends on
all lines before it. Each line is therefore taken as a function of the state
it begins in (0: a new record, 1: inside a quoted cell) to the state it ends
in. Lines without a quote keep the state; the others are decided by one
pattern for each state. A task composes the functions of its lines and counts
the ends of records for both states in which its part of the file may begin, so
a file is cut like any splittable text, and the few parts of each file are
then composed in order.

The rules are those of a reader that is not strict: a quote opens a cell only
at its start, is doubled inside, text after a closing quote belongs to the
cell, an empty line is a record, and a quoted cell that the file never closes
still ends with the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What is left of a quoted cell up to the next separator, and a whole cell. All
# repetitions are possessive, so matching takes one pass and no deep stack.
REST_OF_QUOTED = r'[^"]*+(?:""[^"]*+)*+"[^,]*+'
CELL = rf'(?:"{REST_OF_QUOTED}|(?!")[^,]*+)'
ENDS_FROM_START = rf"\A{CELL}(?:,{CELL})*+\z"
ENDS_FROM_INSIDE = rf"\A{REST_OF_QUOTED}(?:,{CELL})*+\z"
PARTS = "path string, begins bigint, lines bigint, ends0 bigint, ends1 bigint, last0 int, last1 int"


def line_states(line: Column) -> list[Column]:
    """(``to0``, ``to1``): the state after the line if it begins a record, and if it begins inside a quoted cell."""
    quoted = F.instr(line, '"') > 0
    return [F.when(quoted, (~line.rlike(ENDS_FROM_START)).cast("int")).otherwise(0).alias("to0"),
            F.when(quoted, (~line.rlike(ENDS_FROM_INSIDE)).cast("int")).otherwise(1).alias("to1")]


def compose(to0: np.ndarray, to1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States after every line for both states before the first one.

    A line either keeps or swaps the states, or leads both to one. After the
    last such line the state is what it set, swapped as often as lines swapped since.
    """
    fixed = to0 == to1
    swaps = np.cumsum((to0 == 1) & (to1 == 0))
    at = np.maximum.accumulate(np.where(fixed, np.arange(len(to0)), -1))
    known = at >= 0
    since = swaps - np.where(known, swaps[np.maximum(at, 0)], 0)
    set_to = np.where(known, to0[np.maximum(at, 0)], 0)
    flip = (since & 1).astype(np.int64)
    return np.where(known, set_to, 0) ^ flip, np.where(known, set_to, 1) ^ flip


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every part of a file that the task reads: its lines stand together and in order."""
    part, states, totals = None, (0, 1), None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part[0]]), pa.array([part[1]], pa.int64()), *(pa.array([x], pa.int64()) for x in totals),
                                           *(pa.array([x], pa.int32()) for x in states)], names=[f.split()[0] for f in PARTS.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        begins, paths = batch.column("begins").to_numpy(), batch.column("path").dictionary_encode()
        code = paths.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(begins) != 0) | (np.diff(code) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            now = (paths.dictionary[int(code[a])].as_py(), int(begins[a]))
            if now != part:
                if part is not None:
                    yield row()
                part, states, totals = now, (0, 1), [0, 0, 0]
            totals[0] += b - a
            to0, to1 = batch.column("to0").to_numpy()[a:b], batch.column("to1").to_numpy()[a:b]
            if not to0.any() and to1.all():  # lines without a quote keep the state: each ends a record, or is inside a cell
                for begin in (0, 1):
                    totals[1 + begin] += b - a if states[begin] == 0 else 0
                continue
            after = compose(to0.astype(np.int64), to1.astype(np.int64))
            for begin in (0, 1):
                totals[1 + begin] += int((after[states[begin]] == 0).sum())
            states = tuple(int(after[s][-1]) for s in states)
    if part is not None:
        yield row()


def part_counts(spark: SparkSession, path: str) -> DataFrame:
    """path, begins (byte), lines, ends of records and last state for both states before, of every part of the CSV files."""
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begins"), *line_states(F.col("value"))))
    return lines.mapInArrow(_parts, PARTS)


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, records) of every CSV file below ``path`` that has a line, its header included.

    A file's parts are folded in order of their first byte: a row for each
    part, whatever the part holds.
    """
    zero = F.struct(F.lit(0).alias("state"), F.lit(0).cast("bigint").alias("records"))

    def step(acc: Column, p: Column) -> Column:
        inside = acc["state"] == 1
        return F.struct(F.when(inside, p["last1"]).otherwise(p["last0"]).alias("state"),
                        (acc["records"] + F.when(inside, p["ends1"]).otherwise(p["ends0"])).alias("records"))

    parts = F.array_sort(F.collect_list(F.struct("begins", "ends0", "ends1", "last0", "last1")))
    whole = part_counts(spark, path).groupBy("path").agg(F.aggregate(parts, zero, step).alias("r"))
    # a quoted cell that is never closed ends with the file
    return whole.select("path", (F.col("r.records") + F.col("r.state")).alias("records"))


def table_records(spark: SparkSession, directory: str) -> DataFrame:
    """(table_name, n_files, records) of a folder of ``<table>.csv`` files, or folders of CSV part files with a header each.

    ``records`` leaves the headers out. Files without a byte hold no table and are not listed.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(directory)
             .select(F.col("_metadata.file_path").alias("path")))
    # the part of the path below the folder that ends in .csv first
    name = F.regexp_extract("path", r"/([^/]+)\.csv(?:/[^/]+\.csv)?$", 1)
    found = files.select("path", F.url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("table_name"))
    rows = found.join(record_counts(spark, directory), "path", "left")
    return rows.groupBy("table_name").agg(F.count("*").alias("n_files"),
                                          F.sum(F.greatest(F.coalesce("records", F.lit(0)) - 1, F.lit(0))).cast("bigint").alias("records"))
