"""Record counts of raw CSV files against a strict reading by Python's csv module, however the files are cut."""

import csv
import io
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.plans.queries import QUERIES
from quayside.sources import csv_ingest, record_count

PIECES = ['a', ',', '"', '""', '\n', 'é', ' ', 'x"y', '"q,\n"', '\n\n', '",', ',"']


def records(text):
    return sum(1 for _ in csv.reader(io.StringIO(text, newline="")))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=8))
def test_counts_are_those_of_a_reader(spark, tmp_path_factory, texts):
    folder = tmp_path_factory.mktemp("csv")
    want = {}
    for i, text in enumerate(texts):
        (folder / f"t{i}.csv").write_text(text, encoding="utf-8", newline="")
        if text:
            want[f"t{i}"] = records(text)
    got = {os.path.basename(r["path"])[:-4]: r["records"] for r in record_count.record_counts(spark, str(folder)).collect()}
    assert got == want


def test_a_file_is_counted_by_many_tasks(spark, scratch):
    rng = random.Random(2)
    rows = [[str(k), rng.choice(["plain", 'say "hi"', "two\nlines", 'a, "b"\n\n"c"\n', ""])] for k in range(20_000)]
    with open(os.path.join(scratch, "big.csv"), "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["k", "v"], *rows])
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        parts = record_count.part_counts(spark, scratch).collect()
        assert len(parts) > 10 and {r["last0"] for r in parts} == {0, 1}      # some cuts fall inside quoted cells
        files = csv_ingest.discover_csv(spark, scratch)
        assert [tuple(r) for r in csv_ingest.count_raw_records(spark, files, scratch).collect()] == [("big", 20_000)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), max_size=40))
def test_composed_states(lines):
    to0, to1 = (np.array([x[k] for x in lines], np.int64) for k in (0, 1))
    after = record_count.compose(to0, to1) if lines else ([], [])
    for begin in (0, 1):
        state = begin
        for line, got in zip(lines, after[begin]):
            state = line[state]
            assert got == state


def test_long_quoted_cells_need_no_deep_stack(spark, scratch):
    cell = '"' + 'ab""' * 200_000 + '"'
    with open(os.path.join(scratch, "long.csv"), "w", encoding="utf-8", newline="") as f:
        f.write(f"a,b\n{cell},1\n" + "x,2")
    assert [r["records"] for r in record_count.record_counts(spark, scratch).collect()] == [3]


def test_tables_as_folders_of_files_and_unclosed_cells(spark, scratch):
    spark.range(100).selectExpr("id", "concat('x\n', id) as t").repartition(5).write.option("header", "true").option("quoteAll", "true").csv(
        os.path.join(scratch, "raw", "a b é.csv"))
    os.makedirs(os.path.join(scratch, "raw", "more"))
    with open(os.path.join(scratch, "raw", "open.csv"), "w", encoding="utf-8", newline="") as f:
        f.write('h\n1\n"never closed\n2\n')
    got = {r["table_name"]: (r["n_files"], r["records"]) for r in record_count.table_records(spark, os.path.join(scratch, "raw")).collect()}
    assert got == {"a b é": (5, 100), "open": (1, 2)}


def test_a_parse_that_would_drop_a_row_fails_the_load(spark, scratch):
    with open(os.path.join(scratch, "t.csv"), "w", encoding="utf-8", newline="") as f:
        f.write("a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        csv_ingest.load_exported(spark, scratch, ["t"])


def test_a_broken_target_is_not_an_empty_one(spark, scratch):
    assert csv_ingest.nonempty_targets(spark, {"t": os.path.join(scratch, "missing")}) == []
    os.makedirs(os.path.join(scratch, "t"))
    with open(os.path.join(scratch, "t", "part-0.parquet"), "wb") as f:
        f.write(b"PAR1 not a table")
    with pytest.raises(Exception):
        csv_ingest.nonempty_targets(spark, {"t": os.path.join(scratch, "t")})


def test_raw_counts_of_tables_with_newlines(spark):
    tables = {"t": spark.createDataFrame([(k, f'line\n"{k}"', [1.0, 2.0]) for k in range(30)], "k int, s string, v array<double>"),
              "u": spark.createDataFrame([], "k int, s string")}
    assert {r["table_name"]: r["raw_rows"] for r in csv_ingest.raw_record_counts(spark, tables).collect()} == {"t": 30, "u": 0, "*": 30}
    assert "raw_record_counts" in QUERIES
