"""CSV ingest and type inference on literal files written to a scratch folder."""

import os

import pytest
from pyspark.sql import functions as F

from quayside.sources import csv_ingest, infer


def write(path, text):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return path


INFER_CSV = (
    "flag,ts,day,small,big,huge,code,sci,nan_col,empty,spaced,mixed,neg_int\n"
    "TRUE,2024-01-05 10:00:00,2024-1-5,2147483647,2147483648,12345678901234567890123456789012345678901234,"
    "007,1e3,nan,,  12  ,a,-5\n"
    " false ,2024-12-31 23:59:59,2024-12-31,-1,1,1,1,2.5,1.0,,   ,1,+7\n"
)


def test_inference_ladder(spark, scratch):
    path = write(os.path.join(scratch, "infer.csv"), INFER_CSV)
    raw = csv_ingest.read_csv_text(spark, path)
    got = {r["column_name"]: (r["inferred_type"], r["spark_type"]) for r in infer.infer_catalogue(raw, "t").collect()}
    assert got["flag"][0] == "boolean"
    assert got["ts"] == ("timestamp", "timestamp_ntz")
    assert got["day"][0] == "date"                     # one-digit month and day are dates
    assert got["small"] == ("integer", "int")
    assert got["big"] == ("bigint", "bigint")
    assert got["huge"][0] == "text"                    # beyond bigint -> identifier
    assert got["code"][0] == "text"                    # leading zero -> identifier
    assert got["sci"] == ("numeric", "double")         # exponent -> double storage
    assert got["nan_col"][0] == "numeric"
    assert got["empty"][0] == "text"                   # no value at all
    assert got["spaced"] == ("integer", "int")         # whitespace-only cell ignored
    assert got["mixed"][0] == "text"
    assert got["neg_int"][0] == "integer"


def test_numeric_is_sized_as_decimal(spark):
    raw = spark.createDataFrame([("1234.5",), ("-0.125",), ("",)], "v string")
    r = infer.infer_catalogue(raw, "t").first()
    assert (r["inferred_type"], r["spark_type"]) == ("numeric", "decimal(7,3)")


def test_key_flag(spark):
    raw = spark.createDataFrame([("1", "x")], "id string, name string")
    keys = {r["column_name"]: r["is_key"] for r in infer.infer_types(raw, "t").collect()}
    assert keys == {"id": True, "name": False}


LOAD_CSV = 'name,id,price\n"a, b",1,1.50\n,2,\n"",3,2.00\n"multi\nline ""quoted""",4,3.25\n'


def test_typed_load_by_name_and_copy_nulls(spark, scratch):
    path = write(os.path.join(scratch, "load.csv"), LOAD_CSV)
    schema = {"id": "int", "price": "decimal(18,2)", "name": "string"}    # not the header order
    rows = {r["id"]: r for r in csv_ingest.read_csv_typed(spark, path, schema).collect()}
    assert rows[1]["name"] == "a, b"
    assert rows[2]["name"] is None and rows[2]["price"] is None          # unquoted empty -> NULL
    assert rows[3]["name"] == ""                                          # quoted "" -> empty string
    assert rows[4]["name"] == 'multi\nline "quoted"'
    assert str(rows[4]["price"]) == "3.25"


def test_short_row_fails(spark, scratch):
    path = write(os.path.join(scratch, "short.csv"), "a,b\n1,2\n3\n")
    with pytest.raises(Exception):
        csv_ingest.read_csv_typed(spark, path, {"a": "int", "b": "int"}).collect()


def test_unknown_header_column_fails(spark, scratch):
    path = write(os.path.join(scratch, "extra.csv"), "a,z\n1,2\n")
    with pytest.raises(ValueError):
        csv_ingest.read_csv_typed(spark, path, {"a": "int", "b": "int"})


def test_discovery_and_record_counts(spark, scratch):
    d = os.path.join(scratch, "raw")
    os.makedirs(d)
    write(os.path.join(d, "b_items.csv"), LOAD_CSV)
    write(os.path.join(d, "a_empty.csv"), "x,y\n")
    write(os.path.join(d, "notes.txt"), "ignored")
    files = csv_ingest.discover_csv(spark, d)
    assert [r["table_name"] for r in files.collect()] == ["a_empty", "b_items"]
    counts = {r["table_name"]: r["raw_rows"] for r in csv_ingest.count_raw_records(spark, files, d).collect()}
    assert counts == {"a_empty": 0, "b_items": 4}                         # quoted newline is not a record


def test_guard_refuses_nonempty_target(spark, scratch):
    src = write(os.path.join(scratch, "t.csv"), "a\n1\n")
    target = os.path.join(scratch, "out")
    spark.createDataFrame([(1,)], "a int").write.parquet(os.path.join(target, "t"))
    with pytest.raises(RuntimeError):
        csv_ingest.load_tables(spark, {"t": src}, target, {"t": {"a": "int"}})


def test_roundtrip_counts(spark):
    tables = {"r": spark.createDataFrame([(1, "x\ny", 2.5), (2, None, None)], "k int, s string, v double")}
    out = csv_ingest.roundtrip_validation(spark, tables).first()
    assert (out["raw_rows"], out["loaded_rows"], out["ok"]) == (2, 2, True)


def test_null_tokens_are_a_read_option(spark, scratch):
    path = write(os.path.join(scratch, "tokens.csv"), "a,b\n1,x\nNA,N/A\n,\n")
    schema = {"a": "int", "b": "string"}
    with pytest.raises(Exception):                     # default: only the empty cell is NULL
        csv_ingest.read_csv_typed(spark, path, schema).collect()
    rows = csv_ingest.read_csv_typed(spark, path, schema, null_tokens=("NA", "N/A")).collect()
    assert [(r["a"], r["b"]) for r in rows] == [(1, "x"), (None, None), (None, None)]


def test_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    csv_ingest.require_columns(df, {"a", "b"}, "t")
    with pytest.raises(ValueError, match="missing columns"):
        csv_ingest.require_columns(df, {"a", "c"}, "t")


def test_a_path_with_a_space_and_an_accent_counts_its_rows(spark, scratch):
    d = os.path.join(scratch, "dados é")
    os.makedirs(d)
    write(os.path.join(d, "a b.csv"), "x,y\n1,2\n3,4\n")
    files = csv_ingest.discover_csv(spark, d)
    assert [(r["table_name"], r["raw_rows"]) for r in csv_ingest.count_raw_records(spark, files, d).collect()] == [("a b", 2)]


# columns, the type that holds every digit of them, and what they load as
LOADED = [
    (["0.12345678901234567891", "1.5"], "decimal(21,20)", ["0.12345678901234567891", "1.50000000000000000000"]),
    (["12345678901234567890123456789", "0.123456789012345"], "string", ["12345678901234567890123456789", "0.123456789012345"]),
    (["123456789012345678901234567890.5", "0.123456789012345678"], "string", ["123456789012345678901234567890.5", "0.123456789012345678"]),
    ([" 42 ", "7"], "int", ["42", "7"]), ([" True ", "FALSE"], "boolean", ["true", "false"]), (["1_000", "2e1"], "double", ["1000.0", "20.0"]),
    (["nan", "1"], "double", ["NaN", "1.0"]), (["-inf", "Infinity"], "double", ["-Infinity", "Infinity"]),
    ([" 2024-1-5 1:2:3", "2024-01-05 10:00:00"], "string", [" 2024-1-5 1:2:3", "2024-01-05 10:00:00"]),
    (["2024-1-5 1:2:3", "2024-01-05 10:00:00"], "timestamp_ntz", ["2024-01-05 01:02:03", "2024-01-05 10:00:00"]), (["2024-1-5", ""], "date", ["2024-01-05", None]),
]


def test_whatever_is_inferred_also_loads_with_every_digit(spark, scratch):
    from quayside.sources import infer
    names = [f"c{k}" for k in range(len(LOADED))]
    quoted = lambda v: "" if v == "" else f'"{v}"'
    path = write(os.path.join(scratch, "t.csv"), "\n".join([",".join(names), *(",".join(quoted(v[r]) for v, _, _ in LOADED) for r in range(2))]) + "\n")
    text = csv_ingest.read_csv_text(spark, path)
    schema = csv_ingest.schemas_from_catalogue(infer.infer_catalogue(text, "t"))["t"]
    assert [schema[n] for n in names] == [t for _, t, _ in LOADED]
    rows = csv_ingest.read_csv_typed(spark, path, schema)
    from pyspark.sql import functions as F
    got = rows.select(*[F.col(n).cast("string").alias(n) for n in names]).collect()
    assert [[r[n] for r in got] for n in names] == [v for _, _, v in LOADED]


def test_columns_are_matched_by_name(spark, scratch):
    path = write(os.path.join(scratch, "t.csv"), "b,a\nx,1\n")
    row = csv_ingest.read_csv_typed(spark, path, {"a": "int", "b": "string"}).first()
    assert (row["a"], row["b"]) == (1, "x")
    with pytest.raises(Exception):
        csv_ingest.read_csv_typed(spark, path, {"a": "string", "b": "int"}).collect()


def test_export_keeps_microseconds(spark, scratch):
    from pyspark.sql import functions as F
    from quayside.sources.tables import read_table
    events = read_table(spark, "/root/testdata/sf0.001", "events")
    csv_ingest.export_csv(events, os.path.join(scratch, "events.csv"))
    back = csv_ingest.read_csv_text(spark, os.path.join(scratch, "events.csv"))
    assert back.select(F.col("ts").cast(dict(events.dtypes)["ts"])).exceptAll(events.select("ts")).isEmpty()


def test_cells_are_stripped_as_python_does(spark):
    cells = ["a", "é", "", " ", " a", "a ", " a", "a ", "\x1ca\x1f", "a b", "~", "!", "\u0085é　", "\x7f", "\x00a", None]
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    assert [r["t"] for r in df.select(infer.strip(F.col("v")).alias("t")).collect()] == [None if c is None else c.strip() for c in cells]
    # a cell that begins and ends visibly is not searched
    plan = df.select(infer.strip(F.col("v")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan


def test_a_table_of_few_files_is_dealt_out_evenly(spark, scratch):
    source, target = os.path.join(scratch, "one"), os.path.join(scratch, "dealt.csv")
    spark.range(20_000).selectExpr("id", "cast(id as string) as name").coalesce(1).write.parquet(source)
    csv_ingest.export_csv(spark.read.parquet(source), target)
    sizes = [r["count"] for r in csv_ingest.read_csv_text(spark, target).groupBy(F.input_file_name()).count().collect()]
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) == cores and sum(sizes) == 20_000 and max(sizes) < 2 * 20_000 / cores
    assert csv_ingest.read_csv_text(spark, target).columns == ["id", "name"]
