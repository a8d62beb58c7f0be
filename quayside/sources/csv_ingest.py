"""CSV ingest: discover, count raw records, infer, load typed, validate.

Semantics kept from the bulk loader: one table per ``*.csv`` file (table
name = file stem), header row, ``,`` delimiter, UTF-8, columns matched by
*name* (not position), only the unquoted empty cell is NULL (a quoted
``""`` stays an empty string), a malformed row fails the load, and a load
never writes into a non-empty target.

Scale notes: ``multiLine`` CSV is not splittable (one task per file), so raw
CSV is parsed once, strictly, to a Parquet copy as text; types are inferred and
values cast from that copy. Raw records are counted from the files themselves,
by :mod:`.record_count`, which does split them.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .infer import infer_catalogue_many, strip
from .record_count import record_counts, table_records

# Fixed reader options (COPY-like): a sentinel null token means only the
# unquoted empty cell becomes NULL, while a quoted "" reads as ''.
NULL_SENTINEL = "\u0001"
CSV_READ_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "sep": ",",
                    "encoding": "UTF-8", "nullValue": NULL_SENTINEL, "emptyValue": "",
                    "timestampNTZFormat": "yyyy-M-d H:m:s", "dateFormat": "yyyy-M-d"}
# Writing: null -> unquoted empty, '' -> quoted "", zero-padded dates.
CSV_WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "sep": ",",
                     "dateFormat": "yyyy-MM-dd"}


def _reader(spark: SparkSession):
    r = spark.read
    for k, v in CSV_READ_OPTIONS.items():
        r = r.option(k, v)
    return r


def discover_csv(spark: SparkSession, directory: str) -> DataFrame:
    """(table_name, path, bytes, file_path) of every ``*.csv`` in ``directory``, sorted by name.

    Uses the ``binaryFile`` source with only path/length selected, so file
    contents are not read. ``file_path`` is the path as every reader's
    metadata spells it (percent-encoded), for joins with other reads.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(directory)
             .select("path", F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("file_path")))
    name = F.regexp_extract(F.col("path"), r"([^/]+)\.csv$", 1)
    return files.select(name.alias("table_name"), "path", "bytes", "file_path").orderBy("table_name")


def require_columns(df: DataFrame, expected, source: str) -> None:
    """Required-column contract (schema only, no job)."""
    missing = sorted(set(expected) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns in {source}: {missing}")


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Every column as string, header names kept (input of type inference)."""
    return _reader(spark).option("inferSchema", "false").csv(path)


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header row (reads one line, no inference)."""
    return read_csv_text(spark, path).columns


def read_csv_strict(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Every column as string, in the header's order; a row with too few or too many cells fails the job."""
    header = header or header_columns(spark, path)
    ddl = ", ".join(f"`{c}` string" for c in header)
    return _reader(spark).option("enforceSchema", "false").option("mode", "FAILFAST").schema(ddl).csv(path)


def read_csv_typed(spark: SparkSession, path: str, schema: dict, columns=None,
                   null_tokens=None) -> DataFrame:
    """Typed read with columns matched by name.

    ``schema`` maps column -> Spark SQL type. The file is read as text in its
    header's order (a malformed row fails the job), then every column is
    cast strictly by the rules of :func:`typed_value`, so whatever inference
    typed also loads. ``columns`` projects (Catalyst prunes the parse).

    ``null_tokens`` (e.g. ``("NA", "N/A", "null")``) are read as NULL in
    addition to the unquoted empty cell.
    """
    header = header_columns(spark, path)
    unknown = [c for c in header if c not in schema]
    if unknown:
        raise ValueError(f"{path}: header columns without a type: {unknown}")
    return typed_columns(read_csv_strict(spark, path, header), schema, columns, null_tokens)


def typed_value(cell: Column, spark_type: str) -> Column:
    """Text to a type by the rules that the inference ladder used, strictly: a bad value fails the job.

    Blank cells of a typed column are null; text columns keep every character.
    """
    if spark_type == "string":
        return cell
    t = F.nullif(strip(cell), F.lit(""))
    if spark_type == "double":
        low = F.lower(t)
        bare = F.ltrim(low, F.lit("+-"))
        endless = F.when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        number = F.replace(t, F.lit("_"), F.lit("")).cast("double")
        return F.when(bare == "nan", F.lit(float("nan"))).when(bare.isin("inf", "infinity"), endless).otherwise(number)
    return t.cast(spark_type)


def typed_columns(text: DataFrame, schema: dict, columns=None, null_tokens=None) -> DataFrame:
    """The typed form of a frame of text columns, matched by name."""
    cells = {}
    for c in text.columns:
        cell = F.col(f"`{c}`")
        cells[c] = F.when(cell.isin(list(null_tokens)), F.lit(None)).otherwise(cell) if null_tokens else cell
    return text.select(*[typed_value(cells[c], schema[c]).alias(c) for c in (columns or schema)])


def count_raw_records(spark: SparkSession, files: DataFrame, directory: str) -> DataFrame:
    """(table_name, raw_rows): records of ``files`` (of :func:`discover_csv` on ``directory``) without their headers.

    Quoted newlines end no record, empty lines do; a header-only or empty file counts 0.
    """
    counts = record_counts(spark, directory).withColumnRenamed("path", "file_path")
    rows = F.greatest(F.coalesce("records", F.lit(0)) - 1, F.lit(0))
    return files.join(counts, "file_path", "left").select("table_name", rows.cast("bigint").alias("raw_rows"))


def nonempty_targets(spark: SparkSession, targets: dict) -> list[str]:
    """Names whose Parquet target already holds rows (one-row probe each).

    A missing folder, or one without data files, is an empty target. Any other
    trouble with reading it (rights, a broken file) is raised: such a target
    is not known to be empty.
    """
    busy = []
    for name, path in targets.items():
        try:
            df = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                continue
            raise
        if not df.isEmpty():
            busy.append(name)
    return busy


def load_tables(spark: SparkSession, sources: dict, target_dir: str, schemas: dict,
                parallel: int = 4) -> DataFrame:
    """Bulk load: guard all targets first, then typed read -> Parquet per table.

    Loads of different tables are submitted as concurrent Spark jobs
    (``parallel`` at a time); each one writes its own target.

    ``sources`` maps table -> CSV path, ``schemas`` table -> {column: type}.
    Returns (table_name, loaded_rows) counted from the written Parquet.
    """
    targets = {name: f"{target_dir}/{name}" for name in sources}
    busy = nonempty_targets(spark, targets)
    if busy:
        raise RuntimeError(f"targets already hold data, nothing loaded: {sorted(busy)}")
    def load(name: str) -> None:
        read_csv_typed(spark, sources[name], schemas[name]).write.mode("errorifexists").parquet(targets[name])

    # each table commits on its own; independent tables run as concurrent jobs
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(sources)))) as pool:
        for future in [pool.submit(load, name) for name in sources]:
            future.result()
    counts = [spark.read.parquet(targets[name]).agg(F.count("*").alias("loaded_rows"))
              .select(F.lit(name).alias("table_name"), "loaded_rows") for name in sources]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def schemas_from_catalogue(catalogue: DataFrame) -> dict:
    """{table: {column: spark type}} from a catalogue frame.

    The catalogue holds one row per column (width-bounded), so collecting
    it is metadata, not data.
    """
    out: dict = {}
    for r in catalogue.select("table_name", "position", "column_name", "spark_type").collect():
        out.setdefault(r["table_name"], []).append((r["position"], r["column_name"], r["spark_type"]))
    return {t: {c: ty for _, c, ty in sorted(cols)} for t, cols in out.items()}


def export_csv(df: DataFrame, path: str) -> None:
    """Write a table as one CSV folder with the loader's conventions.

    Timestamps are written as Spark casts them to text: seconds, and the
    fraction only where there is one, so no microsecond is lost; arrays and
    structs as JSON. A CSV file with quoted newlines is one task for every
    reader, so a table that would be written as fewer files than there are
    cores is dealt out first.
    """
    def cell(c: str, t: str) -> Column:
        if t.startswith(("array", "map", "struct")):
            return F.to_json(F.col(f"`{c}`")).alias(c)
        return F.col(f"`{c}`").cast("string").alias(c) if t.startswith("timestamp") else F.col(f"`{c}`")

    files = len(df.inputFiles())
    cores = df.sparkSession.sparkContext.defaultParallelism
    out = df.select(*[cell(c, t) for c, t in df.dtypes])
    if 0 < files < cores:
        # dealt by a number of the row's own, which a repeated task gives again: no sort of the rows, as for a deal in turn
        number = "".join(df.columns) + "_row"
        out = out.withColumn(number, F.monotonically_increasing_id()).repartition(cores, number).drop(number)
    w = out.write.mode("errorifexists")
    for k, v in CSV_WRITE_OPTIONS.items():
        w = w.option(k, v)
    w.csv(path)


def scratch_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def _in_parallel(jobs, workers: int = 4) -> None:
    """Submit independent Spark jobs together; the first failure is raised."""
    with ThreadPoolExecutor(max_workers=workers) as pool:
        for future in [pool.submit(job) for job in jobs]:
            future.result()


def export_tables(spark: SparkSession, tables: dict) -> str:
    """Write every table as ``<name>.csv`` below a new folder of the shared checkpoint folder; returns that folder."""
    base = scratch_dir(spark, "csv-raw")
    _in_parallel([partial(export_csv, df, f"{base}/{name}.csv") for name, df in tables.items()])
    return base


def load_exported(spark: SparkSession, raw: str, names) -> dict:
    """Infer and load exported tables typed: {name: typed frame}, written below a new shared folder.

    Raw CSV is parsed once, strictly, to a Parquet copy as text; inference and the strict casts read that copy.
    """
    base = scratch_dir(spark, "csv-load")
    _in_parallel([partial(lambda n: read_csv_strict(spark, f"{raw}/{n}.csv").write.parquet(f"{base}/text/{n}"), n) for n in names])
    text = {n: spark.read.parquet(f"{base}/text/{n}") for n in names}
    schemas = schemas_from_catalogue(infer_catalogue_many(text))
    _in_parallel([partial(lambda n: typed_columns(text[n], schemas[n]).write.parquet(f"{base}/parquet/{n}"), n) for n in names])
    return {n: spark.read.parquet(f"{base}/parquet/{n}") for n in names}


def roundtrip(spark: SparkSession, tables: dict) -> tuple[str, dict]:
    """Export tables to CSV, infer types from the text and load typed Parquet: (raw folder, {name: typed frame})."""
    raw = export_tables(spark, tables)
    return raw, load_exported(spark, raw, list(tables))


def raw_record_counts(spark: SparkSession, tables: dict) -> DataFrame:
    """(table_name, raw_rows) of the tables written as CSV, counted in the files, and their total as ``*``."""
    found = table_records(spark, export_tables(spark, tables)).select("table_name", F.col("records").alias("raw_rows"))
    total = found.agg(F.lit("*").alias("table_name"), F.sum("raw_rows").alias("raw_rows"))
    return found.unionByName(total)


def roundtrip_validation(spark: SparkSession, tables: dict) -> DataFrame:
    """(table_name, raw_rows, loaded_rows, n_columns, ok): records counted in the raw files against rows of the typed load."""
    raw, typed = roundtrip(spark, tables)
    loaded = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("loaded_rows")).select(
        F.lit(n).alias("table_name"), "loaded_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")) for n, df in typed.items()])
    counted = table_records(spark, raw).select("table_name", F.col("records").alias("raw_rows"))
    # a table that is missing on either side is not ok
    return counted.join(loaded, "table_name", "full_outer").select(
        "table_name", "raw_rows", "loaded_rows", "n_columns", F.coalesce(F.col("raw_rows") == F.col("loaded_rows"), F.lit(False)).alias("ok"))
