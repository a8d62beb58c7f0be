"""Column functions: rounding rules, text normalisation, reason map, formats."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayside.functions import dates, fmt, money, text


def one(spark, col, rows=None, schema=None):
    df = spark.createDataFrame(rows or [(1,)], schema or "x int")
    return df.select(col.alias("v")).first()["v"]


def test_half_up_on_decimal(spark):
    assert one(spark, money.round_half_up(F.lit(Decimal("2.345")), 2)) == Decimal("2.35")


def test_half_even_on_float(spark):
    assert one(spark, money.round_half_even(F.lit(2.5), 0)) == 2.0
    assert one(spark, money.round_half_even(F.lit(3.5), 0)) == 4.0


@pytest.mark.parametrize("total,n,expected", [
    ("10.05", 2, "5.03"),      # exactly half a cent rounds up
    ("-10.05", 2, "-5.03"),    # away from zero
    ("10.00", 3, "3.33"),
    ("0.01", 2, "0.01"),
    ("7.00", 0, None),         # no rows -> null
])
def test_mean_half_up(spark, total, n, expected):
    df = spark.createDataFrame([(Decimal(total), n)], "t decimal(18,2), n long")
    got = df.select(money.mean_half_up(F.col("t"), F.col("n")).alias("v")).first()["v"]
    assert (got is None and expected is None) or got == Decimal(expected)


def test_normalize_text(spark):
    rows = [("  Produto\tCOM  defeito de Fábrica ",), ("Item não corresponde à descrição",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [r["v"] for r in df.select(text.normalize_text("s").alias("v")).collect()]
    assert got == ["produto com defeito de fabrica", "item nao corresponde a descricao", None]


def test_every_spelling_maps(spark):
    df = spark.createDataFrame([(k.upper(),) for k in text.REASON_LABELS], "reason string")
    out = text.clean_reason(df, "reason").select("reason", "reason_clean").collect()
    assert {r["reason_clean"] for r in out} == set(text.REASON_LABELS.values())


@pytest.mark.parametrize("raw", [None, "", "   ", "---", "\t"])
def test_missing_reasons(spark, raw):
    df = spark.createDataFrame([(raw,)], "reason string")
    assert text.clean_reason(df, "reason").first()["reason_clean"] == text.REASON_MISSING


def test_unknown_reason_raises(spark):
    df = spark.createDataFrame([("caixa amassada",)], "reason string")
    with pytest.raises(Exception, match="without an explicit rule"):
        text.clean_reason(df, "reason").collect()
    assert text.unknown_reasons(df, "reason").count() == 1
    assert text.clean_reason(df, "reason", strict=False).first()["reason_clean"] is None


@pytest.mark.parametrize("value,expected", [
    (1234.56, "R$ 1.234,56"), (0.5, "R$ 0,50"), (-1234567.891, "R$ -1.234.567,89")])
def test_format_brl(spark, value, expected):
    assert one(spark, fmt.format_brl(F.lit(value))) == expected


@pytest.mark.parametrize("value,expected", [
    (1_096_687_344.91, "R$ 1,10 bi"), (4_276_548.78, "R$ 4,28 mi"), (28_704.99, "R$ 28,7 mil"), (999.0, "R$ 999,00")])
def test_format_compact(spark, value, expected):
    assert one(spark, fmt.format_compact_brl(F.lit(value))) == expected


def test_format_int_percent_date_label(spark):
    assert one(spark, fmt.format_int_pt(F.lit(48998.5))) == "48.998"      # half even
    assert one(spark, fmt.format_percent_pt(F.lit(0.818))) == "81,8%"
    assert one(spark, fmt.format_date_pt(F.lit(dt.date(2026, 8, 14)))) == "14/08/2026"
    assert one(spark, fmt.supplier_label(F.lit(4), F.lit("Acme"))) == "F04 · Acme"
    assert one(spark, fmt.display_name(F.lit("  "), F.lit(" Legal SA "))) == "Legal SA"


def test_cutoff_boundary(spark):
    rows = [(dt.datetime(2026, 8, 14, 23, 59, 59, 999999),), (dt.datetime(2026, 8, 15, 0, 0, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = df.select(dates.not_after(F.col("ts"), "2026-08-14").alias("v")).collect()
    assert [r["v"] for r in got] == [True, False]


def test_weekday_monday_first(spark):
    assert one(spark, dates.weekday_number(F.lit(dt.date(2024, 1, 1)))) == 0   # a Monday
    assert one(spark, dates.weekday_name(F.lit(6))) == "Domingo"
