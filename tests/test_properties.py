"""Batch property checks: many generated cases evaluated in one Spark job each."""

import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from quayside.functions import money
from quayside.sources import infer
from quayside.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_mean_half_up_matches_decimal_quantize(spark):
    rnd = random.Random(3)
    cases = []
    for _ in range(3000):
        n = rnd.randint(1, 50)
        total = Decimal(rnd.randint(-10**9, 10**9)) / 100
        cases.append((total, n))
    cases += [(Decimal("0.05"), 2), (Decimal("-0.05"), 2), (Decimal("12345678.90"), 4)]
    df = spark.createDataFrame(cases, "t decimal(18,2), n long")
    got = df.select("t", "n", money.mean_half_up(F.col("t"), F.col("n")).alias("v")).collect()
    for r in got:
        want = (r["t"] / Decimal(r["n"])).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)
        assert r["v"] == want, (r["t"], r["n"], r["v"], want)


def test_inferred_types_accept_every_value(spark):
    """Each column's inferred Spark type parses all of its non-empty text values."""
    for name in ("orders", "lineitem", "customer", "part", "events"):
        raw = read_table(spark, SF, name)
        text = raw.select([F.col(c).cast("string").alias(c) for c in raw.columns])
        cat = {r["column_name"]: r["spark_type"] for r in infer.infer_catalogue(text, name).collect()}
        checks = [F.count_if(F.col(c).isNotNull() & (F.trim(c) != "") & F.trim(c).try_cast(t).isNull()).alias(c)
                  for c, t in cat.items() if t != "string"]
        if checks:
            bad = text.agg(*checks).first().asDict()
            assert all(v == 0 for v in bad.values()), (name, bad)


# spellings and the text that the report's rules give, worked out by hand
NORMAL_FORMS = [
    ("  Produto\tCOM  defeito de F\u00c1BRICA ", "produto com defeito de fabrica"),
    ("\u00c0\u00c9\u00ce\u00d5\u00dc \u00e7\u00f1 \u00ff", "aeiou cn y"),
    ("a\u0301\u0327b", "ab"),                                   # loose accents
    ("\u1ebf vi\u1ec7t", "e viet"),                              # two accents on one letter
    ("\ufb01lme \ufb03", "filme ffi"),                           # ligatures
    ("\uff21\uff22\uff43\u3000\uff11", "abc 1"),                # full-width forms
    ("\u2163 \u2167", "iv viii"),                                # Roman numerals
    ("\u0391\u0301\u03ad", "\u03b1\u03b5"),                      # Greek accents
    ("\u0439\u0451", "\u0438\u0435"),                            # Cyrillic
    ("\u0915\u0940 \u092c\u093e\u0924", "\u0915\u0940 \u092c\u093e\u0924"),  # vowel signs are no accents
    ("\u00bd \u2075", "1\u20442 5"),
    ("x\x1cy\xa0z\u2003w", "x y z w"),
    ("\ud55c", "\u1112\u1161\u11ab"),                            # a syllable falls apart into its letters
    ("", ""), ("   ", ""), (None, None),
]


def test_normal_forms_of_many_scripts(spark):
    from quayside.functions import text
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NORMAL_FORMS)], "i int, s string")
    got = {r["i"]: r["v"] for r in df.select("i", text.normalize_text("s").alias("v")).collect()}
    assert [got[i] for i in range(len(NORMAL_FORMS))] == [b for _, b in NORMAL_FORMS]


# columns and the type that the ladder gives them, worked out by hand
TYPED_COLUMNS = [
    (["TRUE", "false", " True "], "boolean"), (["TRUE", "1"], "text"), (["true", None, "", "  "], "boolean"),
    (["2024-01-05 10:00:00", "2024-1-5 1:2:3"], "timestamp"), (["2024-02-30 10:00:00"], "text"), (["2024-01-05 24:00:00"], "text"),
    (["2024-01-05 10:00:00", "2024-01-05"], "text"), (["2024-01-05 10:00:00.5"], "text"),
    (["2024-01-05", "2024-1-5"], "date"), (["2024-02-30"], "text"), (["2024-13-01"], "text"),
    (["12", "-12", "+7"], "integer"), ([" 42 "], "integer"), (["0", "-0"], "integer"), (["007"], "text"), (["00"], "text"), (["-01", "5"], "text"),
    (["2147483647"], "integer"), (["2147483648"], "bigint"), (["-2147483648"], "bigint"), (["9223372036854775807"], "bigint"),
    (["9223372036854775808"], "text"), (["12345678901234567890123456789012345678901234"], "text"),
    (["1.5", "-0.25", "12"], "numeric"), ([".5", "5."], "numeric"), (["1e3", "1E-3"], "numeric"), (["1_000"], "numeric"),
    (["nan", "inf", "-Infinity"], "numeric"), (["007", "1.5"], "numeric"), (["1 2"], "text"), (["+"], "text"), (["."], "text"), (["1,5"], "text"),
    (["abc", "12"], "text"), ([None, "", "   "], "text"),
]


def test_inferred_type_of_known_columns(spark):
    names = [f"c{i}" for i in range(len(TYPED_COLUMNS))]
    rows = [tuple(v[r] if r < len(v) else None for v, _ in TYPED_COLUMNS) for r in range(4)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {r["column_name"]: r["inferred_type"] for r in infer.infer_catalogue(df, "t").collect()}
    bad = [(v, got[n], want) for n, (v, want) in zip(names, TYPED_COLUMNS) if got[n] != want]
    assert not bad, bad


# numbers and how the report prints them: 2 decimals, 1 decimal, whole, and a millionth as a percentage
PRINTED = [
    (0.0, "0,00", "0,0", "0", "0,0%"), (1234.5, "1.234,50", "1.234,5", "1.234", "0,1%"), (-1234567.891, "-1.234.567,89", "-1.234.567,9", "-1.234.568", "-123,5%"),
    (2.5, "2,50", "2,5", "2", "0,0%"), (3.5, "3,50", "3,5", "4", "0,0%"), (0.125, "0,12", "0,1", "0", "0,0%"), (999999.999, "1.000.000,00", "1.000.000,0", "1.000.000", "100,0%"),
    (1e9, "1.000.000.000,00", "1.000.000.000,0", "1.000.000.000", "100000,0%"), (1.005, "1,00", "1,0", "1", "0,0%"), (-0.5, "-0,50", "-0,5", "0", "-0,0%"),
]


def test_ptbr_formats_of_known_numbers(spark):
    from quayside.functions import fmt
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(PRINTED)], "i int, x double")
    out = {r["i"]: tuple(r)[1:] for r in df.select(
        "i", fmt.format_decimal_pt(F.col("x"), 2), fmt.format_decimal_pt(F.col("x"), 1), fmt.format_int_pt(F.col("x")),
        fmt.format_percent_pt(F.col("x") / 1e6)).collect()}
    for i, row in enumerate(PRINTED):
        assert tuple(t.replace("-0,0%", "0,0%") if t == "-0,0%" else t for t in out[i]) == tuple(
            t.replace("-0,0%", "0,0%") if t == "-0,0%" else t for t in row[1:]), row
