"""Operators on small literal fixtures covering the report's semantic rules."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayside.operators import (calendar, channels, forecast, loyalty, profile, quality, returns, similarity,
                                suppliers)

D = Decimal
T = dt.datetime


@pytest.fixture()
def orders(spark):
    rows = [  # id, customer, channel, status, total, created_at
        (1, 10, "pos", "paid", D("10.00"), T(2024, 1, 1, 9)),        # Monday
        (2, 10, "pos", "paid", D("10.05"), T(2024, 1, 2, 9)),        # Tuesday
        (3, 20, "ecommerce", "confirmed", D("20.00"), T(2023, 12, 30, 9)),  # earliest, other channel
        (4, 20, "pos", "cancelled", D("5.00"), T(2024, 1, 3, 23, 59, 59, 999999)),
        (5, None, "pos", "paid", D("7.00"), T(2024, 1, 4, 0, 0, 0)),  # after the cutoff day
    ]
    return spark.createDataFrame(rows, "id long, customer_id long, channel string, status string, "
                                       "total decimal(18,2), created_at timestamp_ntz")


def test_customer_metrics_keeps_null_group_and_rounds_half_up(spark, orders):
    m = {r["customer_id"]: r for r in loyalty.customer_metrics(orders).collect()}
    assert m[10]["avg_ticket"] == D("10.03")          # 20.05 / 2 = 10.025 -> 10.03
    assert None in m                                  # SQL keeps the NULL key
    assert None not in {r["customer_id"] for r in loyalty.customer_metrics(orders, drop_null_keys=True).collect()}


def test_loyal_customers_threshold_and_ties(spark):
    metrics = spark.createDataFrame([(1, D("5.00"), 1, D("5.00")), (2, D("5.00"), 1, D("5.00")),
                                     (3, D("9.00"), 1, D("9.00"))],
                                    "customer_id long, revenue decimal(28,2), frequency long, avg_ticket decimal(38,2)")
    div = spark.createDataFrame([(1, 13), (2, 13), (3, 12)], "customer_id long, category_diversity long")
    top = loyalty.loyal_customers(metrics, div, 13, 10).collect()
    assert [r["customer_id"] for r in top] == [1, 2]   # 3 has 12 categories; tie -> id asc


def test_leading_category_by_name_with_tie_break(spark):
    lines = spark.createDataFrame([(1, "Bravo", 3), (1, "Alpha", 3), (2, "Alpha", 1), (9, "Zulu", 100)],
                                  "customer_id long, category string, quantity long")
    top = spark.createDataFrame([(1,), (2,)], "customer_id long")
    r = loyalty.leading_category(lines, top).first()
    assert (r["category"], r["total_items"]) == ("Alpha", 4)


def test_calendar_spine_from_all_channels_and_zero_days(spark, orders):
    cal = calendar.sales_calendar(orders, "2024-01-03", where=F.col("channel") == "pos")
    rows = {r["date"]: r["sales"] for r in cal.collect()}
    assert min(rows) == dt.date(2023, 12, 30)        # spine starts at the ecommerce order
    assert rows[dt.date(2023, 12, 30)] == 0 and rows[dt.date(2023, 12, 31)] == 0
    assert rows[dt.date(2024, 1, 3)] == D("5.00")     # 23:59:59.999999 is inside the day
    stats = calendar.calendar_stats(cal).first()
    assert (stats["calendar_days"], stats["zero_sales_days"]) == (5, 2)
    prof = {r["weekday_number"]: r for r in calendar.weekday_profile(cal).collect()}
    assert prof[0]["avg_sale"] == D("10.00") and prof[5]["avg_sale"] == D("0.00")


def test_worst_weekday_tie_goes_to_monday(spark):
    prof = spark.createDataFrame([(3, D("1.00")), (0, D("1.00")), (1, D("2.00"))],
                                 "weekday_number int, avg_sale decimal(10,2)")
    assert calendar.worst_weekday(prof).first()["weekday_number"] == 0


def test_channels_summary_share_and_pivot(spark, orders):
    biz = channels.business_orders(orders, ("paid", "confirmed"), "2024-01-03")
    summary = {r["channel"]: r for r in channels.channel_summary(biz).collect()}
    assert summary["pos"]["orders"] == 2 and summary["pos"]["revenue"] == D("20.05")
    assert abs(summary["pos"]["share"] + summary["ecommerce"]["share"] - 1.0) < 1e-12
    piv = channels.channel_yearly_pivot(channels.channel_monthly(biz), ["pos", "ecommerce", "phone"]).collect()
    by_year = {r["year"]: r for r in piv}
    assert by_year[2023]["pos"] == 0 and by_year[2024]["ecommerce"] == 0 and by_year[2024]["phone"] == 0


def test_returns_by_reason(spark):
    rows = [("completed", "Compra  DUPLICADA", D("1.00"), T(2024, 1, 1)),
            ("completed", "---", D("2.00"), T(2024, 1, 1)),
            ("completed", None, D("3.00"), T(2024, 1, 1)),
            ("pending", "outros", D("4.00"), T(2024, 1, 1)),
            ("completed", "outros", D("5.00"), T(2024, 1, 2))]          # after the cutoff
    df = spark.createDataFrame(rows, "status string, reason string, refund decimal(18,2), created_at timestamp_ntz")
    out = [(r["reason"], r["returns"], r["refund"]) for r in returns.returns_by_reason(df, "2024-01-01").collect()]
    assert out == [("Não informado", 2, D("5.00")), ("Compra duplicada", 1, D("1.00"))]


def test_supplier_punctuality_rules(spark):
    pos = spark.createDataFrame([
        (1, 1, "received", T(2024, 1, 1), dt.date(2024, 1, 10)),   # two receipts: last one counts (late 2)
        (2, 1, "received", T(2024, 1, 1), dt.date(2024, 1, 10)),   # on the promised day at 23:00 -> on time
        (3, 2, "received", T(2024, 1, 1), None),                   # no promise -> out
        (4, 2, "received", T(2024, 1, 1), dt.date(2024, 1, 10)),   # receipt after cutoff -> out
        (5, 3, "open", T(2024, 1, 1), dt.date(2024, 1, 10)),       # not received -> out
        (6, 3, "received", T(2024, 1, 1), dt.date(2024, 1, 10)),   # early -> on time
    ], "po_id long, supplier_id long, status string, placed_at timestamp_ntz, expected_delivery_at date")
    rec = spark.createDataFrame([(1, T(2024, 1, 9)), (1, T(2024, 1, 12, 8)), (2, T(2024, 1, 10, 23)),
                                 (3, T(2024, 1, 5)), (4, T(2024, 3, 1)), (6, T(2024, 1, 2))],
                                "po_id long, received_at timestamp_ntz")
    names = spark.createDataFrame([(1, "Legal One", " "), (3, "Legal Three", "Three")],
                                  "supplier_id long, legal_name string, trade_name string")
    done = suppliers.completed_orders(pos, rec, "2024-02-01")
    assert sorted(r["po_id"] for r in done.collect()) == [1, 2, 6]
    scores = {r["supplier_id"]: r for r in suppliers.supplier_scores(done, names).collect()}
    assert scores[1]["label"] == "F01 · Legal One" and scores[3]["label"] == "F03 · Three"
    assert scores[1]["on_time_rate"] == 0.5 and scores[1]["avg_late_days"] == 2.0
    assert scores[3]["avg_late_days"] == 0.0          # never late -> 0.0
    overall = suppliers.supplier_overall(done).first()
    assert (overall["completed_orders"], overall["late_orders"]) == (3, 1)
    assert [r["supplier_id"] for r in suppliers.worst_suppliers(suppliers.supplier_scores(done, names)).collect()] == [1, 3]


def test_forecast_walk_forward_and_strict(spark):
    # two ids under one name, an empty month, x.5 forecast
    lines = spark.createDataFrame([
        ("boat", T(2025, 9, 5), 3), ("boat", T(2025, 9, 20), 0), ("boat", T(2025, 11, 1), 2),
        ("boat", T(2025, 12, 1), 5), ("boat", T(2026, 1, 1), 4), ("boat", T(2026, 4, 1), 99),
        ("oar", T(2026, 2, 1), 1)],
        "name string, created_at timestamp_ntz, quantity long")
    monthly = forecast.monthly_demand(lines, "name", before="2026-04-01")
    dense = forecast.dense_months(monthly, "2026-03-01", "name")
    boat = [r["quantity"] for r in dense.where("name = 'boat'").orderBy("month").collect()]
    assert boat == [3, 0, 2, 5, 4, 0, 0]              # Sep..Mar, Oct and Feb/Mar filled with 0
    walk = {(r["name"], r["month"]): r for r in forecast.walk_forward(dense, "2025-12-01", 3, "name").collect()}
    jan = walk[("boat", dt.date(2026, 1, 1))]
    assert jan["forecast"] == pytest.approx(7 / 3) and jan["forecast_rounded"] == 2
    feb = walk[("boat", dt.date(2026, 2, 1))]
    assert feb["forecast"] == pytest.approx(11 / 3)    # uses January's actual
    assert walk[("oar", dt.date(2026, 2, 1))]["forecast"] is None   # no history
    assert walk[("oar", dt.date(2026, 3, 1))]["forecast"] == 1.0    # up to 3 months: one is enough
    strict = {r["month"]: r["forecast"] for r in forecast.trailing_mean(dense.where("name = 'oar'"), "name", 3, 3).collect()}
    assert strict[dt.date(2026, 3, 1)] is None          # needs exactly 3
    fixed = forecast.fixed_origin(dense, "2025-12-01", 3, "name").where("name = 'boat'").collect()
    assert len(fixed) == 3 and all(r["forecast"] == pytest.approx(7 / 3) for r in fixed)


def test_half_even_forecast_rounding(spark):
    dense = spark.createDataFrame([("a", dt.date(2025, 11, 1), 2), ("a", dt.date(2025, 12, 1), 3),
                                   ("a", dt.date(2026, 1, 1), 0)], "name string, month date, quantity long")
    r = forecast.walk_forward(dense, "2025-12-01", 1, "name").first()
    assert r["forecast"] == 2.5 and r["forecast_rounded"] == 2


def test_similarity_zero_overlap_ties_and_exclusion(spark):
    inter = spark.createDataFrame([(1, 100), (2, 100), (1, 200), (2, 300), (3, 400), (1, 500)],
                                  "customer_id long, product_id long")
    out = similarity.similar_items(inter, F.lit(100), k=None).collect()
    ids = [r["product_id"] for r in out]
    assert 100 not in ids and ids[-1] == 400          # zero overlap still a candidate, last
    sims = {r["product_id"]: r["similarity"] for r in out}
    assert sims[200] == pytest.approx(1 / (2 ** 0.5)) and sims[200] == sims[300] == sims[500]
    assert ids[:3] == [200, 300, 500]                  # tie -> id asc
    assert sims[400] == 0
    refs = spark.createDataFrame([(100,)], "product_id long")
    sparse = {r["product_id"]: r["similarity"] for r in similarity.similarity_to_references(inter, refs).collect()}
    assert sparse == {200: sims[200], 300: sims[300], 500: sims[500]}
    shape = similarity.matrix_shape(inter).first()
    assert (shape["customers"], shape["products"], shape["ones"]) == (3, 5, 6)


def test_missing_reference_product_raises(spark):
    products = spark.createDataFrame([(1, "a")], "product_id long, name string")
    with pytest.raises(ValueError):
        similarity.require_product(products, "zzz")


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, D("10.00"), D("1.00"), D("9.00")), (1, D("10.00"), D("1.00"), D("8.99")),
                                (None, D("10.00"), D("1.00"), D("8.98")), (None, D("1.00"), D("0"), D("1.00"))],
                               "id long, subtotal decimal(18,2), discount decimal(18,2), total decimal(18,2)")
    dup = quality.duplicate_keys(df, ["id"], "t").first()
    assert (dup["n_rows"], dup["n_distinct_keys"], dup["n_duplicates"]) == (4, 2, 2)   # nulls count as equal
    ident = quality.identity_mismatches(df, [("subtotal", 1), ("discount", -1)], "total").first()
    assert ident["n_mismatches"] == 1                  # 0.01 is tolerated, 0.02 is not
    parent = spark.createDataFrame([(1,)], "id long")
    child = spark.createDataFrame([(1,), (2,), (None,)], "pid long")
    assert quality.orphans(child, "pid", parent, "id", "c", "p").first()["n_orphans"] == 1
    rec = quality.reconcile(spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"),
                            spark.createDataFrame([(1, 1.5), (3, 3.0)], "k int, v double"), "k", "v", "x").first()
    assert (rec["n_keys"], rec["missing_left"], rec["missing_right"], rec["max_abs_diff"]) == (3, 1, 1, 0.5)


def test_profile_ops(spark):
    df = spark.createDataFrame([(float(x), "a" if x % 2 else None) for x in [1, 2, 3, 4, 100]],
                               "x double, s string")
    d = profile.describe(df, "x").first()
    assert (d["count"], d["q25"], d["q50"], d["q75"]) == (5, 2.0, 3.0, 4.0)   # linear interpolation
    out = {r["factor"]: r for r in profile.iqr_outliers(df, "x", (1.5, 3.0)).collect()}
    assert out[1.5]["upper_fence"] == 7.0 and out[1.5]["n_above"] == 1
    nulls = {r["column_name"]: r["null_count"] for r in profile.null_counts(df, "t").collect()}
    assert nulls == {"x": 0, "s": 3}
    vc = profile.value_counts(df, "s").collect()
    assert [(r["value"], r["n"]) for r in vc] == [("a", 2)]      # nulls dropped
    assert profile.rows_after_cutoff(
        spark.createDataFrame([(T(2024, 1, 1, 23, 59),), (T(2024, 1, 2),)], "ts timestamp_ntz"),
        "ts", "2024-01-01").first()["future_rows"] == 1


def test_exact_quantiles_match_percentile(spark):
    import random
    rnd = random.Random(7)
    vals = [round(rnd.choice([rnd.uniform(0, 100), 5.0, 7.25]), 2) for _ in range(2000)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = profile.exact_quantiles(df, "x", probs, partitions=7).first()
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0]
    assert [round(got[f"q{i}"], 9) for i in range(len(probs))] == [round(w, 9) for w in want]


@pytest.mark.parametrize("most", [20_000, 40, 1])
def test_quantiles_by_bracket_and_select(spark, monkeypatch, most):
    """Small limits force rounds of sketches; heavy ties, both infinities and NaN stand at their ranks."""
    import math
    import random
    monkeypatch.setattr(profile, "MOST", most)
    rnd = random.Random(11)
    vals = [rnd.gauss(0, 1) for _ in range(3000)] + [0.5] * 4000 + [-3.0] + [9.0] * 500 + [float("inf")] * 40 + [float("-inf")] * 40
    df = spark.createDataFrame([(v,) for v in rnd.sample(vals, len(vals))], "x double").repartition(6)
    ordered, probs = sorted(vals), (0.0, 0.001, 0.1, 0.2, 0.25, 0.5, 0.77, 0.9, 0.95, 1.0)
    got = profile.quantiles(df, "x", probs, mergers=3)
    for p, q in zip(probs, got):
        h = (len(vals) - 1) * p
        a, b = ordered[math.floor(h)], ordered[math.ceil(h)]
        assert q == (a if math.floor(h) == math.ceil(h) else (math.ceil(h) - h) * a + (h - math.floor(h)) * b)
    n, at = profile.ranked_values(df.union(spark.createDataFrame([(float("nan"),)], "x double")), "x", [1, len(vals), len(vals) + 1])
    assert n == len(vals) + 1 and at[1] == float("-inf") and at[len(vals)] == float("inf") and math.isnan(at[n])


def test_a_bracket_that_misses_its_rank_is_widened():
    b = profile._Bracket(50, 1000)
    margin = b.margin
    b.counted(2.0, 3.0, 60, 5, 100, 5)      # 60 values lie below: too high
    assert b.value is None and b.low is None and b.margin == 8 * margin
    b.counted(1.0, 3.0, 10, 5, 100, 5)
    assert (b.low, b.high, b.below, b.inside, b.margin) == (1.0, 3.0, 15, 100, margin)
    b.counted(1.5, 2.0, 20, 30, 10, 1)
    assert b.value == 1.5


def test_sold_before_registration(spark):
    lines = spark.createDataFrame([("a", T(2024, 1, 5)), ("a", T(2024, 3, 1)), ("b", T(2024, 6, 1))],
                                  "name string, created_at timestamp_ntz")
    registry = spark.createDataFrame([("a", T(2024, 2, 1)), ("b", T(2024, 1, 1))],
                                     "name string, created_at timestamp_ntz")
    span = forecast.sale_span(lines)
    early = forecast.sold_before_registration(span, registry).collect()
    assert [(r["name"], r["first_sale"]) for r in early] == [("a", dt.date(2024, 1, 5))]


def test_evaluate_expectations_reports_all_failures(spark):
    actual = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "check_name string, value double")
    expected = spark.createDataFrame([("a", "first", 1.0), ("b", "second", 3.0), ("c", "missing", 0.0)],
                                     "check_name string, label string, expected double")
    out = {r["check_name"]: r["ok"] for r in quality.evaluate_expectations(actual, expected).collect()}
    assert out == {"a": True, "b": False, "c": False}


def test_calendar_before_first_order_is_empty(spark, orders):
    cal = calendar.sales_calendar(orders, "2020-01-01", where=F.col("channel") == "pos")
    assert cal.count() == 0
    assert calendar.calendar_stats(cal).first()["calendar_days"] == 0


def test_exact_quantiles_of_empty_or_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    r = profile.exact_quantiles(df, "x", (0.25, 0.75), partitions=2).first()
    assert (r["q0"], r["q1"]) == (None, None)
    d = profile.describe(df, "x").first()
    assert d["count"] == 0 and d["q50"] is None


def test_similarity_reference_without_buyers_raises(spark):
    inter = spark.createDataFrame([(1, 100), (2, 200)], "customer_id long, product_id long")
    with pytest.raises(Exception, match="no buyers"):
        similarity.similar_items(inter, F.lit(999), k=None).collect()


def test_ordered_lists_differ_by_place_not_only_by_content(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "position int, name string")
    swapped = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "position int, name string")
    shorter = left.where("position < 3")
    row = lambda other: tuple(quality.same_ordered_list(left, other, "position", "c").first())
    assert row(left) == ("c", 3, 3, 0, True)
    assert row(swapped) == ("c", 3, 3, 2, False)
    assert row(shorter) == ("c", 3, 2, 1, False)


def test_fractional_quantities_are_kept(spark):
    import datetime as dt
    lines = spark.createDataFrame([("p", dt.datetime(2024, 1, 5), 0.5), ("p", dt.datetime(2024, 1, 9), 0.25)], "name string, created_at timestamp_ntz, quantity double")
    dense = forecast.dense_months(forecast.monthly_demand(lines), "2024-02-01").orderBy("month").collect()
    assert [r["quantity"] for r in dense] == [0.75, 0.0]


def test_one_pass_suppliers_equal_the_join(spark):
    from quayside.operators import suppliers
    from quayside.plans.model import star_model
    model = star_model(spark, "/root/testdata/sf0.001")
    columns = ["order_key", "supplier_id", "delay_days", "on_time"]
    a = suppliers.completed_orders_of(model, "2000-12-31").select(*columns)
    b = suppliers.completed_orders(model.purchase_orders, model.receipts, "2000-12-31", keys=model.po_keys).select(*columns)
    assert a.count() > 0 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_orphans_of_all_relations_read_each_table_once(spark):
    tables = {"child": spark.createDataFrame([(1, 10), (2, 20), (2, 99), (None, 10), (7, None), (7, 99)], "a int, b long"),
              "other": spark.createDataFrame([(10,), (11,)], "k int"),
              "p": spark.createDataFrame([(1,), (2,)], "id int"), "q": spark.createDataFrame([(10,), (20,), (20,)], "id long")}
    relations = (("child", "a", "p", "id"), ("child", "b", "q", "id"), ("other", "k", "q", "id"), ("p", "id", "p", "id"))
    out = quality.all_orphans(tables, relations)
    assert sorted(tuple(r) for r in out.collect()) == [("child", "a", "p", 2), ("child", "b", "q", 2), ("other", "k", "q", 1), ("p", "id", "p", 0)]
    for c, ck, p, pk in relations:
        assert quality.orphans(tables[c], ck, tables[p], pk, c, p).first()["n_orphans"] == out.where((F.col("child_table") == c) & (F.col("child_column") == ck)).first()["n_orphans"]
    text = {"c": spark.createDataFrame([("x",), ("y",)], "k string"), "p": spark.createDataFrame([("x",)], "k string")}
    assert quality.all_orphans(text, [("c", "k", "p", "k")]).first()["n_orphans"] == 1


def test_differences_are_located_by_the_buckets_that_differ(spark):
    left = spark.range(5000).selectExpr("id AS k", "id * 2 AS a", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('v', id) END AS b")
    right = (left.where("k <> 17").withColumn("a", F.expr("CASE WHEN k = 100 THEN NULL ELSE a END"))
             .withColumn("b", F.expr("CASE WHEN k IN (100, 7) THEN 'new' ELSE b END")).select("b", "k", "a")
             .unionByName(spark.sql("SELECT 'z' AS b, -1L AS k, 0L AS a")))
    got = sorted(tuple(r) for r in quality.located_differences(left, right, "k", buckets=512).collect())
    assert got == [(-1, "added", None), (7, "changed", "b"), (17, "removed", None), (100, "changed", "a,b")]
    assert quality.differing_buckets(left, right.select(left.columns), ["k"], 512).count() <= 4
    assert quality.located_differences(left, left.repartition(7), "k").isEmpty()
    with pytest.raises(ValueError):
        quality.located_differences(left, right.drop("a"), "k")


def test_category_sets_merge_over_periods(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.randrange(6), f"2024-{rnd.randrange(1, 13):02d}-01", rnd.choice([f"c{k}" for k in range(150)] + [None])) for _ in range(900)]
    lines = spark.createDataFrame(rows, "customer_id int, day string, category string")
    numbers = loyalty.numbered_categories(lines)
    assert {r["word"] for r in numbers.collect()} == {0, 1, 2}          # more than one word of 64
    monthly = loyalty.category_sets(lines, numbers, F.substring("day", 1, 7))
    for sets, period in ((monthly, lambda d: d[:7]), (loyalty.rolled_up(monthly, F.lit("all")), lambda d: "all")):
        want = {}
        for c, d, x in rows:
            if x is not None:
                want.setdefault((c, period(d)), set()).add(x)
        assert {(r["customer_id"], r["period"]): r["category_diversity"] for r in loyalty.set_sizes(sets).collect()} == {k: len(v) for k, v in want.items()}


def test_decimals_are_hashed_without_the_format_of_doubles(spark):
    from decimal import Decimal

    from quayside.operators import quality

    values = [Decimal("0"), Decimal("-0.01"), Decimal("0.000001"), Decimal("-0.000001"), Decimal("123456789.123456"), Decimal("-999999999.999999"), None]
    for kind, cells in (("decimal(15,6)", values), ("decimal(3,0)", [Decimal(-999), Decimal(0)]), ("int", [-2147483648, 0, 7]),
                        ("decimal(20,2)", [Decimal("123456789012345678.25")]), ("decimal(10,8)", [Decimal("0.00000049"), Decimal("1.23456789")])):
        df = spark.createDataFrame([(c,) for c in cells], f"x {kind}")
        got = [r[0] for r in df.select(quality.row_text(df, fractions=["x"])).collect()]
        assert got == ["\\N" if c is None else "%.6f" % (0.0 if abs(float(c)) < 5e-7 else float(c)) for c in cells]
        plan = quality.content_hash(df, fractions=["x"])._jdf.queryExecution().optimizedPlan().toString()
        assert ("format_string" in plan) == (kind in ("decimal(20,2)", "decimal(10,8)"))
