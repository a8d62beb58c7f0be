"""Report marts: build all, KPI row, expectations, publish.

``build_marts`` defines every mart from one model and one cutoff; nothing
runs until a mart is written or counted. The KPI row combines one-row
aggregates through scalar subqueries (each computed once), never a cross
join of frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import add_months, after, as_date, month_floor
from ..functions.dates import not_after as before_end
from ..operators import calendar, channels, forecast, loyalty, quality, returns, similarity, suppliers
from . import params as P
from ..sources.csv_ingest import scratch_dir
from .model import RetailModel, sales_lines


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage for an intermediate that several marts reuse: later jobs
    read the files instead of re-running the joins, and a lost executor
    only costs re-reading its file splits.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, f"mart-{name}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def scalars(df: DataFrame, **exprs) -> dict:
    """Several one-row aggregates of ``df`` from ONE scalar subquery (a struct)."""
    sub = df.select(F.struct(*[e.alias(k) for k, e in exprs.items()])).scalar()
    return {k: sub.getField(k) for k in exprs}


def build_marts(model: RetailModel, cutoff_day: str = P.CUTOFF_DAY,
                reuse_lines: bool = True) -> dict[str, DataFrame]:
    """All report marts for one cutoff (lazy).

    ``reuse_lines`` writes the order-lines join once (shared checkpoint
    folder) because five marts read it; the write is the only eager step.
    """
    lines = sales_lines(model)
    if reuse_lines:
        lines = materialize(lines.select("customer_id", "created_at", "product_id", "name", "category",
                                         "quantity"), "lines")
    metrics = loyalty.customer_metrics(model.orders)
    diversity = loyalty.category_diversity(lines)
    top = loyalty.loyal_customers(metrics, diversity, P.MIN_CATEGORIES, P.TOP_CUSTOMERS)
    cal = calendar.sales_calendar(model.orders, cutoff_day, where=F.col("channel") == P.POS_CHANNEL)
    business = channels.business_orders(model.orders, P.BUSINESS_STATUSES, cutoff_day)
    monthly = channels.channel_monthly(business)
    done = suppliers.completed_orders_of(model, cutoff_day)
    named = lines.withColumnRenamed("name", "product_name")
    last = add_months(month_floor(P.FORECAST_TRAIN_END), P.FORECAST_TEST_MONTHS)
    dense = forecast.dense_months(forecast.monthly_demand(named, "product_name", before=add_months(last, 1)),
                                  last, key="product_name")
    walk = forecast.walk_forward(dense, P.FORECAST_TRAIN_END, P.FORECAST_TEST_MONTHS, key="product_name",
                                 window=P.FORECAST_WINDOW)
    inter = similarity.interactions(lines)
    ref = similarity.first_id_by_name(model.products, P.REFERENCE_PRODUCT)
    return {
        "loyal_customers": top,
        "loyal_top_category": loyalty.leading_category(lines, top),
        "weekday_calendar": calendar.weekday_profile(cal),
        "calendar_stats": calendar.calendar_stats(cal),
        "channel_monthly": monthly,
        "channel_summary": channels.channel_summary(business),
        "channel_yearly": channels.channel_yearly_pivot(monthly, P.CHANNELS),
        "returns_by_reason": returns.returns_by_reason(model.returns, cutoff_day, model.return_completed),
        "supplier_scores": suppliers.supplier_scores(done, model.suppliers),
        "supplier_overall": suppliers.supplier_overall(done),
        "forecast": walk.where(F.col("product_name") == P.FORECAST_PRODUCT),
        "similar_items": similarity.similar_items(inter, ref, P.SIMILAR_TOP_N),
    }


def kpi_row(spark: SparkSession, model: RetailModel, cutoff_day: str = P.CUTOFF_DAY) -> DataFrame:
    """One row of headline figures for a cutoff (one scalar subquery per mart)."""
    return kpi_from_marts(spark, build_marts(model, cutoff_day), model, cutoff_day)


def raw_counts(model: RetailModel) -> tuple[int, list[DataFrame]]:
    """How many source tables the model reads, and one row count each.

    ``model.sources`` names the physical tables (or raw files' frames): logical
    frames may share a table, filter it or join it, so they are no raw rows.
    """
    sources = model.sources
    return len(sources), [f.agg(F.count("*").alias("n")) for f in sources.values()]


def kpi_from_marts(spark: SparkSession, m: dict, model: RetailModel, cutoff_day: str = P.CUTOFF_DAY) -> DataFrame:
    """The KPI row from already built (or already published) marts; sources are only counted."""
    n_sources, counts = raw_counts(model)
    raw = scalars(reduce(DataFrame.unionByName, counts), raw_rows=F.sum("n"))
    o = scalars(model.orders, raw_order_count=F.count("*"),
                future_orders=F.count_if(after(F.col("created_at"), cutoff_day)))
    cat = scalars(m["loyal_top_category"], top_category=F.first("category"),
                  top_category_items=F.first("total_items"))
    wk = scalars(calendar.worst_weekday(m["weekday_calendar"]), worst_weekday=F.first("weekday_name"),
                 worst_weekday_avg=F.first(F.col("avg_sale").cast("double")))
    cs = scalars(m["calendar_stats"], calendar_days=F.first("calendar_days"),
                 zero_sales_days=F.first("zero_sales_days"))
    ch = scalars(m["channel_summary"], business_orders=F.sum("orders"),
                 total_revenue=F.sum("revenue").cast("double"),
                 ticket_gap=F.abs(F.max(F.when(F.col("channel") == P.CHANNELS[0], F.col("avg_ticket")))
                                  - F.max(F.when(F.col("channel") == P.CHANNELS[-1], F.col("avg_ticket"))))
                 .cast("double"))
    rt = scalars(m["returns_by_reason"], completed_returns=F.sum("returns"),
                 refund_total=F.sum("refund").cast("double"))
    sp = scalars(m["supplier_overall"], completed_purchase_orders=F.first("completed_orders"),
                 late_purchase_orders=F.first("late_orders"), on_time_rate=F.first("on_time_rate"),
                 avg_late_days=F.first("avg_late_days"))
    best_return = F.struct((-F.col("returns")).alias("n"), F.col("reason").alias("r"))
    rt |= scalars(m["returns_by_reason"], top_return_reason=F.min_by("reason", best_return))
    best = F.struct((-F.col("avg_ticket")).alias("t"), F.col("customer_id").alias("c"))
    lc = scalars(m["loyal_customers"], best_customer=F.min_by("customer_id", best),
                 best_customer_ticket=F.max("avg_ticket").cast("double"))
    fc = scalars(m["forecast"], forecast_total=F.sum("forecast_rounded"),
                 forecast_actual_total=F.sum("actual"), forecast_mae=F.round(F.avg("abs_error"), 6),
                 forecast_gap=F.sum("forecast_rounded") - F.sum("actual"))
    # at most the top-n rows meet the products
    named = model.products.select("product_id", "name").join(F.broadcast(m["similar_items"].select("product_id", "similarity")), "product_id")
    sim = scalars(named, top_similar_name=F.min_by("name", F.struct((-F.col("similarity")).alias("s"), F.col("product_id").alias("p"))))
    sim |= scalars(m["similar_items"], top_similar_product=F.min_by("product_id", F.struct(
        (-F.col("similarity")).alias("s"), F.col("product_id").alias("p"))))
    cols = {**raw, **o, **cat, **wk, **cs, **ch, **rt, **sp, **lc, **fc, **sim}
    return spark.range(1).select(F.lit(n_sources).cast("bigint").alias("raw_tables"), *[c.alias(k) for k, c in cols.items()])


def expectation_facts(spark: SparkSession, model: RetailModel, cutoff_day: str = P.CUTOFF_DAY) -> DataFrame:
    """(check_name, label, expected, value): invariants between marts and direct counts."""
    m = build_marts(model, cutoff_day, reuse_lines=False)   # no check reads the order-lines marts
    bound = F.lit(as_date(cutoff_day)).cast("date")
    orders = model.orders
    not_after = before_end(F.col("created_at"), cutoff_day)
    d = lambda e: e.cast("double")
    direct = scalars(orders, n_orders=d(F.count("*")),
                     n_business=d(F.count_if(not_after & F.col("status").isin(list(P.BUSINESS_STATUSES)))),
                     span_days=d(F.date_diff(bound, F.min(F.to_date("created_at"))) + 1))
    summary = scalars(m["channel_summary"], revenue=d(F.sum("revenue")), orders=d(F.sum("orders")))
    monthly = scalars(m["channel_monthly"], revenue=d(F.sum("revenue")))
    cal = scalars(m["calendar_stats"], days=d(F.first("calendar_days")))
    week = scalars(m["weekday_calendar"], days=d(F.sum("days")))
    ret_direct = scalars(model.returns.where((F.col("status") == model.return_completed) & not_after),
                         n=d(F.count("*")))
    ret = scalars(m["returns_by_reason"], n=d(F.sum("returns")))
    sup = scalars(m["supplier_overall"], n=d(F.first("completed_orders")))
    per_sup = scalars(m["supplier_scores"], n=d(F.sum("orders")))
    freq = scalars(loyalty.customer_metrics(orders), n=d(F.sum("frequency")))
    checks = [
        ("channel_months_sum", "monthly channel revenue adds up to the channel summary",
         summary["revenue"], monthly["revenue"]),
        ("channel_orders", "business orders counted directly", direct["n_business"], summary["orders"]),
        ("calendar_length", "calendar covers every day from the first order to the cutoff",
         direct["span_days"], cal["days"]),
        ("weekday_days", "weekday day counts add up to the calendar", cal["days"], week["days"]),
        ("returns_count", "every completed return up to the cutoff has a reason", ret_direct["n"], ret["n"]),
        ("supplier_orders", "per-supplier completed orders add up to the total", sup["n"], per_sup["n"]),
        ("customer_orders", "customer frequencies add up to all orders", direct["n_orders"], freq["n"]),
    ]
    rows = [F.struct(F.lit(c).alias("check_name"), F.lit(lbl).alias("label"), e.alias("expected"), v.alias("value"))
            for c, lbl, e, v in checks]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def expectations_report(spark: SparkSession, model: RetailModel, cutoff_day: str = P.CUTOFF_DAY,
                        tolerance: float = 0.0) -> DataFrame:
    """(check_name, label, expected, value, ok) — every check, failures included.

    Expected and actual values come from the same one-row evaluation, so
    ``ok`` is a column expression (``quality.evaluate_expectations`` is the
    join form for expectations kept in a separate table).
    """
    facts = expectation_facts(spark, model, cutoff_day)
    ok = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.lit(tolerance), F.lit(False))
    return facts.select("check_name", "label", "expected", "value", ok.alias("ok"))


# What a published table may hold: aggregates, labels of groups and the ids that the report itself prints.
PUBLISHED_COLUMNS = frozenset("""
    customer_id customers revenue frequency avg_ticket category_diversity orders categories category total_items weekday_number weekday_name
    avg_sale days calendar_days zero_sales_days first_day last_day month year channel share revenue_compact reason returns refund supplier_id
    label on_time_rate avg_late_days on_time completed_orders late_orders product_name actual forecast forecast_rounded abs_error product_id
    overlap buyers similarity position name raw_tables raw_rows raw_order_count future_orders top_category top_category_items worst_weekday
    worst_weekday_avg business_orders total_revenue ticket_gap completed_returns refund_total top_return_reason completed_purchase_orders
    late_purchase_orders best_customer best_customer_ticket forecast_total forecast_actual_total forecast_mae forecast_gap top_similar_name
    top_similar_product""".split())


def publish(marts: dict[str, DataFrame], out_dir: str, allowed=PUBLISHED_COLUMNS | set(P.CHANNELS)) -> dict[str, str]:
    """Write aggregate-only marts as Parquet (overwrite), rows in a total order.

    A global sort range-partitions the rows, so the part files read in
    order are deterministic without funnelling a mart through one task.
    A mart with any column outside ``allowed`` is refused before any
    write, so a new column is published only once it is listed. Returns mart -> path.
    """
    leaks = {name: quality.aggregate_only(df, allowed) for name, df in marts.items()}
    leaks = {k: v for k, v in leaks.items() if v}
    if leaks:
        raise ValueError(f"marts have columns that are not listed for publishing: {leaks}")
    paths = {}
    for name, df in marts.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        df.orderBy(*df.columns).write.mode("overwrite").parquet(path)
        paths[name] = path
    return paths


def mart_fingerprints(marts: dict[str, DataFrame]) -> DataFrame:
    """(mart, n_rows, hash_sum): order-insensitive content hash of each mart."""
    parts = [quality.content_hash(df).select(F.lit(name).alias("mart"), "n_rows", "hash_sum")
             for name, df in marts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snapshot_expectations(spark: SparkSession, model: RetailModel, cutoff_day: str = P.CUTOFF_DAY) -> DataFrame:
    """(check_name, label, expected): the headline figures counted directly on the model, one pass per fact table.

    They are kept apart from the marts: a report's own figures, observed while
    it is written, are joined to this table by name.
    """
    seen = before_end(F.col("created_at"), cutoff_day)
    bound = F.lit(as_date(cutoff_day)).cast("date")
    business = seen & F.col("status").isin(list(P.BUSINESS_STATUSES))
    span = (F.date_diff(bound, F.min(F.to_date("created_at"))) + 1).cast("double")
    checks = [("business_orders", "orders in the business statuses up to the cutoff", F.count_if(business)),
              ("total_revenue", "their revenue", F.sum(F.when(business, F.col("total")))),
              ("calendar_days", "days from the first order to the cutoff", span), ("weekday_days", "the same days by weekday", span)]
    done = (F.col("status") == model.return_completed) & seen
    returned = [("completed_returns", "completed returns up to the cutoff", F.count_if(done)),
                ("refund_total", "their refunds", F.sum(F.when(done, F.col("refund"))))]
    late = suppliers.completed_orders_of(model, cutoff_day)
    supplied = [("completed_purchase_orders", "purchase orders received in full", F.count("*")),
                ("supplier_orders", "the same by supplier", F.count("*")),
                ("late_purchase_orders", "received after the promised day", F.count_if(F.col("delay_days") > 0))]

    def rows(frame: DataFrame, wanted) -> DataFrame:
        one = frame.agg(*[e.cast("double").alias(name) for name, _, e in wanted])
        return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(label).alias("label"), F.col(n).alias("expected"))
                                              for n, label, _ in wanted])).alias("c")).select("c.*")

    return reduce(DataFrame.unionByName, [rows(model.orders, checks), rows(model.returns, returned), rows(late, supplied)])


def build_report(spark: SparkSession, model: RetailModel, out_dir: str,
                 cutoff_day: str = P.CUTOFF_DAY) -> dict[str, str]:
    """Build every mart for one cutoff, check the expectations, publish as one version.

    Invariants between marts are evaluated first; then the marts are written
    to a new version's folder, and the figures that the writes observed must
    meet the snapshot's. Every failure is reported at once, and nothing is
    published when one fails. The KPI row and the pt-BR display tables are
    made from the written marts, and the manifest comes last. Returns mart -> path.
    """
    from . import display
    from .publish import Version

    failed = [r["check_name"] for r in expectations_report(spark, model, cutoff_day).where(~F.col("ok")).collect()]
    if failed:   # at most one row per expectation
        raise AssertionError(f"report expectations failed: {failed}")
    version = Version(spark, out_dir)
    paths = version.write(build_marts(model, cutoff_day))
    version.require(snapshot_expectations(spark, model, cutoff_day))
    # everything below reads the small written marts, not the facts again
    m = version.read()
    worst = suppliers.worst_suppliers(m["supplier_scores"], P.WORST_SUPPLIERS)
    tables = {
        "kpi": kpi_from_marts(spark, m, model, cutoff_day),
        "display_channels": display.channels_table(m["channel_summary"]),
        "display_channels_yearly": display.channels_yearly_table(m["channel_yearly"]),
        "display_customers": display.customers_table(m["loyal_customers"]),
        "display_weekday": display.weekday_table(m["weekday_calendar"]),
        "display_recommendations": display.recommendations_table(
            m["similar_items"].join(model.products.select("product_id", "name"), "product_id", "left")),
        "display_suppliers": display.suppliers_table(worst),
        "display_forecast": display.forecast_table(m["forecast"]),
        "display_returns": display.returns_table(m["returns_by_reason"]),
    }
    paths |= version.write(tables)
    version.commit()
    return paths
