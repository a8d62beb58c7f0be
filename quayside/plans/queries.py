"""Registered report queries over the test star schema.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the SQL oracle of the same name (``quayside.plans.oracle``).
Every query reads whole tables; limits appear only where the feature is a
top-k report.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import add_months, month_floor, not_after
from ..functions.money import to_money
from ..functions.text import has_alnum, normalize_text
from ..operators import calendar, channels, forecast, loyalty, profile, quality, returns, similarity, suppliers
from ..sources import csv_ingest, infer
from ..sources.tables import TABLES, read_table, table_path
from ..streaming import incremental
from . import display, marts, publish
from . import params as P
from .model import order_lines, sales_lines, star_model
from .output import as_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- M1 / M2: loyal customers ------------------------------------------------

def _loyal_top(spark, sf_dir):
    model = star_model(spark, sf_dir)
    metrics = loyalty.customer_metrics(model.orders)
    diversity = loyalty.category_diversity(sales_lines(model))
    return loyalty.loyal_customers(metrics, diversity, P.MIN_CATEGORIES, P.TOP_CUSTOMERS)


@register("customer_metrics")
def q_customer_metrics(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return as_output(loyalty.customer_metrics(model.orders))


@register("category_diversity")
def q_category_diversity(spark, sf_dir):
    return loyalty.category_diversity(sales_lines(star_model(spark, sf_dir)))


@register("category_diversity_by_period")
def q_category_diversity_by_period(spark, sf_dir):
    """E3: distinct categories of every customer by month, by year and over all, from one set of mergeable words."""
    model = star_model(spark, sf_dir)
    numbers = loyalty.numbered_categories(model.products)
    monthly = marts.materialize(loyalty.category_sets(sales_lines(model), numbers, F.date_format("created_at", "yyyy-MM")), "category-sets")
    yearly = loyalty.rolled_up(monthly, F.substring("period", 1, 4))
    frames = [loyalty.set_sizes(s) for s in (monthly, yearly, loyalty.rolled_up(yearly, F.lit("all")))]
    return reduce(DataFrame.unionByName, frames)


@register("loyal_customers_top10")
def q_loyal_customers_top10(spark, sf_dir):
    return as_output(_loyal_top(spark, sf_dir).select(
        "customer_id", "revenue", "frequency", "avg_ticket", "category_diversity"))


@register("loyal_top_category")
def q_loyal_top_category(spark, sf_dir):
    model = star_model(spark, sf_dir)
    top = _loyal_top(spark, sf_dir)
    return loyalty.leading_category(sales_lines(model), top)


# --- M3: weekday calendar ----------------------------------------------------

def _pos_calendar(spark, sf_dir):
    orders = star_model(spark, sf_dir).orders
    return calendar.sales_calendar(orders, P.CUTOFF_DAY, where=F.col("channel") == P.POS_CHANNEL)


@register("weekday_sales_calendar")
def q_weekday_sales_calendar(spark, sf_dir):
    prof = calendar.weekday_profile(_pos_calendar(spark, sf_dir))
    return as_output(prof.withColumn("weekday_number", F.col("weekday_number").cast("bigint")))


@register("weekday_sales_biased")
def q_weekday_sales_biased(spark, sf_dir):
    cal = _pos_calendar(spark, sf_dir)
    dense = calendar.weekday_profile(cal)
    orders = star_model(spark, sf_dir).orders
    cond = (F.col("channel") == P.POS_CHANNEL) & not_after(F.col("created_at"), P.CUTOFF_DAY)
    sparse = calendar.weekday_profile_sale_days(calendar.daily_totals(orders, where=cond))
    out = dense.join(sparse, "weekday_number", "left").select(
        F.col("weekday_number").cast("bigint").alias("weekday_number"), "avg_sale", "days",
        "avg_sale_sale_days", F.coalesce("sale_days", F.lit(0)).cast("bigint").alias("sale_days"))
    return as_output(out)


@register("calendar_zero_days")
def q_calendar_zero_days(spark, sf_dir):
    return calendar.calendar_stats(_pos_calendar(spark, sf_dir))


# --- M6: channels --------------------------------------------------------------

CHANNEL_COLUMNS = {ch: "ch_" + "".join(c if c.isalnum() else "_" for c in ch.lower()) for ch in P.CHANNELS}


def _business(spark, sf_dir):
    return channels.business_orders(star_model(spark, sf_dir).orders, P.BUSINESS_STATUSES, P.CUTOFF_DAY)


@register("channel_monthly")
def q_channel_monthly(spark, sf_dir):
    return as_output(channels.channel_monthly(_business(spark, sf_dir)))


@register("channel_summary")
def q_channel_summary(spark, sf_dir):
    return as_output(channels.channel_summary(_business(spark, sf_dir)))


@register("channel_yearly_pivot")
def q_channel_yearly_pivot(spark, sf_dir):
    monthly = channels.channel_monthly(_business(spark, sf_dir))
    piv = channels.channel_yearly_pivot(monthly, P.CHANNELS, names=CHANNEL_COLUMNS)
    return as_output(piv.withColumn("year", F.col("year").cast("bigint")))


# --- M7: returns -----------------------------------------------------------------

@register("return_reasons")
def q_return_reasons(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return as_output(returns.returns_by_reason(model.returns, P.CUTOFF_DAY, model.return_completed))


# --- M8: suppliers ---------------------------------------------------------------

def _completed_pos(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return model, suppliers.completed_orders_of(model, P.CUTOFF_DAY)


@register("supplier_punctuality")
def q_supplier_punctuality(spark, sf_dir):
    model, done = _completed_pos(spark, sf_dir)
    return suppliers.worst_suppliers(suppliers.supplier_scores(done, model.suppliers), P.WORST_SUPPLIERS)


@register("supplier_overall")
def q_supplier_overall(spark, sf_dir):
    _, done = _completed_pos(spark, sf_dir)
    return suppliers.supplier_overall(done)


# --- M4: demand forecast (all products at once) ------------------------------------

def _test_window():
    end = month_floor(P.FORECAST_TRAIN_END)
    return add_months(end, P.FORECAST_TEST_MONTHS), add_months(end, P.FORECAST_TEST_MONTHS + 1)


def _dense_demand(spark, sf_dir):
    last_month, before = _test_window()
    lines = sales_lines(star_model(spark, sf_dir)).withColumnRenamed("name", "product_name")
    monthly = forecast.monthly_demand(lines, key="product_name", before=before)
    return forecast.dense_months(monthly, last_month, key="product_name")


def _walk(spark, sf_dir):
    return forecast.walk_forward(_dense_demand(spark, sf_dir), P.FORECAST_TRAIN_END, P.FORECAST_TEST_MONTHS,
                                 key="product_name", window=P.FORECAST_WINDOW, min_periods=1)


def _fixed(spark, sf_dir):
    return forecast.fixed_origin(_dense_demand(spark, sf_dir), P.FORECAST_TRAIN_END, P.FORECAST_TEST_MONTHS,
                                 key="product_name", window=P.FORECAST_WINDOW)


@register("monthly_demand_dense")
def q_monthly_demand_dense(spark, sf_dir):
    return _dense_demand(spark, sf_dir)


@register("walk_forward_forecast")
def q_walk_forward_forecast(spark, sf_dir):
    return _walk(spark, sf_dir)


@register("demand_forecast_product")
def q_demand_forecast_product(spark, sf_dir):
    """The single-name view: every part id carrying the name is summed."""
    similarity.require_product(star_model(spark, sf_dir).products, P.FORECAST_PRODUCT)   # missing target raises
    return _walk(spark, sf_dir).where(F.col("product_name") == P.FORECAST_PRODUCT)


@register("rolling_strict_forecast")
def q_rolling_strict_forecast(spark, sf_dir):
    fc = forecast.trailing_mean(_dense_demand(spark, sf_dir), "product_name", P.FORECAST_WINDOW,
                                min_periods=P.FORECAST_WINDOW)
    return fc.select("product_name", "month", F.col("quantity").alias("actual"), "forecast")


@register("fixed_origin_forecast")
def q_fixed_origin_forecast(spark, sf_dir):
    return _fixed(spark, sf_dir)


@register("forecast_metrics")
def q_forecast_metrics(spark, sf_dir):
    frame = forecast.forecast_frame(_dense_demand(spark, sf_dir), P.FORECAST_TRAIN_END, P.FORECAST_TEST_MONTHS,
                                    key="product_name", window=P.FORECAST_WINDOW)
    return forecast.forecast_metrics(frame, key="product_name")


@register("shipped_before_order")
def q_shipped_before_order(spark, sf_dir):
    """Lines whose shipment precedes their order (a date-order audit over all lines)."""
    lines = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("n_before"),
                     F.min(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))).cast("bigint").alias("smallest_gap_days"))


@register("products_sold_before_registration")
def q_products_sold_before_registration(spark, sf_dir):
    """J10: products first ordered before their first shipment, which stands for the registration date."""
    model = star_model(spark, sf_dir)
    span = forecast.sale_span(sales_lines(model).withColumnRenamed("name", "product_name"), key="product_name")
    registry = (_t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
                .groupBy(F.col("p_name").alias("product_name")).agg(F.min("l_shipdate").alias("created_at")))
    return forecast.sold_before_registration(span, registry, key="product_name").select("product_name", "first_sale", "registered_on")


@register("ordered_list_check")
def q_ordered_list_check(spark, sf_dir):
    """H3: the loyal top list, row by row in order, from the DataFrame operators and from SQL."""
    top = _loyal_top(spark, sf_dir)
    position = F.row_number().over(Window.orderBy(F.col("avg_ticket").desc(), F.col("customer_id").asc()))   # at most 10 rows
    api = top.select("customer_id", "frequency", "category_diversity", position.alias("position"))
    model = star_model(spark, sf_dir)
    by_sql = spark.sql(
        "SELECT customer_id, frequency, category_diversity, CAST(row_number() OVER (ORDER BY avg_ticket DESC, customer_id) AS INT) AS position FROM ("
        " SELECT m.customer_id, m.frequency, d.category_diversity, round(m.revenue / m.frequency, 2) AS avg_ticket"
        " FROM (SELECT customer_id, sum(total) AS revenue, count(id) AS frequency FROM {orders} GROUP BY customer_id) m"
        " JOIN (SELECT o.customer_id, count(DISTINCT p.category) AS category_diversity FROM {items} i"
        "       JOIN {orders} o ON o.id = i.order_id JOIN {products} p ON p.product_id = i.variant_id GROUP BY o.customer_id) d"
        " ON d.customer_id = m.customer_id WHERE d.category_diversity >= {least}"
        " ORDER BY avg_ticket DESC, customer_id LIMIT {k})",
        orders=model.orders, items=model.order_items, products=model.products, least=P.MIN_CATEGORIES, k=P.TOP_CUSTOMERS)
    return quality.same_ordered_list(api, by_sql, "position", "loyal_customers_api_vs_sql")


@register("product_sale_span")
def q_product_sale_span(spark, sf_dir):
    lines = sales_lines(star_model(spark, sf_dir)).withColumnRenamed("name", "product_name")
    return forecast.sale_span(lines, key="product_name")


# --- M5: co-purchase similarity -----------------------------------------------------

def _interactions(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return model, marts.materialize(similarity.interactions(order_lines(model)), "interactions")


@register("item_similarity_topk")
def q_item_similarity_topk(spark, sf_dir):
    model, inter = _interactions(spark, sf_dir)
    similarity.require_product(model.products, P.REFERENCE_PRODUCT)                     # missing target raises
    ref = similarity.first_id_by_name(model.products, P.REFERENCE_PRODUCT)
    top = similarity.similar_items(inter, ref, P.SIMILAR_TOP_N)
    names = model.products.select("product_id", "name")
    # top holds at most SIMILAR_TOP_N rows, so it is the broadcast (build) side and the
    # products table streams past it; inner is exact here because every candidate came
    # from interactions already joined to products
    return (names.join(F.broadcast(top), "product_id")
            .select("product_id", "name", "overlap", "buyers", "similarity"))


@register("item_similarity_references")
def q_item_similarity_references(spark, sf_dir):
    model, inter = _interactions(spark, sf_dir)
    refs = (model.products.where(F.col("name").isin(list(P.REFERENCE_SET)))
            .groupBy("name").agg(F.min("product_id").alias("product_id")))
    return similarity.similarity_to_references(inter, refs)


@register("interaction_shape")
def q_interaction_shape(spark, sf_dir):
    _, inter = _interactions(spark, sf_dir)
    return similarity.matrix_shape(inter)


# --- M11 / L: profiling and data quality ---------------------------------------------

def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


STATUS_COLUMNS = {"F": "st_f", "O": "st_o", "P": "st_p"}

# (child table, child key, parent table, parent key) pairs of the star schema
FOREIGN_KEYS = (("lineitem", "l_orderkey", "orders", "o_orderkey"),
                ("lineitem", "l_partkey", "part", "p_partkey"),
                ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
                ("orders", "o_custkey", "customer", "c_custkey"),
                ("customer", "c_nationkey", "nation", "n_nationkey"),
                ("supplier", "s_nationkey", "nation", "n_nationkey"),
                ("nation", "n_regionkey", "region", "r_regionkey"),
                ("labels", "doc_id", "documents", "doc_id"))

UNIQUE_KEYS = (("orders", ("o_orderkey",)), ("lineitem", ("l_orderkey", "l_linenumber")),
               ("customer", ("c_custkey",)), ("part", ("p_partkey",)), ("supplier", ("s_suppkey",)),
               ("documents", ("doc_id",)), ("conversations", ("conv_id", "turn")))


def _union_all(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@register("eda_orders_profile")
def q_eda_orders_profile(spark, sf_dir):
    return as_output(profile.summary_row(_t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"))


@register("eda_null_counts")
def q_eda_null_counts(spark, sf_dir):
    return _union_all([profile.null_counts(_t(spark, sf_dir, n), n) for n in ("orders", "lineitem")])


@register("eda_value_counts")
def q_eda_value_counts(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return _union_all([profile.value_counts(orders, c).select(F.lit(c).alias("column_name"), "value", "n")
                       for c in ("o_orderstatus", "o_orderpriority")])


@register("eda_crosstab")
def q_eda_crosstab(spark, sf_dir):
    return profile.crosstab(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus",
                            list(STATUS_COLUMNS), STATUS_COLUMNS)


@register("eda_null_crosstab")
def q_eda_null_crosstab(spark, sf_dir):
    """Documents per language x whether a quality label exists (left join leaves nulls)."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = _t(spark, sf_dir, "labels").select("doc_id", "quality")
    return profile.null_crosstab(docs.join(labels, "doc_id", "left"), "lang", "quality")


@register("eda_describe")
def q_eda_describe(spark, sf_dir):
    return profile.describe(_t(spark, sf_dir, "orders"), "o_totalprice")


@register("eda_iqr_outliers")
def q_eda_iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(_t(spark, sf_dir, "orders"), "o_totalprice", P.IQR_FACTORS)


@register("duplicate_keys")
def q_duplicate_keys(spark, sf_dir):
    return _union_all([quality.duplicate_keys(_t(spark, sf_dir, t), keys, t) for t, keys in UNIQUE_KEYS])


@register("orphans")
def q_orphans(spark, sf_dir):
    names = {t for c, _, p, _ in FOREIGN_KEYS for t in (c, p)}
    return quality.all_orphans({n: _t(spark, sf_dir, n) for n in names}, FOREIGN_KEYS)


@register("orders_version_differences")
def q_orders_version_differences(spark, sf_dir):
    """Two versions of orders, the second with removed, added and changed rows: every difference, located by bucket digests."""
    orders = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    later = orders.where(k % 9973 != 11).withColumns({
        "o_totalprice": F.when(k % 4999 == 3, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderstatus": F.when(k % 7001 == 5, F.lit("X")).otherwise(F.col("o_orderstatus")),
        "o_orderpriority": F.when(k % 4999 == 3, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))})
    added = orders.where(k % 9973 == 17).withColumn("o_orderkey", -k)
    return quality.located_differences(orders, later.unionByName(added), "o_orderkey")


@register("identity_check")
def q_identity_check(spark, sf_dir):
    """Order total = sum over its lines of price - discount + tax, within 0.01."""
    li = _t(spark, sf_dir, "lineitem")
    ext = to_money("l_extendedprice")
    disc = F.col("l_discount").cast("decimal(4,2)")
    tax = F.col("l_tax").cast("decimal(4,2)")
    per_order = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(ext).alias("subtotal"), F.sum(ext * disc).alias("discount"),
        F.sum(ext * (1 - disc) * tax).alias("tax"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    joined = orders.join(per_order, "o_orderkey")
    return as_output(quality.identity_mismatches(
        joined, [("subtotal", 1), ("discount", -1), ("tax", 1)], "o_totalprice", label="order_total"))


@register("multi_table_counts")
def q_multi_table_counts(spark, sf_dir):
    counts = profile.table_counts({n: _t(spark, sf_dir, n) for n in TABLES})
    total = counts.agg(F.lit("*").alias("table_name"), F.sum("n_rows").alias("n_rows"),
                       F.sum("n_columns").alias("n_columns"))
    return counts.unionByName(total)


@register("reconcile_paths")
def q_reconcile_paths(spark, sf_dir):
    """Two-path checks: DataFrame operators vs the same metrics written as SQL text."""
    orders = _t(spark, sf_dir, "orders")
    api = loyalty.customer_metrics(star_model(spark, sf_dir).orders)
    sql = spark.sql(
        "SELECT o_custkey AS customer_id,"
        " ROUND(SUM(CAST(o_totalprice AS DECIMAL(18,2))) / COUNT(o_orderkey), 2) AS avg_ticket"
        " FROM {orders} GROUP BY o_custkey", orders=orders)
    tickets = quality.reconcile(api, sql, "customer_id", "avg_ticket", "avg_ticket_api_vs_sql")
    weekday_api = calendar.weekday_profile(_pos_calendar(spark, sf_dir))
    weekday_sql = spark.sql(
        "WITH cal AS (SELECT explode(sequence((SELECT min(to_date(o_orderdate)) FROM {orders}),"
        "                                     DATE '" + P.CUTOFF_DAY + "', INTERVAL 1 DAY)) AS d),"
        " pos AS (SELECT to_date(o_orderdate) AS d, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM {orders}"
        "         WHERE o_orderpriority = '" + P.POS_CHANNEL + "' AND to_date(o_orderdate) <= DATE '" + P.CUTOFF_DAY + "'"
        "         GROUP BY to_date(o_orderdate))"
        " SELECT weekday(cal.d) AS weekday_number, ROUND(SUM(coalesce(pos.s, 0)) / COUNT(*), 2) AS avg_sale"
        " FROM cal LEFT JOIN pos ON pos.d = cal.d GROUP BY weekday(cal.d)", orders=orders)
    weekdays = quality.reconcile(weekday_api, weekday_sql, "weekday_number", "avg_sale", "weekday_mean_api_vs_sql")
    return as_output(tickets.unionByName(weekdays))


@register("distinct_status_values")
def q_distinct_status_values(spark, sf_dir):
    return profile.distinct_values(_t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@register("status_conditional_sums")
def q_status_conditional_sums(spark, sf_dir):
    lines = order_lines(star_model(spark, sf_dir))
    groups = {"business_qty": F.col("status").isin(list(P.BUSINESS_STATUSES)),
              "pending_qty": F.col("status") == "P"}
    return profile.conditional_sums(lines, "channel", "quantity", groups)


@register("future_rows")
def q_future_rows(spark, sf_dir):
    return profile.rows_after_cutoff(star_model(spark, sf_dir).orders, "created_at", P.CUTOFF_DAY)


# --- B / A11: schema inference catalogue ------------------------------------------------

@register("infer_schema")
def q_infer_schema(spark, sf_dir):
    """Type ladder over every column of every table, read as text."""
    cat = infer.infer_catalogue_many({n: _t(spark, sf_dir, n) for n in TABLES})
    return cat.drop("spark_type").withColumn("position", F.col("position").cast("bigint"))


# --- A: CSV ingest round trip (export -> discover -> count -> infer -> typed load) ----------

@register("raw_record_counts")
def q_raw_record_counts(spark, sf_dir):
    """A4/A8: all tables written as raw CSV files; their records counted in the files, quoted newlines and all."""
    return csv_ingest.raw_record_counts(spark, {n: _t(spark, sf_dir, n) for n in TABLES})


LOAD_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register("csv_roundtrip_load")
def q_csv_roundtrip_load(spark, sf_dir):
    """Load validation: raw CSV record counts vs rows in the typed Parquet load."""
    return csv_ingest.roundtrip_validation(spark, {n: _t(spark, sf_dir, n) for n in LOAD_TABLES})


# every table but embeddings, whose arrays CSV does not hold
CONTENT_TABLES = tuple(t for t in TABLES if t != "embeddings")


@register("csv_typed_content")
def q_csv_typed_content(spark, sf_dir):
    """Every value after export (columns in reverse order), inference and typed load, as a content hash per table."""
    tables = {n: _t(spark, sf_dir, n) for n in CONTENT_TABLES}
    _, typed = csv_ingest.roundtrip(spark, {n: df.select(*reversed(df.columns)) for n, df in tables.items()})
    parts = [quality.content_hash(typed[n].select(df.columns), fractions=[c for c, t in df.dtypes if t in ("double", "float")])
             .select(F.lit(n).alias("table_name"), "n_rows", "hash_sum") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


# --- M9 / M10 / L6 / L8: KPI row, display tables, expectations, fingerprints --------------

@register("kpi_row")
def q_kpi_row(spark, sf_dir):
    return marts.kpi_row(spark, star_model(spark, sf_dir))


@register("expectations_report")
def q_expectations_report(spark, sf_dir):
    return marts.expectations_report(spark, star_model(spark, sf_dir))


@register("expectations_snapshot")
def q_expectations_snapshot(spark, sf_dir):
    """L6: the figures that the report's writes observe, against a table of expectations; two of them are meant to fail."""
    model = star_model(spark, sf_dir)
    version = publish.Version(spark, csv_ingest.scratch_dir(spark, "report"))
    version.write(marts.build_marts(model))
    wrong = spark.createDataFrame([("listed_customers", "one customer too many", float(P.TOP_CUSTOMERS + 1)), ("unknown_figure", "a figure that no mart has", 0.0)],
                                  "check_name string, label string, expected double")
    return version.checked(marts.snapshot_expectations(spark, model).unionByName(wrong))


@register("published_report")
def q_published_report(spark, sf_dir):
    """A12/L9: all marts through the gate, written as one version, and read back by its manifest: their content hashes."""
    out_dir = csv_ingest.scratch_dir(spark, "report")
    version = publish.publish_report(spark, marts.build_marts(star_model(spark, sf_dir)), out_dir)
    prints = marts.mart_fingerprints(publish.read_report(spark, out_dir))
    return prints.select(F.lit(version).cast("bigint").alias("version"), "*")


@register("display_channels_ptbr")
def q_display_channels_ptbr(spark, sf_dir):
    return display.channels_table(channels.channel_summary(_business(spark, sf_dir)))


@register("display_suppliers_ptbr")
def q_display_suppliers_ptbr(spark, sf_dir):
    model, done = _completed_pos(spark, sf_dir)
    worst = suppliers.worst_suppliers(suppliers.supplier_scores(done, model.suppliers), P.WORST_SUPPLIERS)
    return display.suppliers_table(worst)


@register("display_channels_yearly_ptbr")
def q_display_channels_yearly_ptbr(spark, sf_dir):
    return display.channels_yearly_table(QUERIES["channel_yearly_pivot"](spark, sf_dir))


@register("display_customers_ptbr")
def q_display_customers_ptbr(spark, sf_dir):
    return display.customers_table(QUERIES["loyal_customers_top10"](spark, sf_dir))


@register("display_weekday_ptbr")
def q_display_weekday_ptbr(spark, sf_dir):
    return display.weekday_table(QUERIES["weekday_sales_calendar"](spark, sf_dir))


@register("display_recommendations_ptbr")
def q_display_recommendations_ptbr(spark, sf_dir):
    return display.recommendations_table(QUERIES["item_similarity_topk"](spark, sf_dir))


@register("display_forecast_ptbr")
def q_display_forecast_ptbr(spark, sf_dir):
    return display.forecast_table(_walk(spark, sf_dir).where(F.col("product_name") == P.FORECAST_PRODUCT))


@register("display_returns_ptbr")
def q_display_returns_ptbr(spark, sf_dir):
    model = star_model(spark, sf_dir)
    return display.returns_table(returns.returns_by_reason(model.returns, P.CUTOFF_DAY, model.return_completed))


@register("mart_fingerprints")
def q_mart_fingerprints(spark, sf_dir):
    """Order-insensitive content hash per mart (determinism check)."""
    return as_output(marts.mart_fingerprints(marts.build_marts(star_model(spark, sf_dir))))


@register("normalized_documents")
def q_normalized_documents(spark, sf_dir):
    """I1 on table text: length and md5 of every document's normal form."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", normalize_text("text").alias("t"))
    return docs.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(F.encode("t", "UTF-8")).alias("md5"),
                       has_alnum(F.col("t")).alias("has_alnum"))


# --- streaming: incremental daily sales per channel ------------------------------------------

def _streamed_partials(spark, sf_dir) -> str:
    """Run the incremental job over the orders file (availableNow); returns the partials folder."""
    base = csv_ingest.scratch_dir(spark, "stream-daily")
    schema = _t(spark, sf_dir, "orders").schema
    stream = incremental.order_stream(spark, table_path(sf_dir, "orders"), schema).select(
        F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("channel"),
        F.col("o_totalprice").alias("total"))
    incremental.daily_partials_stream(stream, f"{base}/partials", f"{base}/checkpoint").awaitTermination()
    return f"{base}/partials"


@register("streaming_daily_channel_sales")
def q_streaming_daily_channel_sales(spark, sf_dir):
    """Orders file consumed as a stream (availableNow), partials re-aggregated per day and channel."""
    return as_output(incremental.daily_totals(spark, _streamed_partials(spark, sf_dir)))


@register("streaming_monthly_channel_sales")
def q_streaming_monthly_channel_sales(spark, sf_dir):
    """Month x channel roll-up of the incremental daily partials."""
    daily = incremental.daily_totals(spark, _streamed_partials(spark, sf_dir))
    return as_output(incremental.monthly_from_daily(daily))


# --- G6 / L1: last periods of each series, long-form table profile -------------------------

@register("demand_last_12_months")
def q_demand_last_12_months(spark, sf_dir):
    return forecast.last_periods(_dense_demand(spark, sf_dir), 12, key="product_name")


@register("eda_profile_report")
def q_eda_profile_report(spark, sf_dir):
    return profile.profile_report(_t(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderkey",
                                  ["o_orderstatus", "o_orderpriority"], P.CUTOFF_DAY)


@register("events_after_cutoff")
def q_events_after_cutoff(spark, sf_dir):
    """The cutoff rule on microsecond timestamps: rows after the end of the cutoff day."""
    return profile.rows_after_cutoff(_t(spark, sf_dir, "events"), "ts", P.EVENTS_CUTOFF_DAY)
