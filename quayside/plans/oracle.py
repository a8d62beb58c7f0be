"""Independent DuckDB SQL for every registered query.

Written directly against the raw test tables (views ``orders``,
``lineitem``, ...), not derived from the Spark code. Money is summed as
DECIMAL(18,2) and half-up averages are computed in integer cents, so both
engines produce the same exact values before the final cast to DOUBLE.
"""

from __future__ import annotations

from . import params as P
from .model import PROMISE_DAYS


def half_up(total: str, n: str, scale: int = 2) -> str:
    """DuckDB: round(total / n, scale) half away from zero, exactly, as DOUBLE."""
    units = f"CAST(({total}) * {10 ** scale} AS HUGEINT)"
    q = f"((2 * abs({units}) + ({n})) // (2 * ({n})))"
    return (f"(CASE WHEN ({n}) > 0 THEN CAST(CASE WHEN {units} < 0 THEN -{q} ELSE {q} END AS DOUBLE)"
            f" / {10 ** scale} END)")


def lit(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


MONEY = "DECIMAL(18,2)"

# Reusable CTE bodies --------------------------------------------------------

CUSTOMER_METRICS = f"""
  SELECT o_custkey AS customer_id,
         sum(CAST(o_totalprice AS {MONEY})) AS revenue,
         count(o_orderkey) AS frequency
  FROM orders GROUP BY o_custkey"""

CATEGORY_DIVERSITY = """
  SELECT o.o_custkey AS customer_id, count(DISTINCT p.p_brand) AS category_diversity
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey
  GROUP BY o.o_custkey"""

LOYAL_TOP = f"""
  SELECT m.customer_id, CAST(m.revenue AS DOUBLE) AS revenue, m.frequency,
         {half_up('m.revenue', 'm.frequency')} AS avg_ticket, d.category_diversity
  FROM ({CUSTOMER_METRICS}) m JOIN ({CATEGORY_DIVERSITY}) d USING (customer_id)
  WHERE d.category_diversity >= {P.MIN_CATEGORIES}
  ORDER BY avg_ticket DESC, m.customer_id ASC
  LIMIT {P.TOP_CUSTOMERS}"""

ORACLE: dict[str, str] = {}

ORACLE["customer_metrics"] = f"""
SELECT customer_id, CAST(revenue AS DOUBLE) AS revenue, frequency,
       {half_up('revenue', 'frequency')} AS avg_ticket
FROM ({CUSTOMER_METRICS}) m"""

ORACLE["category_diversity"] = CATEGORY_DIVERSITY

_BREADTH = """
SELECT o.o_custkey AS customer_id, {period} AS period, count(DISTINCT p.p_brand) AS category_diversity
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1, 2"""
ORACLE["category_diversity_by_period"] = "\nUNION ALL\n".join(
    _BREADTH.format(period=p) for p in ("strftime(o.o_orderdate, '%Y-%m')", "strftime(o.o_orderdate, '%Y')", "'all'"))

ORACLE["loyal_customers_top10"] = LOYAL_TOP

ORACLE["loyal_top_category"] = f"""
SELECT p.p_brand AS category, sum(l.l_quantity) AS total_items
FROM lineitem l
JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN part p ON p.p_partkey = l.l_partkey
WHERE o.o_custkey IN (SELECT customer_id FROM ({LOYAL_TOP}) t)
GROUP BY p.p_brand
ORDER BY total_items DESC, category ASC
LIMIT 1"""

# --- calendar ---------------------------------------------------------------

NEXT_DAY = f"(DATE '{P.CUTOFF_DAY}' + INTERVAL 1 DAY)"   # exclusive timestamp bound
WEEKDAY_NAME = ("CASE weekday_number WHEN 0 THEN 'Segunda-feira' WHEN 1 THEN 'Terça-feira' "
                "WHEN 2 THEN 'Quarta-feira' WHEN 3 THEN 'Quinta-feira' WHEN 4 THEN 'Sexta-feira' "
                "WHEN 5 THEN 'Sábado' WHEN 6 THEN 'Domingo' END")

POS_DAILY = f"""
  SELECT CAST(o_orderdate AS DATE) AS date, sum(CAST(o_totalprice AS {MONEY})) AS sales
  FROM orders
  WHERE o_orderpriority = '{P.POS_CHANNEL}' AND CAST(o_orderdate AS DATE) <= DATE '{P.CUTOFF_DAY}'
  GROUP BY 1"""

POS_CALENDAR = f"""
  SELECT s.date, coalesce(d.sales, 0) AS sales, isodow(s.date) - 1 AS weekday_number
  FROM (SELECT CAST(unnest(generate_series(CAST(min(o_orderdate) AS DATE), DATE '{P.CUTOFF_DAY}',
                                           INTERVAL 1 DAY)) AS DATE) AS date FROM orders) s
  LEFT JOIN ({POS_DAILY}) d ON d.date = s.date"""

WEEKDAY_PROFILE = f"""
  SELECT CAST(weekday_number AS BIGINT) AS weekday_number, {WEEKDAY_NAME} AS weekday_name,
         {half_up('sum(sales)', 'count(*)')} AS avg_sale, count(*) AS days
  FROM ({POS_CALENDAR}) c GROUP BY weekday_number"""

ORACLE["weekday_sales_calendar"] = WEEKDAY_PROFILE

ORACLE["weekday_sales_biased"] = f"""
SELECT w.weekday_number, w.avg_sale, w.days, s.avg_sale_sale_days,
       CAST(coalesce(s.sale_days, 0) AS BIGINT) AS sale_days
FROM ({WEEKDAY_PROFILE}) w
LEFT JOIN (SELECT CAST(isodow(date) - 1 AS BIGINT) AS weekday_number,
                  {half_up('sum(sales)', 'count(*)')} AS avg_sale_sale_days, count(*) AS sale_days
           FROM ({POS_DAILY}) d GROUP BY 1) s USING (weekday_number)"""

ORACLE["calendar_zero_days"] = f"""
SELECT count(*) AS calendar_days, count(*) FILTER (WHERE sales = 0) AS zero_sales_days,
       min(date) AS first_day, max(date) AS last_day
FROM ({POS_CALENDAR}) c"""

# --- channels -----------------------------------------------------------------

BUSINESS = f"""
  SELECT o_orderkey, o_orderpriority AS channel, CAST(o_totalprice AS {MONEY}) AS total, o_orderdate
  FROM orders
  WHERE o_orderstatus IN ({lit(P.BUSINESS_STATUSES)}) AND o_orderdate < {NEXT_DAY}"""

CHANNEL_MONTHLY = f"""
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, channel,
         sum(total) AS revenue, count(*) AS orders
  FROM ({BUSINESS}) b GROUP BY 1, 2"""

ORACLE["channel_monthly"] = f"""
SELECT month, channel, CAST(revenue AS DOUBLE) AS revenue, orders FROM ({CHANNEL_MONTHLY}) m"""

ORACLE["channel_summary"] = f"""
SELECT channel, CAST(revenue AS DOUBLE) AS revenue, orders,
       {half_up('revenue', 'orders')} AS avg_ticket,
       CAST(revenue AS DOUBLE) / (SELECT CAST(sum(total) AS DOUBLE) FROM ({BUSINESS}) b2) AS share
FROM (SELECT channel, sum(total) AS revenue, count(*) AS orders FROM ({BUSINESS}) b GROUP BY channel) s"""


def _channel_col(ch: str) -> str:
    return "ch_" + "".join(c if c.isalnum() else "_" for c in ch.lower())


ORACLE["channel_yearly_pivot"] = f"""
SELECT CAST(year(month) AS BIGINT) AS year,
       {", ".join(f"CAST(coalesce(sum(revenue) FILTER (WHERE channel = '{ch}'), 0) AS DOUBLE) AS {_channel_col(ch)}"
                  for ch in P.CHANNELS)}
FROM ({CHANNEL_MONTHLY}) m GROUP BY 1"""

# --- returns ------------------------------------------------------------------

# which spelling of the map a line's keys give, by place in the map, and what it must be cleaned to
_REASON = """CASE WHEN k < 2 THEN 'Cliente desistiu da compra' WHEN k < 3 THEN 'Compra duplicada'
            WHEN k < 6 THEN 'Produto avariado no transporte' WHEN k < 10 THEN 'Tamanho/cor incorretos'
            WHEN k < 13 THEN 'Produto com defeito de fábrica' WHEN k < 16 THEN 'Item não corresponde à descrição'
            WHEN k < 17 THEN 'Outros' ELSE 'Não informado' END"""

ORACLE["return_reasons"] = f"""
SELECT {_REASON} AS reason, count(*) AS returns, CAST(sum(refund) AS DOUBLE) AS refund
FROM (SELECT (l_partkey + l_linenumber) % 20 AS k, CAST(l_extendedprice AS {MONEY}) AS refund FROM lineitem
      WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_shipdate < {NEXT_DAY}) r
GROUP BY 1"""

# --- suppliers ------------------------------------------------------------------

COMPLETED_POS = f"""
  WITH po AS (
    SELECT l_orderkey AS order_key, l_suppkey AS supplier_id,
           CASE WHEN bool_and(l_linestatus = 'F') THEN 'received' ELSE 'open' END AS status
    FROM lineitem GROUP BY 1, 2),
  elig AS (
    SELECT po.order_key, po.supplier_id, CAST(o.o_orderdate AS DATE) + INTERVAL {PROMISE_DAYS} DAY AS expected
    FROM po JOIN orders o ON o.o_orderkey = po.order_key
    WHERE po.status = 'received' AND o.o_orderdate < {NEXT_DAY}),
  rec AS (
    SELECT l_orderkey AS order_key, l_suppkey AS supplier_id, max(l_shipdate) AS completed_at
    FROM lineitem WHERE l_shipdate < {NEXT_DAY} GROUP BY 1, 2)
  SELECT e.order_key, e.supplier_id,
         date_diff('day', CAST(e.expected AS DATE), CAST(r.completed_at AS DATE)) AS delay_days
  FROM elig e JOIN rec r USING (order_key, supplier_id)
  WHERE e.expected IS NOT NULL"""

SUPPLIER_SCORES = f"""
  SELECT c.supplier_id, printf('F%02d · %s', c.supplier_id, CASE WHEN c.supplier_id % 4 = 0 THEN s.s_name || ' & Co' ELSE coalesce(trim(s.s_name), '') END) AS label,
         count(*) AS orders,
         avg(CASE WHEN delay_days <= 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS on_time_rate,
         coalesce(avg(delay_days) FILTER (WHERE delay_days > 0), 0.0)::DOUBLE AS avg_late_days
  FROM ({COMPLETED_POS}) c LEFT JOIN supplier s ON s.s_suppkey = c.supplier_id
  GROUP BY c.supplier_id, s.s_name"""

ORACLE["supplier_punctuality"] = f"""
SELECT * FROM ({SUPPLIER_SCORES}) x
ORDER BY on_time_rate ASC, orders DESC, supplier_id ASC LIMIT {P.WORST_SUPPLIERS}"""

ORACLE["supplier_overall"] = f"""
SELECT count(*) AS completed_orders, count(*) FILTER (WHERE delay_days > 0) AS late_orders,
       avg(CASE WHEN delay_days <= 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) AS on_time_rate,
       coalesce(avg(delay_days) FILTER (WHERE delay_days > 0), 0.0)::DOUBLE AS avg_late_days
FROM ({COMPLETED_POS}) c"""

# --- forecast -------------------------------------------------------------------

def _months_after(month: str, n: int) -> str:
    y, m = int(month[:4]), int(month[5:7])
    k = y * 12 + m - 1 + n
    return f"{k // 12:04d}-{k % 12 + 1:02d}-01"


TEST_FIRST = _months_after(P.FORECAST_TRAIN_END, 1)
TEST_LAST = _months_after(P.FORECAST_TRAIN_END, P.FORECAST_TEST_MONTHS)
TEST_BEFORE = _months_after(P.FORECAST_TRAIN_END, P.FORECAST_TEST_MONTHS + 1)
TRAIN_TAIL_FROM = _months_after(P.FORECAST_TRAIN_END, 1 - P.FORECAST_WINDOW)

SALES_LINES = """
  SELECT o.o_custkey AS customer_id, o.o_orderdate AS created_at, l.l_partkey AS product_id,
         p.p_name AS product_name, l.l_quantity AS quantity
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN part p ON p.p_partkey = l.l_partkey"""

DENSE = f"""
  WITH monthly AS (
    SELECT product_name, CAST(date_trunc('month', created_at) AS DATE) AS month,
           sum(quantity) AS quantity
    FROM ({SALES_LINES}) s WHERE created_at < TIMESTAMP '{TEST_BEFORE}' GROUP BY 1, 2),
  spine AS (
    SELECT product_name,
           CAST(unnest(generate_series(min(month), DATE '{TEST_LAST}', INTERVAL 1 MONTH)) AS DATE) AS month
    FROM monthly GROUP BY product_name HAVING min(month) <= DATE '{TEST_LAST}')
  SELECT sp.product_name, sp.month, CAST(coalesce(m.quantity, 0) AS DOUBLE) AS quantity
  FROM spine sp LEFT JOIN monthly m USING (product_name, month)"""


def _trailing(min_periods: int) -> str:
    w = (f"(PARTITION BY product_name ORDER BY month "
         f"ROWS BETWEEN {P.FORECAST_WINDOW} PRECEDING AND 1 PRECEDING)")
    return (f"SELECT product_name, month, quantity AS actual, "
            f"CASE WHEN count(quantity) OVER {w} >= {min_periods} THEN avg(quantity) OVER {w} END AS forecast "
            f"FROM ({DENSE}) d")


WALK = f"""
  SELECT product_name, month, actual, forecast,
         CAST(round_even(forecast, 0) AS BIGINT) AS forecast_rounded, abs(actual - forecast) AS abs_error
  FROM ({_trailing(1)}) t
  WHERE month BETWEEN DATE '{TEST_FIRST}' AND DATE '{TEST_LAST}'"""

FIXED = f"""
  SELECT d.product_name, d.month, d.quantity AS actual, o.forecast, abs(d.quantity - o.forecast) AS abs_error
  FROM ({DENSE}) d
  LEFT JOIN (SELECT product_name, avg(quantity) AS forecast FROM ({DENSE}) d2
             WHERE month BETWEEN DATE '{TRAIN_TAIL_FROM}' AND DATE '{P.FORECAST_TRAIN_END}'
             GROUP BY 1) o USING (product_name)
  WHERE d.month BETWEEN DATE '{TEST_FIRST}' AND DATE '{TEST_LAST}'"""

ORACLE["monthly_demand_dense"] = DENSE
ORACLE["walk_forward_forecast"] = WALK
ORACLE["demand_forecast_product"] = f"SELECT * FROM ({WALK}) w WHERE product_name = '{P.FORECAST_PRODUCT}'"
ORACLE["rolling_strict_forecast"] = _trailing(P.FORECAST_WINDOW)
ORACLE["fixed_origin_forecast"] = FIXED
ORACLE["forecast_metrics"] = f"""
SELECT w.product_name, w.mae_walk_forward, w.total_actual, w.total_forecast, f.mae_fixed_origin,
       w.total_forecast - w.total_actual AS gap
FROM (SELECT product_name, round(avg(abs_error), 6) AS mae_walk_forward,
             sum(actual) AS total_actual, CAST(sum(forecast_rounded) AS BIGINT) AS total_forecast
      FROM ({WALK}) x GROUP BY 1) w
LEFT JOIN (SELECT product_name, round(avg(abs_error), 6) AS mae_fixed_origin FROM ({FIXED}) y GROUP BY 1) f
USING (product_name)"""

ORACLE["shipped_before_order"] = """
SELECT count(*) AS n_lines, count(*) FILTER (WHERE l_shipdate < o_orderdate) AS n_before,
       min(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS smallest_gap_days
FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""

ORACLE["products_sold_before_registration"] = f"""
SELECT s.product_name, min(CAST(s.created_at AS DATE)) AS first_sale, max(r.registered_on) AS registered_on
FROM ({SALES_LINES}) s JOIN (
  SELECT p.p_name AS product_name, min(CAST(l.l_shipdate AS DATE)) AS registered_on
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY 1) r USING (product_name)
GROUP BY 1 HAVING min(CAST(s.created_at AS DATE)) < max(r.registered_on)"""

ORACLE["ordered_list_check"] = f"""
SELECT 'loyal_customers_api_vs_sql' AS check_name, count(*) AS n_left, count(*) AS n_right,
       CAST(0 AS BIGINT) AS n_different, true AS equal FROM ({LOYAL_TOP}) t"""

ORACLE["product_sale_span"] = f"""
SELECT product_name, min(CAST(created_at AS DATE)) AS first_sale, max(CAST(created_at AS DATE)) AS last_sale,
       count(*) AS sale_lines
FROM ({SALES_LINES}) s GROUP BY 1"""

# --- similarity -------------------------------------------------------------------

INTER = f"SELECT DISTINCT customer_id, product_id FROM ({SALES_LINES}) s"

ORACLE["item_similarity_topk"] = f"""
WITH inter AS ({INTER}),
ref AS (SELECT min(p_partkey) AS rid FROM part WHERE p_name = '{P.REFERENCE_PRODUCT}'),
sizes AS (SELECT product_id, count(*) AS buyers FROM inter GROUP BY 1),
ov AS (SELECT product_id, count(*) AS overlap FROM inter
       WHERE customer_id IN (SELECT customer_id FROM inter WHERE product_id = (SELECT rid FROM ref))
       GROUP BY 1),
top AS (
  SELECT s.product_id, coalesce(ov.overlap, 0) AS overlap, s.buyers,
         coalesce(ov.overlap, 0) / sqrt((SELECT buyers FROM sizes WHERE product_id = (SELECT rid FROM ref)) * s.buyers)
           AS similarity
  FROM sizes s LEFT JOIN ov USING (product_id)
  WHERE s.product_id <> (SELECT rid FROM ref)
  ORDER BY similarity DESC, product_id ASC LIMIT {P.SIMILAR_TOP_N})
SELECT t.product_id, p.p_name AS name, t.overlap, t.buyers, t.similarity
FROM top t LEFT JOIN part p ON p.p_partkey = t.product_id"""

ORACLE["item_similarity_references"] = f"""
WITH inter AS ({INTER}),
refs AS (SELECT min(p_partkey) AS reference_id FROM part WHERE p_name IN ({lit(P.REFERENCE_SET)}) GROUP BY p_name),
sizes AS (SELECT product_id, count(*) AS buyers FROM inter GROUP BY 1),
pairs AS (
  SELECT r.product_id AS reference_id, i.product_id, count(*) AS overlap
  FROM inter r JOIN refs ON refs.reference_id = r.product_id
  JOIN inter i ON i.customer_id = r.customer_id AND i.product_id <> r.product_id
  GROUP BY 1, 2)
SELECT pairs.reference_id, pairs.product_id, pairs.overlap,
       pairs.overlap / sqrt(rs.buyers * s.buyers) AS similarity
FROM pairs JOIN sizes s ON s.product_id = pairs.product_id
JOIN sizes rs ON rs.product_id = pairs.reference_id"""

ORACLE["interaction_shape"] = f"""
SELECT count(DISTINCT customer_id) AS customers, count(DISTINCT product_id) AS products, count(*) AS ones
FROM ({INTER}) i"""

# --- profiling and quality ---------------------------------------------------------

ORDERS_COLS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
LINEITEM_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

ORACLE["eda_orders_profile"] = f"""
SELECT count(*) AS total_rows, min(CAST(o_orderdate AS DATE)) AS date_min,
       max(CAST(o_orderdate AS DATE)) AS date_max,
       CAST(min(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS amount_min,
       CAST(max(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS amount_max,
       {half_up(f'sum(CAST(o_totalprice AS {MONEY}))', 'count(o_totalprice)')} AS amount_mean
FROM orders"""

ORACLE["eda_null_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count FROM {t}"
    for t, cols in (("orders", ORDERS_COLS), ("lineitem", LINEITEM_COLS)) for c in cols)

ORACLE["eda_value_counts"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ("o_orderstatus", "o_orderpriority"))

ORACLE["eda_crosstab"] = """
SELECT o_orderpriority,
       count(*) FILTER (WHERE o_orderstatus = 'F') AS st_f,
       count(*) FILTER (WHERE o_orderstatus = 'O') AS st_o,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS st_p
FROM orders GROUP BY o_orderpriority"""

ORACLE["eda_null_crosstab"] = """
SELECT d.lang, count(*) FILTER (WHERE l.quality IS NOT NULL) AS not_null,
       count(*) FILTER (WHERE l.quality IS NULL) AS is_null
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
GROUP BY d.lang"""

ORACLE["eda_describe"] = f"""
SELECT count(o_totalprice) AS count,
       {half_up(f'sum(CAST(o_totalprice AS {MONEY}))', 'count(o_totalprice)', 4)} AS mean,
       round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS min,
       round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.5), 4) AS q50,
       round(quantile_cont(o_totalprice, 0.75), 4) AS q75, max(o_totalprice) AS max
FROM orders"""

ORACLE["eda_iqr_outliers"] = "\nUNION ALL\n".join(f"""
SELECT CAST({k} AS DOUBLE) AS factor, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
       round(q3 + {k} * (q3 - q1), 4) AS upper_fence,
       (SELECT count(*) FROM orders WHERE o_totalprice > q3 + {k} * (q3 - q1)) AS n_above
FROM (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) q"""
    for k in (float(f) for f in P.IQR_FACTORS))

_UNIQUE = (("orders", ("o_orderkey",)), ("lineitem", ("l_orderkey", "l_linenumber")),
           ("customer", ("c_custkey",)), ("part", ("p_partkey",)), ("supplier", ("s_suppkey",)),
           ("documents", ("doc_id",)), ("conversations", ("conv_id", "turn")))

ORACLE["duplicate_keys"] = "\nUNION ALL\n".join(f"""
SELECT '{t}' AS table_name, '{",".join(k)}' AS key_columns, count(*) AS n_rows,
       (SELECT count(*) FROM (SELECT DISTINCT {", ".join(k)} FROM {t})) AS n_distinct_keys,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT {", ".join(k)} FROM {t})) AS n_duplicates
FROM {t}""" for t, k in _UNIQUE)

_FKS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
        ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
        ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"))

ORACLE["orphans"] = "\nUNION ALL\n".join(f"""
SELECT '{c}' AS child_table, '{ck}' AS child_column, '{p}' AS parent_table, count(*) AS n_orphans
FROM {c} x WHERE x.{ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} y WHERE y.{pk} = x.{ck})"""
    for c, ck, p, pk in _FKS)

ORACLE["orders_version_differences"] = """
WITH later AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7001 = 5 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 4999 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate,
         CASE WHEN o_orderkey % 4999 = 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders WHERE o_orderkey % 9973 <> 11
  UNION ALL
  SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 9973 = 17)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
       CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS kind,
       CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN concat_ws(',',
         CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
         CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END,
         CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END) END AS columns
FROM orders a FULL OUTER JOIN later b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus
   OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority"""

ORACLE["identity_check"] = f"""
WITH lo AS (
  SELECT l_orderkey,
         sum(CAST(l_extendedprice AS {MONEY})) AS subtotal,
         sum(CAST(l_extendedprice AS {MONEY}) * CAST(l_discount AS DECIMAL(4,2))) AS discount,
         sum(CAST(l_extendedprice AS {MONEY}) * (1 - CAST(l_discount AS DECIMAL(4,2)))
             * CAST(l_tax AS DECIMAL(4,2))) AS tax
  FROM lineitem GROUP BY l_orderkey),
d AS (
  SELECT abs(CAST(lo.subtotal AS DECIMAL(38,6)) - CAST(lo.discount AS DECIMAL(38,6)) + CAST(lo.tax AS DECIMAL(38,6))
             - CAST(o.o_totalprice AS DECIMAL(38,6))) AS diff
  FROM orders o JOIN lo ON lo.l_orderkey = o.o_orderkey)
SELECT 'order_total' AS check_name, count(*) AS n_rows, count(*) FILTER (WHERE diff > 0.01) AS n_mismatches,
       CAST(max(diff) AS DOUBLE) AS max_abs_diff
FROM d"""

_COUNTS = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, "
    f"(SELECT count(*) FROM (DESCRIBE {t})) AS n_columns" for t in ALL_TABLES)
ORACLE["multi_table_counts"] = f"""
WITH c AS ({_COUNTS})
SELECT table_name, n_rows, n_columns FROM c
UNION ALL
SELECT '*', CAST(sum(n_rows) AS BIGINT), CAST(sum(n_columns) AS BIGINT) FROM c"""

ORACLE["reconcile_paths"] = f"""
WITH a AS (SELECT customer_id, {half_up('revenue', 'frequency')} AS v FROM ({CUSTOMER_METRICS}) m),
b AS (SELECT o_custkey AS customer_id,
             {half_up(f'sum(CAST(o_totalprice AS {MONEY}))', 'count(o_orderkey)')} AS v
      FROM orders GROUP BY o_custkey)
SELECT 'avg_ticket_api_vs_sql' AS check_name, count(*) AS n_keys,
       count(*) FILTER (WHERE a.v IS NULL) AS missing_left, count(*) FILTER (WHERE b.v IS NULL) AS missing_right,
       coalesce(max(abs(a.v - b.v)), 0)::DOUBLE AS max_abs_diff
FROM a FULL OUTER JOIN b USING (customer_id)
UNION ALL
SELECT 'weekday_mean_api_vs_sql', count(*), count(*) FILTER (WHERE a.v IS NULL), count(*) FILTER (WHERE b.v IS NULL),
       coalesce(max(abs(a.v - b.v)), 0)::DOUBLE
FROM (SELECT weekday_number, avg_sale AS v FROM ({WEEKDAY_PROFILE}) w) a
FULL OUTER JOIN (
  SELECT CAST(dayofweek(d) + 6 AS BIGINT) % 7 AS weekday_number,
         {half_up('sum(coalesce(s, 0))', 'count(*)')} AS v
  FROM (SELECT CAST(range AS DATE) AS d
        FROM range((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), DATE '{P.CUTOFF_DAY}' + INTERVAL 1 DAY,
                   INTERVAL 1 DAY)) cal
  LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS {MONEY})) AS s FROM orders
             WHERE o_orderpriority = '{P.POS_CHANNEL}' GROUP BY 1) p ON p.day = cal.d
  GROUP BY 1) b USING (weekday_number)"""

ORACLE["distinct_status_values"] = """
SELECT DISTINCT 'o_orderstatus' AS column_name, o_orderstatus AS value FROM orders
UNION
SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders"""

ORACLE["status_conditional_sums"] = f"""
SELECT o.o_orderpriority AS channel,
       coalesce(sum(l.l_quantity) FILTER (WHERE o.o_orderstatus IN ({lit(P.BUSINESS_STATUSES)})), 0.0)::DOUBLE AS business_qty,
       coalesce(sum(l.l_quantity) FILTER (WHERE o.o_orderstatus = 'P'), 0.0)::DOUBLE AS pending_qty,
       sum(l.l_quantity) AS total
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
GROUP BY 1"""

ORACLE["future_rows"] = f"""
SELECT count(*) AS total_rows, count(*) FILTER (WHERE o_orderdate >= {NEXT_DAY}) AS future_rows FROM orders"""

# --- schema inference -------------------------------------------------------------

def _infer_sql() -> str:
    stamp = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
    day = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}"
    whole = "[-+]?[0-9]+"
    digits = "[0-9]+(_[0-9]+)*"   # separators stand between digits only
    real = f"[-+]?(({digits}([.]({digits})?)?|[.]{digits})(e[-+]?{digits})?|inf|infinity|nan)"
    values = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, column_name, value FROM "
        f"(UNPIVOT (SELECT COLUMNS(*)::VARCHAR FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE value)"
        for t in ALL_TABLES)
    tr = r"regexp_replace(value, '^\s+|\s+$', '', 'g')"
    return f"""
WITH v AS ({values}),
c AS (SELECT table_name, column_name, value, {tr} AS t FROM v),
s AS (
  SELECT table_name, column_name,
         count(*) FILTER (WHERE t <> '') AS n,
         bool_and(upper(t) IN ('TRUE', 'FALSE')) FILTER (WHERE t <> '') AS all_bool,
         bool_and(regexp_full_match(value, '{stamp}') AND TRY_CAST(value AS TIMESTAMP) IS NOT NULL)
           FILTER (WHERE t <> '') AS all_ts,
         bool_and(regexp_full_match(value, '{day}') AND TRY_CAST(value AS DATE) IS NOT NULL)
           FILTER (WHERE t <> '') AS all_date,
         bool_and(regexp_full_match(t, '{whole}')) FILTER (WHERE t <> '') AS all_int,
         bool_or(regexp_matches(t, '^[-+]?0[0-9]'))
           FILTER (WHERE t <> '' AND regexp_full_match(t, '{whole}')) AS any_lead0,
         bool_or(TRY_CAST(t AS DECIMAL(38,0)) IS NULL)
           FILTER (WHERE t <> '' AND regexp_full_match(t, '{whole}')) AS any_huge,
         max(abs(TRY_CAST(t AS DECIMAL(38,0))))
           FILTER (WHERE t <> '' AND regexp_full_match(t, '{whole}')) AS max_abs,
         bool_and(regexp_full_match(lower(t), '{real}')) FILTER (WHERE t <> '') AS all_float
  FROM c GROUP BY 1, 2),
pos AS (SELECT table_name, column_name, CAST(column_index AS BIGINT) AS position FROM duckdb_columns()
        WHERE table_name IN ({lit(ALL_TABLES)}))
SELECT pos.table_name, pos.position, pos.column_name,
       CASE WHEN coalesce(s.n, 0) = 0 THEN 'text'
            WHEN s.all_bool THEN 'boolean'
            WHEN s.all_ts THEN 'timestamp'
            WHEN s.all_date THEN 'date'
            WHEN s.all_int AND s.any_lead0 THEN 'text'
            WHEN s.all_int AND (s.any_huge OR s.max_abs > 9223372036854775807) THEN 'text'
            WHEN s.all_int AND s.max_abs <= 2147483647 THEN 'integer'
            WHEN s.all_int THEN 'bigint'
            WHEN s.all_float THEN 'numeric'
            ELSE 'text' END AS inferred_type,
       pos.column_name = 'id' AS is_key
FROM pos LEFT JOIN s USING (table_name, column_name)"""


ORACLE["infer_schema"] = _infer_sql()

_RAW = "\nUNION ALL\n".join(f"SELECT '{t}' AS table_name, count(*) AS raw_rows FROM {t}" for t in ALL_TABLES)
ORACLE["raw_record_counts"] = f"""
WITH c AS ({_RAW})
SELECT table_name, raw_rows FROM c UNION ALL SELECT '*', CAST(sum(raw_rows) AS BIGINT) FROM c"""

_LOAD_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
ORACLE["csv_roundtrip_load"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS raw_rows, (SELECT count(*) FROM {t}) AS loaded_rows, "
    f"(SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, true AS ok" for t in _LOAD_TABLES)

# --- KPI row, expectations, display tables ---------------------------------------------

def half_up_units(total: str, n: str, scale: int = 2) -> str:
    """Integer units of 10**-scale of round(total / n, scale) half away from zero (HUGEINT)."""
    units = f"CAST(({total}) * {10 ** scale} AS HUGEINT)"
    q = f"((2 * abs({units}) + ({n})) // (2 * ({n})))"
    return f"(CASE WHEN {units} < 0 THEN -{q} ELSE {q} END)"


CHANNEL_TOTALS = f"SELECT channel, sum(total) AS revenue, count(*) AS orders FROM ({BUSINESS}) b GROUP BY channel"
RETURNS_DONE = f"""
  SELECT CAST(l_extendedprice AS {MONEY}) AS refund FROM lineitem
  WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_shipdate < {NEXT_DAY}"""

ORACLE["kpi_row"] = f"""
SELECT
  (SELECT count(*) FROM duckdb_views() WHERE view_name IN ('orders', 'lineitem', 'part', 'supplier')) AS raw_tables,
  (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM orders UNION ALL SELECT count(*) FROM lineitem
    UNION ALL SELECT count(*) FROM part UNION ALL SELECT count(*) FROM supplier) c) AS raw_rows,
  (SELECT reason FROM ({ORACLE['return_reasons']}) r ORDER BY returns DESC, reason LIMIT 1) AS top_return_reason,
  (SELECT customer_id FROM ({LOYAL_TOP}) t ORDER BY avg_ticket DESC, customer_id LIMIT 1) AS best_customer,
  (SELECT max(avg_ticket) FROM ({LOYAL_TOP}) t) AS best_customer_ticket,
  (SELECT sum(forecast_rounded) - sum(actual) FROM ({ORACLE['demand_forecast_product']}) f)::DOUBLE AS forecast_gap,
  (SELECT name FROM ({ORACLE['item_similarity_topk']}) s ORDER BY similarity DESC, product_id LIMIT 1) AS top_similar_name,
  (SELECT count(*) FROM orders) AS raw_order_count,
  (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '{P.CUTOFF_DAY}') AS future_orders,
  (SELECT category FROM ({ORACLE['loyal_top_category']}) t) AS top_category,
  (SELECT total_items FROM ({ORACLE['loyal_top_category']}) t) AS top_category_items,
  (SELECT weekday_name FROM ({WEEKDAY_PROFILE}) w ORDER BY avg_sale, weekday_number LIMIT 1) AS worst_weekday,
  (SELECT avg_sale FROM ({WEEKDAY_PROFILE}) w ORDER BY avg_sale, weekday_number LIMIT 1) AS worst_weekday_avg,
  (SELECT calendar_days FROM ({ORACLE['calendar_zero_days']}) c) AS calendar_days,
  (SELECT zero_sales_days FROM ({ORACLE['calendar_zero_days']}) c) AS zero_sales_days,
  (SELECT count(*) FROM ({BUSINESS}) b) AS business_orders,
  (SELECT CAST(sum(total) AS DOUBLE) FROM ({BUSINESS}) b) AS total_revenue,
  (SELECT CAST(abs(max(CASE WHEN channel = '{P.CHANNELS[0]}' THEN {half_up_units('revenue', 'orders')} END)
                 - max(CASE WHEN channel = '{P.CHANNELS[-1]}' THEN {half_up_units('revenue', 'orders')} END))
               AS DOUBLE) / 100 FROM ({CHANNEL_TOTALS}) ct) AS ticket_gap,
  (SELECT count(*) FROM ({RETURNS_DONE}) r) AS completed_returns,
  (SELECT CAST(sum(refund) AS DOUBLE) FROM ({RETURNS_DONE}) r) AS refund_total,
  (SELECT completed_orders FROM ({ORACLE['supplier_overall']}) s) AS completed_purchase_orders,
  (SELECT late_orders FROM ({ORACLE['supplier_overall']}) s) AS late_purchase_orders,
  (SELECT on_time_rate FROM ({ORACLE['supplier_overall']}) s) AS on_time_rate,
  (SELECT avg_late_days FROM ({ORACLE['supplier_overall']}) s) AS avg_late_days,
  (SELECT CAST(sum(forecast_rounded) AS BIGINT) FROM ({ORACLE['demand_forecast_product']}) f) AS forecast_total,
  (SELECT sum(actual) FROM ({ORACLE['demand_forecast_product']}) f) AS forecast_actual_total,
  (SELECT round(avg(abs_error), 6) FROM ({ORACLE['demand_forecast_product']}) f) AS forecast_mae,
  (SELECT product_id FROM ({ORACLE['item_similarity_topk']}) s ORDER BY similarity DESC, product_id LIMIT 1)
    AS top_similar_product"""

_EXPECT = [
    ("channel_months_sum", "monthly channel revenue adds up to the channel summary",
     f"(SELECT CAST(sum(total) AS DOUBLE) FROM ({BUSINESS}) b)",
     f"(SELECT CAST(sum(revenue) AS DOUBLE) FROM ({CHANNEL_MONTHLY}) m)"),
    ("channel_orders", "business orders counted directly",
     f"(SELECT CAST(count(*) AS DOUBLE) FROM orders WHERE o_orderstatus IN ({lit(P.BUSINESS_STATUSES)}) "
     f"AND CAST(o_orderdate AS DATE) <= DATE '{P.CUTOFF_DAY}')",
     f"(SELECT CAST(sum(orders) AS DOUBLE) FROM ({CHANNEL_TOTALS}) c)"),
    ("calendar_length", "calendar covers every day from the first order to the cutoff",
     f"(SELECT CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), DATE '{P.CUTOFF_DAY}') + 1 AS DOUBLE) FROM orders)",
     f"(SELECT CAST(calendar_days AS DOUBLE) FROM ({ORACLE['calendar_zero_days']}) c)"),
    ("weekday_days", "weekday day counts add up to the calendar",
     f"(SELECT CAST(calendar_days AS DOUBLE) FROM ({ORACLE['calendar_zero_days']}) c)",
     f"(SELECT CAST(sum(days) AS DOUBLE) FROM ({WEEKDAY_PROFILE}) w)"),
    ("returns_count", "every completed return up to the cutoff has a reason",
     f"(SELECT CAST(count(*) AS DOUBLE) FROM ({RETURNS_DONE}) r)",
     f"(SELECT CAST(sum(returns) AS DOUBLE) FROM ({ORACLE['return_reasons']}) r)"),
    ("supplier_orders", "per-supplier completed orders add up to the total",
     f"(SELECT CAST(completed_orders AS DOUBLE) FROM ({ORACLE['supplier_overall']}) s)",
     f"(SELECT CAST(sum(orders) AS DOUBLE) FROM ({SUPPLIER_SCORES}) s)"),
    ("customer_orders", "customer frequencies add up to all orders",
     "(SELECT CAST(count(*) AS DOUBLE) FROM orders)",
     f"(SELECT CAST(sum(frequency) AS DOUBLE) FROM ({CUSTOMER_METRICS}) m)"),
]
ORACLE["expectations_report"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS check_name, '{lbl}' AS label, {e} AS expected, {v} AS value, "
    f"coalesce(abs({v} - {e}) <= 0, false) AS ok" for c, lbl, e, v in _EXPECT)


_SNAPSHOT = [
    ("business_orders", "orders in the business statuses up to the cutoff", f"SELECT count(*) FROM ({BUSINESS}) b"),
    ("total_revenue", "their revenue", f"SELECT CAST(sum(total) AS DOUBLE) FROM ({BUSINESS}) b"),
    ("calendar_days", "days from the first order to the cutoff", f"SELECT calendar_days FROM ({ORACLE['calendar_zero_days']}) c"),
    ("weekday_days", "the same days by weekday", f"SELECT sum(days) FROM ({WEEKDAY_PROFILE}) w"),
    ("completed_returns", "completed returns up to the cutoff", f"SELECT count(*) FROM ({RETURNS_DONE}) r"),
    ("refund_total", "their refunds", f"SELECT CAST(sum(refund) AS DOUBLE) FROM ({RETURNS_DONE}) r"),
    ("completed_purchase_orders", "purchase orders received in full", f"SELECT completed_orders FROM ({ORACLE['supplier_overall']}) s"),
    ("supplier_orders", "the same by supplier", f"SELECT sum(orders) FROM ({SUPPLIER_SCORES}) s"),
    ("late_purchase_orders", "received after the promised day", f"SELECT late_orders FROM ({ORACLE['supplier_overall']}) s"),
]
ORACLE["expectations_snapshot"] = "\nUNION ALL\n".join(
    f"SELECT '{c}' AS check_name, '{label}' AS label, CAST(v AS DOUBLE) AS expected, CAST(v AS DOUBLE) AS value, true AS ok FROM ({sql}) q(v)"
    for c, label, sql in _SNAPSHOT) + f"""
UNION ALL SELECT 'listed_customers', 'one customer too many', CAST({P.TOP_CUSTOMERS} + 1 AS DOUBLE), CAST(n AS DOUBLE), n = {P.TOP_CUSTOMERS} + 1
FROM (SELECT count(*) AS n FROM ({LOYAL_TOP}) t) q
UNION ALL SELECT 'unknown_figure', 'a figure that no mart has', 0.0, NULL, false"""


def _num(x: str, d: int) -> str:
    return f"translate(format('{{:,.{d}f}}', CAST({x} AS DOUBLE)), ',.', '.,')"


def _brl(x: str) -> str:
    return f"'R$ ' || {_num(x, 2)}"


def _int(x: str) -> str:
    return f"translate(format('{{:,.0f}}', round_even(CAST({x} AS DOUBLE), 0)), ',', '.')"


def _pct(x: str) -> str:
    return f"replace(format('{{:.1f}}', CAST({x} AS DOUBLE) * 100), '.', ',') || '%'"


def _compact(x: str) -> str:
    v = f"CAST({x} AS DOUBLE)"
    return (f"CASE WHEN abs({v}) >= 1000000000 THEN 'R$ ' || {_num(f'{v} / 1000000000', 2)} || ' bi' "
            f"WHEN abs({v}) >= 1000000 THEN 'R$ ' || {_num(f'{v} / 1000000', 2)} || ' mi' "
            f"WHEN abs({v}) >= 1000 THEN 'R$ ' || {_num(f'{v} / 1000', 1)} || ' mil' "
            f"ELSE {_brl(v)} END")


ORACLE["display_channels_ptbr"] = f"""
SELECT channel, {_brl('revenue')} AS revenue, {_compact('revenue')} AS revenue_compact, {_int('orders')} AS orders,
       {_brl('avg_ticket')} AS avg_ticket, {_pct('share')} AS share
FROM ({ORACLE['channel_summary']}) s"""

# what the report prints: label, share, orders, delay with its unit
ORACLE["display_suppliers_ptbr"] = f"""
SELECT label, {_pct('on_time_rate')} AS on_time, {_int('orders')} AS orders, {_num('avg_late_days', 1)} || ' dias' AS avg_late_days
FROM ({ORACLE['supplier_punctuality']}) s"""

ORACLE["display_forecast_ptbr"] = f"""
SELECT product_name, strftime(month, '%Y-%m') AS month, {_int('actual')} AS actual,
       {_num('forecast', 2)} AS forecast, {_int('forecast_rounded')} AS forecast_rounded,
       {_num('abs_error', 2)} AS abs_error
FROM ({ORACLE['demand_forecast_product']}) f"""

ORACLE["display_channels_yearly_ptbr"] = f"""
SELECT CAST(year AS VARCHAR) AS year, {", ".join(f"{_brl(_channel_col(ch))} AS {_channel_col(ch)}" for ch in P.CHANNELS)}
FROM ({ORACLE['channel_yearly_pivot']}) y"""

ORACLE["display_customers_ptbr"] = f"""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, {_brl('avg_ticket')} AS avg_ticket, {_int('frequency')} AS orders,
       {_int('category_diversity')} AS categories
FROM ({ORACLE['loyal_customers_top10']}) t"""

ORACLE["display_weekday_ptbr"] = f"""
SELECT weekday_name, {_brl('avg_sale')} AS avg_sale, {_int('days')} AS days FROM ({ORACLE['weekday_sales_calendar']}) w"""

ORACLE["display_recommendations_ptbr"] = f"""
SELECT CAST(row_number() OVER (ORDER BY similarity DESC, product_id ASC) AS VARCHAR) AS position, name,
       replace(format('{{:.6f}}', similarity), '.', ',') AS similarity
FROM ({ORACLE['item_similarity_topk']}) s"""

ORACLE["display_returns_ptbr"] = f"""
SELECT reason, {_int('returns')} AS returns, {_brl('refund')} AS refund FROM ({ORACLE['return_reasons']}) r"""

ORACLE["streaming_daily_channel_sales"] = f"""
SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS channel,
       CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS revenue, count(*) AS orders
FROM orders GROUP BY 1, 2"""

ORACLE["demand_last_12_months"] = f"""
SELECT product_name, month, quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY month DESC) AS rn FROM ({DENSE}) d) x
WHERE rn <= 12"""

_M = f"CAST(o_totalprice AS {MONEY})"
ORACLE["eda_profile_report"] = f"""
WITH a AS (
  SELECT count(*) AS rows, CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS date_min,
         CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS date_max,
         CAST(min({_M}) AS DOUBLE) AS amount_min, CAST(max({_M}) AS DOUBLE) AS amount_max,
         {half_up(f'sum({_M})', f'count({_M})')} AS amount_mean,
         count(*) FILTER (WHERE {_M} <= 0) AS nonpositive_amounts,
         {" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in ORDERS_COLS)} AS null_cells,
         count(*) FILTER (WHERE o_orderdate >= {NEXT_DAY}) AS future_rows
  FROM orders),
d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderkey FROM orders)) AS dup FROM orders)
SELECT 'rows' AS metric, CAST(rows AS DOUBLE) AS value_num, CAST(NULL AS VARCHAR) AS value_text FROM a
UNION ALL SELECT 'columns', {len(('o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'))}, NULL FROM a
UNION ALL SELECT 'date_min', NULL, date_min FROM a
UNION ALL SELECT 'date_max', NULL, date_max FROM a
UNION ALL SELECT 'amount_min', amount_min, NULL FROM a
UNION ALL SELECT 'amount_max', amount_max, NULL FROM a
UNION ALL SELECT 'amount_mean', amount_mean, NULL FROM a
UNION ALL SELECT 'nonpositive_amounts', nonpositive_amounts, NULL FROM a
UNION ALL SELECT 'null_cells', null_cells, NULL FROM a
UNION ALL SELECT 'future_rows', future_rows, NULL FROM a
UNION ALL SELECT 'duplicate_keys', dup, NULL FROM d
UNION ALL SELECT DISTINCT 'value_o_orderstatus', NULL, o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL
UNION ALL SELECT DISTINCT 'value_o_orderpriority', NULL, o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL"""

ORACLE["streaming_monthly_channel_sales"] = f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS channel,
       CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) AS revenue, count(*) AS orders
FROM orders GROUP BY 1, 2"""

ORACLE["events_after_cutoff"] = f"""
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE ts > TIMESTAMP '{P.EVENTS_CUTOFF_DAY} 23:59:59.999999') AS future_rows
FROM events"""


# --- fingerprints of the marts ---------------------------------------------------------
# mart -> (SQL, its columns in order; '#' marks those with a fraction)
_MARTS = {
    "loyal_customers": (LOYAL_TOP, "customer_id revenue# frequency avg_ticket# category_diversity"),
    "loyal_top_category": (ORACLE["loyal_top_category"], "category total_items#"),
    "weekday_calendar": (WEEKDAY_PROFILE, "weekday_number weekday_name avg_sale# days"),
    "calendar_stats": (ORACLE["calendar_zero_days"], "calendar_days zero_sales_days first_day last_day"),
    "channel_monthly": (ORACLE["channel_monthly"], "month channel revenue# orders"),
    "channel_summary": (ORACLE["channel_summary"], "channel revenue# orders avg_ticket# share#"),
    "channel_yearly": (ORACLE["channel_yearly_pivot"], "year " + " ".join(f"{_channel_col(ch)}#" for ch in P.CHANNELS)),
    "returns_by_reason": (ORACLE["return_reasons"], "reason returns refund#"),
    "supplier_scores": (SUPPLIER_SCORES, "supplier_id label orders on_time_rate# avg_late_days#"),
    "supplier_overall": (ORACLE["supplier_overall"], "completed_orders late_orders on_time_rate# avg_late_days#"),
    "forecast": (ORACLE["demand_forecast_product"], "product_name month actual# forecast# forecast_rounded abs_error#"),
    "similar_items": (ORACLE["item_similarity_topk"], "product_id overlap buyers similarity#"),
}


def _fingerprint(mart: str, sql: str, columns: str) -> str:
    texts = []
    for c in columns.split():
        name = c.rstrip("#")
        text = f"printf('%.6f', CASE WHEN abs({name}) < 0.0000005 THEN 0.0 ELSE CAST({name} AS DOUBLE) END)" if c != name else f"CAST({name} AS VARCHAR)"
        texts.append(f"coalesce(CASE WHEN {name} IS NOT NULL THEN {text} END, '\\N')")
    row = " || '|' || ".join(texts)
    return (f"SELECT '{mart}' AS mart, count(*) AS n_rows, "
            f"CAST(coalesce(sum(CAST(('0x' || substr(md5({row}), 1, 15)) AS BIGINT)), 0) AS VARCHAR) AS hash_sum FROM ({sql}) x")


ORACLE["mart_fingerprints"] = "\nUNION ALL\n".join(_fingerprint(m, sql, columns) for m, (sql, columns) in _MARTS.items())

ORACLE["normalized_documents"] = """
WITH n AS (SELECT doc_id, strip_accents(nfc_normalize(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')))) AS t FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS md5, regexp_matches(t, '[\\p{L}\\p{N}]') AS has_alnum FROM n"""

# --- every value of every table, from the tables themselves -----------------------------------
# table -> its columns in order; '#' marks those with a fraction
_CONTENT = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal# c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal#",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice#",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice# o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity# l_extendedprice# l_discount# l_tax# l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value# props",
    "documents": "doc_id text lang source n_chars",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
ORACLE["csv_typed_content"] = "\nUNION ALL\n".join(
    _fingerprint(t, f"SELECT * FROM {t}", columns).replace(" AS mart,", " AS table_name,") for t, columns in _CONTENT.items())

ORACLE["published_report"] = "\nUNION ALL\n".join(
    f"SELECT CAST(1 AS BIGINT) AS version, x.* FROM ({_fingerprint(m, sql, columns)}) x" for m, (sql, columns) in _MARTS.items())
