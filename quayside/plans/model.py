"""The logical retail model and its adapters.

Operators in ``quayside.operators`` are written against logical frames
(orders, order items, products, returns, purchase orders, receipts,
suppliers) with fixed column names. An adapter maps physical tables onto
them with projections only, so Catalyst still prunes and pushes down into
the physical scans.

``star_model`` maps the TPC-H style test tables:

* orders: o_orderkey, o_custkey, o_orderpriority (channel), o_orderstatus
  (status), o_totalprice (total), o_orderdate (created_at)
* order items: lineitem (l_orderkey, l_partkey as variant, l_quantity,
  l_extendedprice)
* product = part row; name = p_name (64 names: several ids per name);
  category = p_brand
* returns: line items with l_returnflag = 'R'; status = l_linestatus and
  'F' means completed (``return_completed``); refund = l_extendedprice; created_at = l_shipdate; the free-text
  reason is a spelling of the reason map in messy case, spacing and accents, by the line's keys
* purchase orders: one per (l_orderkey, l_suppkey), placed at the order
  date, promised ``PROMISE_DAYS`` later, received when all its lines have
  l_linestatus = 'F'; each line is a goods receipt at l_shipdate
* suppliers: s_suppkey, s_name; a quarter have a trade name, another quarter a blank one
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import not_after
from ..functions.money import to_money
from ..functions.text import REASON_LABELS
from ..sources.tables import read_table

# ---------------------------------------------------------------------------
# Fixed parameters of the test mapping (shared with the SQL oracles).
PROMISE_DAYS = 30
# A returned line's reason is the spelling number (l_partkey + l_linenumber) mod 20
# of the reason map, with three that say nothing behind it, written in one of four
# ways by l_orderkey mod 4.
REASON_VARIANTS = 4
NO_REASON = ("", "---", None)
# ---------------------------------------------------------------------------


class RetailModel:
    """Logical frames of the retail model (any object with these attributes works).

    orders          id, customer_id, channel, status, total, created_at
    order_items     order_id, variant_id, quantity, line_total
    products        product_id, name, category
    variants        variant_id, product_id (None: variant = product)
    returns         status, reason, refund, created_at
    purchase_orders po keys..., supplier_id, status, placed_at, expected_delivery_at
    receipts        po keys..., received_at
    suppliers       supplier_id, legal_name, trade_name
    sources         {name: frame} of the physical tables behind these frames

    A model whose frames are the tables themselves needs no ``sources``.
    """

    po_keys: tuple[str, ...] = ("po_id",)
    variants: DataFrame | None = None
    return_completed: str = "completed"     # returns.status value of a completed return

    def __init__(self, **frames):
        for key, value in frames.items():
            setattr(self, key, value)

    @cached_property
    def sources(self) -> dict[str, DataFrame]:
        """Each frame that was given is a table of its own."""
        return {name: f for name, f in vars(self).items() if isinstance(f, DataFrame)}


class StarModel(RetailModel):
    """The test star schema seen as the retail model; frames are built on first use."""

    po_keys = ("order_key", "supplier_id")
    variants = None
    return_completed = "F"      # the raw line status, so the filter reaches the Parquet scan

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def _t(self, name: str) -> DataFrame:
        return read_table(self._spark, self._dir, name)

    @cached_property
    def sources(self) -> dict[str, DataFrame]:
        return {name: self._t(name) for name in ("orders", "lineitem", "part", "supplier")}

    @cached_property
    def orders(self) -> DataFrame:
        return self._t("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderpriority").alias("channel"),
            F.col("o_orderstatus").alias("status"),
            to_money("o_totalprice").alias("total"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self._t("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("variant_id"),
            F.col("l_quantity").alias("quantity"),
            to_money("l_extendedprice").alias("line_total"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._t("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("category"),
        )

    @cached_property
    def returns(self) -> DataFrame:
        spellings = F.array(*[F.lit(s).cast("string") for s in (*REASON_LABELS, *NO_REASON)])
        text = F.element_at(spellings, (F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(len(REASON_LABELS) + len(NO_REASON))) + 1).cast("int"))
        way = F.pmod("l_orderkey", F.lit(REASON_VARIANTS))
        messy = (F.when(way == 1, F.upper(text)).when(way == 2, F.concat(F.lit("\t "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" ")))
                 .when(way == 3, F.translate(text, "aeoc", "ãéõç")).otherwise(text))
        return self._t("lineitem").where(F.col("l_returnflag") == "R").select(
            F.col("l_linestatus").alias("status"),
            messy.alias("reason"),
            to_money("l_extendedprice").alias("refund"),
            F.col("l_shipdate").alias("created_at"),
        )

    @cached_property
    def _po_lines(self) -> DataFrame:
        return self._t("lineitem").select(F.col("l_orderkey").alias("order_key"),
                                          F.col("l_suppkey").alias("supplier_id"),
                                          "l_linestatus", F.col("l_shipdate").alias("received_at"))

    @cached_property
    def purchase_orders(self) -> DataFrame:
        heads = self._po_lines.groupBy("order_key", "supplier_id").agg(
            F.when(F.bool_and(F.col("l_linestatus") == "F"), "received").otherwise("open").alias("status"))
        placed = self._t("orders").select(F.col("o_orderkey").alias("order_key"),
                                          F.col("o_orderdate").alias("placed_at"))
        return heads.join(placed, "order_key").select(
            "order_key", "supplier_id", "status", "placed_at",
            F.date_add(F.to_date("placed_at"), PROMISE_DAYS).alias("expected_delivery_at"))

    def received_orders(self, cutoff_day) -> DataFrame:
        """Fully received orders with their last receipt up to the cutoff, from one pass over the lines."""
        seen = not_after(F.col("received_at"), cutoff_day)
        heads = self._po_lines.groupBy("order_key", "supplier_id").agg(
            F.bool_and(F.col("l_linestatus") == "F").alias("received"),
            F.max(F.when(seen, F.col("received_at"))).alias("completed_at"))
        placed = self._t("orders").where(not_after(F.col("o_orderdate"), cutoff_day)).select(
            F.col("o_orderkey").alias("order_key"), F.date_add(F.to_date("o_orderdate"), PROMISE_DAYS).alias("expected_delivery_at"))
        return heads.where("received").join(placed, "order_key").select("order_key", "supplier_id", "completed_at", "expected_delivery_at")

    @cached_property
    def receipts(self) -> DataFrame:
        return self._po_lines.select("order_key", "supplier_id", "received_at")

    @cached_property
    def suppliers(self) -> DataFrame:
        kind = F.col("s_suppkey") % 4
        return self._t("supplier").select(
            F.col("s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("legal_name"),
            F.when(kind == 0, F.concat(F.lit("  "), F.col("s_name"), F.lit(" & Co "))).when(kind == 1, "   ").alias("trade_name"),
        )


class BucketedStarModel(StarModel):
    """Same mapping, but lineitem and orders come from tables bucketed on the order key
    (``sources.layout.colocate_facts``), so the line-to-order join needs no shuffle."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: dict):
        super().__init__(spark, sf_dir)
        self._tables = tables

    def _t(self, name: str) -> DataFrame:
        if name in self._tables:
            return self._spark.table(self._tables[name])
        return super()._t(name)


def star_model(spark: SparkSession, sf_dir: str) -> StarModel:
    return StarModel(spark, sf_dir)


def bucketed_star_model(spark: SparkSession, sf_dir: str, buckets: int, base_path: str,
                        prefix: str = "quayside") -> BucketedStarModel:
    """Write lineitem and orders bucketed by order key once; model reading them."""
    from ..sources.layout import colocate_facts
    facts = {"lineitem": (read_table(spark, sf_dir, "lineitem"), "l_orderkey"),
             "orders": (read_table(spark, sf_dir, "orders"), "o_orderkey")}
    return BucketedStarModel(spark, sf_dir, colocate_facts(spark, facts, buckets, base_path, prefix))


def order_lines(model: RetailModel) -> DataFrame:
    """Order lines with their order's attributes and the product id, without the product table."""
    items = model.order_items
    if model.variants is not None:
        items = items.join(model.variants, "variant_id")
    else:
        items = items.withColumn("product_id", F.col("variant_id"))
    orders = model.orders.select(F.col("id").alias("order_id"), "customer_id", "created_at",
                                 "status", "channel")
    return items.join(orders, "order_id")


def sales_lines(model: RetailModel) -> DataFrame:
    """Order lines with their order and product attributes.

    customer_id, created_at, status, channel, order_id, product_id, name,
    category, quantity, line_total. Inner joins, as in the report's chain.
    The fact-to-fact join (items x orders) shuffles on the order key; the
    product dimension join is left to AQE (broadcast when its measured size
    is under the threshold, shuffle otherwise).
    """
    return order_lines(model).join(model.products, "product_id")
