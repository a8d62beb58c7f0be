"""The logical model with its own tables (variants separate from products), as a user would wire it."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from quayside.operators import loyalty, similarity, suppliers
from quayside.plans.model import RetailModel, sales_lines

T = dt.datetime


def test_four_way_chain_and_marts(spark):
    orders = spark.createDataFrame([
        (1, 10, "pos", "paid", D("100.00"), T(2026, 1, 5)),
        (2, 10, "ecommerce", "paid", D("50.05"), T(2026, 2, 5)),
        (3, 20, "pos", "cancelled", D("10.00"), T(2026, 2, 6))],
        "id long, customer_id long, channel string, status string, total decimal(18,2), created_at timestamp_ntz")
    items = spark.createDataFrame([(1, 100, 2, D("40.00")), (1, 101, 1, D("60.00")), (2, 200, 5, D("50.05")),
                                   (3, 100, 1, D("10.00"))],
                                  "order_id long, variant_id long, quantity long, line_total decimal(18,2)")
    variants = spark.createDataFrame([(100, 1), (101, 1), (200, 2)], "variant_id long, product_id long")
    products = spark.createDataFrame([(1, "Motor de Popa", "Motores"), (2, "Hélice", "Hélices")],
                                     "product_id long, name string, category string")
    model = RetailModel(orders=orders, order_items=items, variants=variants, products=products)
    lines = sales_lines(model)
    assert sorted((r["order_id"], r["product_id"], r["quantity"]) for r in lines.collect()) == \
        [(1, 1, 1), (1, 1, 2), (2, 2, 5), (3, 1, 1)]
    div = {r["customer_id"]: r["category_diversity"] for r in loyalty.category_diversity(lines).collect()}
    assert div == {10: 2, 20: 1}
    metrics = {r["customer_id"]: r["avg_ticket"] for r in loyalty.customer_metrics(orders).collect()}
    assert metrics[10] == D("75.03")                      # 150.05 / 2 = 75.025 -> half up
    top = loyalty.loyal_customers(loyalty.customer_metrics(orders), loyalty.category_diversity(lines), 2, 10)
    assert [r["customer_id"] for r in top.collect()] == [10]
    assert loyalty.leading_category(lines, top).first()["category"] == "Hélices"
    inter = similarity.interactions(lines)
    sims = {r["product_id"]: r["similarity"] for r in similarity.similar_items(inter, F.lit(1), k=None).collect()}
    assert abs(sims[2] - 1 / 2 ** 0.5) < 1e-12            # buyers(1) = {10, 20}, buyers(2) = {10}


def test_supplier_mart_with_reference_shaped_tables(spark):
    pos = spark.createDataFrame([(7, 3, "received", T(2026, 1, 1), dt.date(2026, 1, 20))],
                                "po_id long, supplier_id long, status string, placed_at timestamp_ntz, "
                                "expected_delivery_at date")
    receipts = spark.createDataFrame([(7, T(2026, 1, 25, 9))], "po_id long, received_at timestamp_ntz")
    names = spark.createDataFrame([(3, "Náutica Legal LTDA", "Náutica")], "supplier_id long, legal_name string, "
                                                                        "trade_name string")
    done = suppliers.completed_orders(pos, receipts, "2026-08-14")
    r = suppliers.supplier_scores(done, names).first()
    assert (r["label"], r["orders"], r["on_time_rate"], r["avg_late_days"]) == ("F03 · Náutica", 1, 0.0, 5.0)
