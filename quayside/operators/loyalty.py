"""Customer value and loyalty: revenue, frequency, ticket, category breadth.

Plan shape at scale: both per-customer aggregates are hash aggregates with
map-side partial combine (a customer holding a third of all orders only
adds rows to the partial buffers, not to one reducer's input); the join of
the two aggregates is on the same key, and the top-k is a
``TakeOrderedAndProject`` that keeps k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import mean_half_up, to_money


def customer_metrics(orders: DataFrame, customer: str = "customer_id", order_id: str = "id",
                     total: str = "total", drop_null_keys: bool = False) -> DataFrame:
    """customer, revenue (exact sum), frequency (orders), avg_ticket (half up, 2)."""
    src = orders.where(F.col(customer).isNotNull()) if drop_null_keys else orders
    agg = src.groupBy(customer).agg(
        F.sum(to_money(total)).alias("revenue"),
        F.count(order_id).alias("frequency"),
    )
    return agg.withColumn("avg_ticket", mean_half_up(F.col("revenue"), F.col("frequency"), 2))


def category_diversity(lines: DataFrame, customer: str = "customer_id",
                       category: str = "category") -> DataFrame:
    """customer, category_diversity = number of distinct categories bought."""
    return lines.groupBy(customer).agg(F.count_distinct(category).alias("category_diversity"))


#: Categories of one word of a customer's set.
WORD_BITS = 64


def numbered_categories(products: DataFrame, category: str = "category") -> DataFrame:
    """(category, word, bit): a place in a set of 64-bit words for every category, in order of its name.

    The window ranks one row for each distinct category, not the products.
    """
    distinct = products.select(F.col(category).alias("category")).where(F.col(category).isNotNull()).distinct()
    number = F.row_number().over(Window.orderBy("category")) - 1
    return distinct.select("category", F.floor(number / WORD_BITS).cast("int").alias("word"), (number % WORD_BITS).cast("int").alias("bit"))


def category_sets(lines: DataFrame, numbers: DataFrame, period, customer: str = "customer_id", category: str = "category") -> DataFrame:
    """(customer, period, word, categories): the categories bought in each period, as 64-bit words.

    The sets merge with ``bit_or``, which Spark combines map-side: a period's
    rows can be added to, rolled up to any longer period and summed up by a
    stream, and the count of distinct categories stays exact. A word takes 8
    bytes and exists only where the customer bought one of its 64 categories.
    """
    placed = lines.select(F.col(customer).alias(customer), period.alias("period"), F.col(category).alias("category")).join(numbers, "category")
    return placed.groupBy(customer, "period", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("categories"))


def rolled_up(sets: DataFrame, period, customer: str = "customer_id") -> DataFrame:
    """Sets of longer periods from those of shorter ones; ``period`` is a column over ``sets``."""
    return (sets.select(customer, period.alias("period"), "word", "categories").groupBy(customer, "period", "word")
            .agg(F.bit_or("categories").alias("categories")))


def set_sizes(sets: DataFrame, customer: str = "customer_id") -> DataFrame:
    """customer, period, category_diversity: distinct categories of each set."""
    return sets.groupBy(customer, "period").agg(F.sum(F.bit_count("categories")).cast("bigint").alias("category_diversity"))


def loyal_customers(metrics: DataFrame, diversity: DataFrame, min_categories: int = 13,
                    k: int = 10, customer: str = "customer_id") -> DataFrame:
    """Top-k customers by average ticket among those with enough categories.

    Total order: avg_ticket desc, customer asc (the reference's tie rule).
    """
    ranked = (metrics.join(diversity, customer)
              .where(F.col("category_diversity") >= min_categories))
    return ranked.orderBy(F.col("avg_ticket").desc(), F.col(customer).asc()).limit(k)


def leading_category(lines: DataFrame, customers: DataFrame, customer: str = "customer_id",
                     category: str = "category", quantity: str = "quantity", k: int = 1) -> DataFrame:
    """Category with the most items bought by ``customers`` (a top-k frame).

    ``customers`` is the output of a ``limit(k)``: its size is bounded by k,
    so broadcasting it for the semi-join is safe at any scale.
    Ties: quantity desc, category name asc.
    """
    keys = F.broadcast(customers.select(customer))
    sold = (lines.join(keys, customer, "left_semi")
            .groupBy(category).agg(F.sum(quantity).alias("total_items")))
    return sold.orderBy(F.col("total_items").desc(), F.col(category).asc()).limit(k)
