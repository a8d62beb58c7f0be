"""Co-purchase item similarity (binary cosine) without a dense matrix.

For 0/1 purchase vectors, cosine(a, b) = overlap(a, b) / sqrt(n(a) n(b)),
where n(x) is the number of buyers of x and overlap the number of common
buyers. Only the reference item's buyers are joined back to the
interactions, so the work is linear in the interactions (no item x item
pair explosion). A hot buyer (huge basket) makes one join key large;
AQE's skew-join split handles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interactions(lines: DataFrame, customer: str = "customer_id", product: str = "product_id") -> DataFrame:
    """Distinct (customer, product) pairs: the sparse binary matrix."""
    return lines.select(F.col(customer).alias("customer_id"), F.col(product).alias("product_id")).distinct()


def matrix_shape(inter: DataFrame) -> DataFrame:
    """customers, products, ones (number of non-zero cells)."""
    return inter.agg(F.count_distinct("customer_id").alias("customers"),
                     F.count_distinct("product_id").alias("products"),
                     F.count("*").alias("ones"))


def first_id_by_name(products: DataFrame, name: str, id_col: str = "product_id",
                     name_col: str = "name") -> Column:
    """Scalar subquery: smallest id carrying ``name`` (deterministic "first")."""
    return products.where(F.col(name_col) == name).select(F.min(id_col)).scalar()


def require_product(products: DataFrame, name: str, name_col: str = "name") -> None:
    """Fail fast when the reference name is missing (one-row probe)."""
    if products.where(F.col(name_col) == name).isEmpty():
        raise ValueError(f"reference product not found: {name!r}")


def buyer_counts(inter: DataFrame) -> DataFrame:
    return inter.groupBy("product_id").agg(F.count("*").alias("buyers"))


def similar_items(inter: DataFrame, reference: Column, k: int | None = 5) -> DataFrame:
    """product_id, overlap, buyers, similarity vs the reference item.

    Every interacted item except the reference is a candidate (zero overlap
    scores 0). A reference without buyers raises when the frame runs. Total
    order: similarity desc, product id asc.
    """
    ref_buyers = inter.where(F.col("product_id") == reference).select("customer_id")
    overlap = (inter.join(ref_buyers, "customer_id", "left_semi")
               .groupBy("product_id").agg(F.count("*").alias("overlap")))
    sizes = buyer_counts(inter)
    n_ref = sizes.where(F.col("product_id") == reference).select("buyers").scalar()
    scored = (sizes.where(F.col("product_id") != reference)
              .join(overlap, "product_id", "left")
              .select("product_id", F.coalesce("overlap", F.lit(0)).alias("overlap"), "buyers")
              .withColumn("similarity", F.when(n_ref.isNull(), F.raise_error(F.lit("the reference item has no buyers")).cast("double"))
                          .otherwise(F.col("overlap") / F.sqrt(n_ref * F.col("buyers")))))
    ranked = scored.orderBy(F.col("similarity").desc(), F.col("product_id").asc())
    return ranked.limit(k) if k else ranked


def similarity_to_references(inter: DataFrame, references: DataFrame) -> DataFrame:
    """Sparse similarity rows (reference_id, product_id, overlap, similarity).

    ``references`` holds a bounded set of reference ids (one per requested
    name), so each buyer contributes at most |references| x basket rows —
    never all pairs of a basket. Pairs with no common buyer are implicit 0.
    """
    refs = F.broadcast(references.select(F.col("product_id").alias("reference_id")))
    ref_inter = inter.join(refs, inter["product_id"] == refs["reference_id"]).select("customer_id", "reference_id")
    pairs = (ref_inter.join(inter, "customer_id")
             .where(F.col("product_id") != F.col("reference_id"))
             .groupBy("reference_id", "product_id").agg(F.count("*").alias("overlap")))
    sizes = buyer_counts(inter)
    ref_sizes = sizes.select(F.col("product_id").alias("reference_id"), F.col("buyers").alias("ref_buyers"))
    return (pairs.join(sizes, "product_id").join(ref_sizes, "reference_id")
            .select("reference_id", "product_id", "overlap",
                    (F.col("overlap") / F.sqrt(F.col("ref_buyers") * F.col("buyers"))).alias("similarity")))
