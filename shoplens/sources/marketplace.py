"""Marketplace tables (orders, items, customers, sellers, products, reviews) from the test tables.

The test tables hold no reviews, delivery dates or postcodes, so these are projections of real
columns. Everything stays lazy; Catalyst drops what a query does not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.sources.catalog import scan


@dataclass(frozen=True)
class Marketplace:
    """The six tables the operators read."""

    orders: DataFrame
    items: DataFrame
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    reviews: DataFrame


def _days(n) -> F.Column:
    return F.make_dt_interval(n)


def load_marketplace(spark: SparkSession, folder: str) -> Marketplace:
    orders, lineitem = scan(spark, folder, "orders"), scan(spark, folder, "lineitem")
    first_shipment = lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    transit = F.pmod(F.datediff("first_ship", "o_orderdate"), F.lit(45))
    orders_view = orders.join(first_shipment, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "shipped")
        .otherwise("canceled").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        (F.col("o_orderdate") + _days(F.lit(30))).alias("order_estimated_delivery_date"),
        (F.col("o_orderdate") + _days(transit)).alias("order_delivered_customer_date"),
    )
    price = F.col("l_extendedprice")
    items = lineitem.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"), (price * (1 - F.col("l_discount"))).alias("price"),
        (price * F.col("l_tax")).alias("freight_value"),
    )
    customers = scan(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.lpad((F.col("c_nationkey") * 4).cast("string"), 2, "0"), F.lit("000"))
        .alias("customer_zip_code_prefix"),
    )
    sellers = scan(spark, folder, "supplier").select(F.col("s_suppkey").alias("seller_id"))
    products = scan(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_type")).alias("product_category_name"),
    )
    kind = F.col("event_type")
    score = (F.when(kind == "error", 1).when(kind == "signup", 2).when(kind == "view", 3)
             .when(kind == "click", 4).when(kind == "purchase", 5))
    reviews = scan(spark, folder, "events").join(
        orders.select("o_orderkey", "o_orderdate"), F.col("event_id") == F.col("o_orderkey")
    ).select(
        F.col("event_id").alias("review_id"), F.col("event_id").alias("order_id"),
        score.alias("review_score"),
        (F.col("o_orderdate") + _days(F.lit(35))).alias("review_creation_date"),
    )
    return Marketplace(orders_view, items, customers, sellers, products, reviews)
