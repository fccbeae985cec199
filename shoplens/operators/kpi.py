"""Marketplace KPIs: late and recent deliveries, seller revenue and growth, postcode reviews.

The newest purchase enters each query as a scalar subquery, so the date limit is known before the
scan of the filtered table starts and is pushed into it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.dates import months_before, start_of_day_after

CANCELED = "canceled"
DELIVERED = "delivered"
#: Amounts are added as decimals: the sum does not depend on the order of additions, however large it is.
MONEY = "decimal(20,6)"
#: Order items that one task groups.
ITEMS_PER_TASK = 1_000_000


def whole_amount(total: Column) -> Column:
    """Amount without its fraction. Rounding to 1e-6 first removes the noise of doubles, so 99.9999999999 counts as 100."""
    return F.round(total, 6).cast("bigint")


def _purchases_since(orders: DataFrame, months: int) -> Column:
    newest = F.max("order_purchase_timestamp")
    return orders.agg(months_before(newest, months).alias("since")).scalar()


def recent_deliveries(orders: DataFrame, months: int = 6, late_by_days: int | None = None) -> DataFrame:
    """Delivered, not cancelled orders of the last months, all columns.

    The window ends at the newest order that is not cancelled. With ``late_by_days`` only orders
    delivered on or after that many days past the estimated day remain.
    """
    active = orders.where(F.col("order_status") != CANCELED)
    estimated, delivered = F.col("order_estimated_delivery_date"), F.col("order_delivered_customer_date")
    # No upper limit is needed: none of these orders is newer than the newest of them.
    found = active.where(
        estimated.isNotNull() & delivered.isNotNull()
        & (F.col("order_purchase_timestamp") >= _purchases_since(active, months)))
    if late_by_days is not None:
        found = found.where(delivered >= start_of_day_after(estimated, late_by_days))
    return found


def late_deliveries(orders: DataFrame, months: int = 3, late_by_days: int = 3) -> DataFrame:
    return recent_deliveries(orders, months, late_by_days)


def high_revenue_sellers(sellers: DataFrame, items: DataFrame, orders: DataFrame,
                         threshold: int = 100_000) -> DataFrame:
    """Sellers whose delivered revenue, fraction cut off, exceeds the threshold; highest first."""
    delivered = orders.where(F.col("order_status") == DELIVERED).select("order_id")
    revenue = (
        items.join(delivered, "order_id")
        .groupBy("seller_id").agg(F.sum((F.col("price") + F.col("freight_value")).cast(MONEY)).alias("total"))
    )
    return (
        sellers.select("seller_id").join(revenue, "seller_id")
        .select("seller_id", whole_amount(F.col("total")).alias("total_revenue"))
        .where(F.col("total_revenue") > threshold)
        .orderBy(F.desc("total_revenue"), "seller_id")
    )


def new_engaged_sellers(sellers: DataFrame, items: DataFrame, orders: DataFrame,
                        months: int = 3, min_products: int = 30) -> DataFrame:
    """Sellers whose first sale is recent and who sold more than ``min_products`` items.

    Items are summed per order and seller before the join, so the distinct orders of a seller are counted as rows. They
    are dealt by order into tasks of about ITEMS_PER_TASK items, so a task holds no more of them when there are more.
    """
    items = items.where(F.col("order_id").isNotNull())
    items = items.repartition(max(1, math.ceil(items.count() / ITEMS_PER_TASK)), "order_id")
    purchases = orders.groupBy("order_id").agg(F.min("order_purchase_timestamp").alias("bought"), F.count("*").alias("rows"))
    lines = items.groupBy("order_id", "seller_id").agg(F.count("product_id").alias("products"))
    sold = (
        lines.join(purchases, "order_id").groupBy("seller_id")
        .agg(F.min("bought").alias("first_sale"),
             F.count("*").alias("total_orders"),
             F.sum(F.col("products") * F.col("rows")).alias("total_products"))
        .where((F.col("total_products") > min_products)
               & (F.col("first_sale") >= _purchases_since(orders, months)))
    )
    return sellers.select("seller_id").join(sold, "seller_id").orderBy(F.desc("total_products"), "seller_id")


def postcode_scores(customers: DataFrame, orders: DataFrame, reviews: DataFrame, months: int = 12,
                    min_reviews: int = 1, worst: int | None = None) -> DataFrame:
    """Review count and average per postcode; lowest average first, postcode breaks ties.

    Reviews are summed per order and then per customer before each join, so neither an order nor a
    customer with very many reviews reaches one task row by row.
    """
    per_order = (
        reviews.where(F.col("review_creation_date") >= _purchases_since(orders, months))
        .groupBy("order_id").agg(
            F.count("review_id").alias("reviews"), F.sum("review_score").alias("points"),
            F.count("review_score").alias("scored"))
    )
    per_customer = (
        per_order.join(orders.select("order_id", "customer_id"), "order_id").groupBy("customer_id")
        .agg(*[F.sum(c).alias(c) for c in ("reviews", "points", "scored")])
    )
    scores = (
        per_customer.join(customers.select("customer_id", "customer_zip_code_prefix"), "customer_id")
        .groupBy("customer_zip_code_prefix")
        .agg(F.sum("reviews").alias("review_count"), F.sum("points").alias("points"),
             F.sum("scored").alias("scored"))
        .where(F.col("review_count") >= min_reviews)
        .select("customer_zip_code_prefix", "review_count",
                F.round(F.try_divide("points", "scored"), 2).alias("avg_score"))
        .orderBy("avg_score", "customer_zip_code_prefix")
    )
    return scores if worst is None else scores.limit(worst)


def worst_postcodes(customers: DataFrame, orders: DataFrame, reviews: DataFrame, months: int = 12,
                    min_reviews: int = 30, worst: int = 5) -> DataFrame:
    return postcode_scores(customers, orders, reviews, months, min_reviews, worst)
