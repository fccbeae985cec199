"""Customer features: recency, frequency and value; satisfaction; buying behaviour.

Facts are summed per order before they meet the order table, so an order with very many items or
reviews is one row there, and the sums per customer are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.dates import whole_days
from shoplens.functions.frames import col
from shoplens.operators.kpi import DELIVERED, whole_amount

FLAG_COLUMNS = ("has_negative_flag",)
COUNT_COLUMNS = ("review_count", "unique_categories", "frequency", "unique_sellers")
FEATURE_COLUMNS = (
    "recency_days", "frequency", "monetary", "avg_review_score", "review_count", "has_negative_flag",
    "unique_categories", "avg_delivery_time", "unique_sellers",
)
NEGATIVE_SCORE = 2

def _is_delivered() -> Column:
    return F.col("order_status") == DELIVERED


def _newest_delivered(orders: DataFrame) -> Column:
    return orders.where(_is_delivered()).agg(F.max("order_purchase_timestamp").alias("newest")).scalar()


def _item_facts(items: DataFrame) -> DataFrame:
    amount = F.col("price") + F.col("freight_value")
    return items.groupBy("order_id").agg(F.count("*").alias("n_items"), F.sum(amount).alias("amount"))


def rfm_features(customers: DataFrame, orders: DataFrame, items: DataFrame, distinct: bool = False) -> DataFrame:
    """Per customer over delivered orders: last purchase, its age in days, frequency, value.

    ``frequency`` counts order items, as the source report does; ``distinct`` counts orders.
    """
    counted = F.lit(1) if distinct else F.col("n_items")
    per_customer = (
        orders.where(_is_delivered()).select("order_id", "customer_id", "order_purchase_timestamp")
        .join(_item_facts(items), "order_id").groupBy("customer_id")
        .agg(F.max("order_purchase_timestamp").alias("order_purchase_timestamp"),
             F.sum(counted).alias("frequency"), F.sum("amount").alias("amount"))
    )
    age = whole_days(F.col("order_purchase_timestamp"), _newest_delivered(orders))
    return customers.select("customer_id").join(per_customer, "customer_id").select(
        "customer_id", "order_purchase_timestamp", age.alias("recency_days"), "frequency",
        whole_amount(F.col("amount")).alias("monetary"))


def _review_facts(reviews: DataFrame) -> DataFrame:
    score = F.col("review_score")
    return reviews.groupBy("order_id").agg(
        F.count("review_id").alias("n_reviews"), F.sum(score).cast("bigint").alias("points"),
        F.count(score).alias("scored"), F.count_if(score <= NEGATIVE_SCORE).alias("n_negative"))


def _satisfaction_columns() -> list[Column]:
    return [
        F.try_divide(F.sum("points"), F.sum("scored")).cast("bigint").alias("avg_review_score"),
        F.sum("n_reviews").alias("review_count"),
        F.when(F.sum("n_negative") > 0, 1).otherwise(0).cast("bigint").alias("has_negative_flag"),
    ]


def satisfaction_features(orders: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per customer: average score without its fraction, review count, flag for a bad score."""
    return (
        orders.select("order_id", "customer_id").join(_review_facts(reviews), "order_id")
        .groupBy("customer_id").agg(*_satisfaction_columns())
    )


def behavior_features(orders: DataFrame, items: DataFrame, products: DataFrame,
                      distinct: bool = False) -> DataFrame:
    """Per customer over delivered orders: categories, mean delivery days per item, sellers.

    Categories and sellers are counted per item, as the source report does; ``distinct`` counts
    different ones.
    """
    delivered = orders.where(_is_delivered()).select(
        "order_id", "customer_id", "order_purchase_timestamp", "order_delivered_customer_date")
    known = items.select("order_id", "product_id", "seller_id").join(products, "product_id")
    days = whole_days(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date"))
    if distinct:
        return known.join(delivered, "order_id").groupBy("customer_id").agg(
            F.count_distinct("product_category_name").alias("unique_categories"),
            F.avg(days).alias("avg_delivery_time"),
            F.count_distinct("seller_id").alias("unique_sellers"))
    per_order = known.groupBy("order_id").agg(
        F.count("*").alias("n_known"), F.count("product_category_name").alias("n_categories"),
        F.count("seller_id").alias("n_sellers"))
    return (
        delivered.join(per_order, "order_id").withColumn("days", days).groupBy("customer_id")
        .agg(F.sum("n_categories").alias("unique_categories"),
             _mean_days(F.lit(True)).alias("avg_delivery_time"), F.sum("n_sellers").alias("unique_sellers"))
    )


def _mean_days(condition: Column) -> Column:
    days, weight = F.col("days"), F.col("n_known")
    timed = condition & days.isNotNull()
    return F.try_divide(F.sum(F.when(timed, days * weight)), F.sum(F.when(timed, weight)))


def combine_features(rfm: DataFrame, satisfaction: DataFrame, behavior: DataFrame) -> DataFrame:
    """RFM rows with the other two feature tables attached where they exist."""
    return rfm.join(satisfaction, "customer_id", "left").join(behavior, "customer_id", "left")


def customer_features(customers: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame,
                      reviews: DataFrame) -> DataFrame:
    """The combined features in one pass: each fact table is read and shuffled once.

    Equal to ``combine_features`` of the three single tables, which read the items twice and shuffle
    by customer three times.
    """
    catalogue = products.select("product_id", "product_category_name", F.lit(1).alias("known"))
    is_known = F.col("known").isNotNull()
    per_order_items = items.join(catalogue, "product_id", "left").groupBy("order_id").agg(
        F.count("*").alias("n_items"), F.sum(F.col("price") + F.col("freight_value")).alias("amount"),
        F.count("known").alias("n_known"),
        F.count_if(is_known & F.col("product_category_name").isNotNull()).alias("n_categories"),
        F.count_if(is_known & F.col("seller_id").isNotNull()).alias("n_sellers"))
    days = whole_days(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date"))
    facts = (
        orders.join(per_order_items, "order_id", "left").join(_review_facts(reviews), "order_id", "left")
        .withColumn("days", days)
    )
    sold = _is_delivered() & (F.col("n_items") > 0)
    known = sold & (F.col("n_known") > 0)
    per_customer = facts.groupBy("customer_id").agg(
        F.max(F.when(sold, F.col("order_purchase_timestamp"))).alias("order_purchase_timestamp"),
        F.sum(F.when(sold, F.col("n_items"))).alias("frequency"),
        F.sum(F.when(sold, F.col("amount"))).alias("amount"),
        F.sum("points").alias("points"), F.sum("scored").alias("scored"),
        F.sum("n_reviews").alias("review_count"), F.sum("n_negative").alias("n_negative"),
        F.sum(F.when(known, F.col("n_categories"))).alias("unique_categories"),
        _mean_days(known).alias("avg_delivery_time"),
        F.sum(F.when(known, F.col("n_sellers"))).alias("unique_sellers"),
    ).where(F.col("order_purchase_timestamp").isNotNull())
    reviewed = F.col("review_count").isNotNull()
    return per_customer.join(customers.select("customer_id"), "customer_id").select(
        "customer_id", "order_purchase_timestamp",
        whole_days(F.col("order_purchase_timestamp"), _newest_delivered(orders)).alias("recency_days"),
        "frequency", whole_amount(F.col("amount")).alias("monetary"),
        F.try_divide("points", "scored").cast("bigint").alias("avg_review_score"), "review_count",
        F.when(reviewed, F.when(F.col("n_negative") > 0, 1).otherwise(0)).cast("bigint").alias("has_negative_flag"),
        "unique_categories", "avg_delivery_time", "unique_sellers")


def hybrid_features(features: DataFrame, cleaned_columns: dict[str, Column],
                    restore: Sequence[str] = (*FLAG_COLUMNS, *COUNT_COLUMNS)) -> DataFrame:
    """Outlier-free continuous features beside untouched flags and counts.

    ``cleaned_columns`` maps a column to its expression with outliers set to NULL; the restored
    columns keep their own values, so no join back to the original is needed.
    """
    return features.select([
        cleaned_columns[c].alias(c) if c in cleaned_columns and c not in restore else col(c)
        for c in features.columns
    ])


def last_purchase_dates(orders: DataFrame) -> DataFrame:
    """Newest order of each customer, whatever its status."""
    return orders.groupBy("customer_id").agg(F.max("order_purchase_timestamp").alias("order_purchase_timestamp"))


def with_last_purchase(features: DataFrame, orders: DataFrame) -> DataFrame:
    """Features with the date of the customer's newest order attached."""
    return features.drop("order_purchase_timestamp").join(last_purchase_dates(orders), "customer_id", "left")
