from datetime import datetime

import pytest

from shoplens.operators import features, kpi, kpi_tables


def table(spark, columns, *rows):
    values = ", ".join(rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


ORDER = "order_id, customer_id, order_status, order_purchase_timestamp, order_estimated_delivery_date, order_delivered_customer_date"


def ts(text):
    return f"timestamp_ntz'{text}'"


def order(i, customer, status, bought, estimated=None, delivered=None):
    def value(t):
        return ts(t) if t else "CAST(NULL AS TIMESTAMP_NTZ)"
    return f"({i}L, {customer}L, '{status}', {ts(bought)}, {value(estimated)}, {value(delivered)})"


def test_late_limit_is_inclusive_at_midnight(spark):
    orders = table(
        spark, ORDER,
        order(1, 1, "delivered", "2018-08-01 00:00:00", "2018-08-10 12:00:00", "2018-08-13 00:00:00"),
        order(2, 1, "delivered", "2018-08-01 00:00:00", "2018-08-10 12:00:00", "2018-08-12 23:59:59"),
        order(3, 1, "canceled", "2018-12-01 00:00:00", "2018-08-10 12:00:00", "2018-08-20 00:00:00"),
        order(4, 1, "shipped", "2018-08-01 00:00:00", "2018-08-10 12:00:00"),
        order(5, 1, "delivered", "2018-05-01 00:00:00", "2018-05-10 12:00:00", "2018-06-13 00:00:00"),
        order(6, 1, "delivered", "2018-04-30 23:59:59", "2018-05-10 12:00:00", "2018-06-13 00:00:00"))
    assert sorted(r["order_id"] for r in kpi.late_deliveries(orders).collect()) == [1, 5]
    assert sorted(r["order_id"] for r in kpi.recent_deliveries(orders, 3).collect()) == [1, 2, 5]


def test_revenue_is_truncated_before_the_threshold(spark):
    orders = table(spark, ORDER, order(1, 1, "delivered", "2018-08-01 00:00:00"), order(2, 1, "shipped", "2018-08-01 00:00:00"))
    items = table(spark, "order_id, product_id, seller_id, price, freight_value",
                  "(1L, 1L, 10L, 100000.0D, 0.99D)", "(1L, 1L, 11L, 100000.0D, 1.0D)", "(2L, 1L, 10L, 900000.0D, 1.0D)")
    sellers = table(spark, "seller_id", "(10L)", "(11L)", "(12L)")
    assert [tuple(r) for r in kpi.high_revenue_sellers(sellers, items, orders).collect()] == [(11, 100001)]


def test_new_sellers_count_orders_once_and_items_each(spark):
    orders = table(spark, ORDER, order(1, 1, "delivered", "2018-08-01 00:00:00"), order(2, 1, "canceled", "2018-08-05 00:00:00"),
                   order(3, 1, "delivered", "2017-01-05 00:00:00"))
    items = table(spark, "order_id, product_id, seller_id", "(1L, 1L, 10L)", "(1L, 2L, 10L)", "(2L, 1L, 10L)", "(3L, 1L, 11L)",
                  "(3L, 1L, 11L)", "(3L, 2L, 11L)")
    sellers = table(spark, "seller_id", "(10L)", "(11L)")
    rows = kpi.new_engaged_sellers(sellers, items, orders, 3, 2).collect()
    assert [(r["seller_id"], r["total_orders"], r["total_products"]) for r in rows] == [(10, 2, 3)]


def test_postcode_scores(spark):
    orders = table(spark, ORDER, order(1, 1, "delivered", "2018-08-01 00:00:00"), order(2, 2, "shipped", "2018-08-05 00:00:00"))
    customers = table(spark, "customer_id, customer_zip_code_prefix", "(1L, '01001')", "(2L, '20000')")
    reviews = table(spark, "review_id, order_id, review_score, review_creation_date",
                    f"(1L, 1L, 5, {ts('2018-08-09 00:00:00')})", f"(2L, 1L, 4, {ts('2018-08-09 00:00:00')})",
                    f"(3L, 1L, 4, {ts('2018-08-09 00:00:00')})", f"(4L, 2L, 1, {ts('2018-08-09 00:00:00')})",
                    f"(5L, 2L, 5, {ts('2017-08-04 23:00:00')})")
    rows = [tuple(r) for r in kpi.postcode_scores(customers, orders, reviews).collect()]
    assert rows == [("20000", 1, 1.0), ("01001", 3, 4.33)]
    assert kpi.worst_postcodes(customers, orders, reviews, min_reviews=2).count() == 1


def test_delay_categories(spark):
    days = table(spark, "d", *[f"({d})" for d in (2, 3, 4, 5, 7, 8, 10, 11)])
    assert [r[0] for r in days.select(kpi_tables.delay_category(days.d)).collect()] == [
        "No Delay", "3-4 days", "3-4 days", "4-5 days", "5-7 days", "7-10 days", "7-10 days", "10+ days"]


def test_top_sellers(spark):
    sellers = table(spark, "seller_id, total_revenue", "('abcdefghijk', 5L)", "('b', 9L)", "('c', 1L)")
    rows = kpi_tables.top_sellers(sellers, 2).collect()
    assert [r["seller_id_short"] for r in rows] == ["b...", "abcdefgh..."]
    with pytest.raises(ValueError):
        kpi_tables.top_sellers(sellers.limit(0))
    with pytest.raises(ValueError):
        kpi_tables.top_sellers(sellers.drop("total_revenue"))


def test_coordinates_fall_back_to_region(spark):
    zips = table(spark, "customer_zip_code_prefix", "('01001')", "('10000')", "('99999')", "('1001')", "('x')")
    found = {r[0]: (r["latitude"], r["longitude"]) for r in kpi_tables.with_coordinates(zips).collect()}
    assert found["01001"] == found["1001"] == kpi_tables.AREA_COORDINATES["01"]
    assert found["10000"] == kpi_tables.REGION_COORDINATES["1"] and found["99999"] == kpi_tables.REGION_COORDINATES["9"]
    assert len(kpi_tables.AREA_COORDINATES) == 75 and len(kpi_tables.REGION_COORDINATES) == 10
    given = {"01": (-23.55, -46.63), "20": (-22.90, -43.20), "30": (-19.92, -43.94), "40": (-12.97, -38.50), "70": (-15.78, -47.93)}
    assert {k: kpi_tables.AREA_COORDINATES[k] for k in given} == given


def test_satisfaction_truncates_and_flags(spark):
    orders = table(spark, "order_id, customer_id", "(1L, 1L)", "(2L, 2L)")
    reviews = table(spark, "review_id, order_id, review_score", "(1L, 1L, 4)", "(2L, 1L, 5)", "(3L, 2L, 2)", "(4L, 2L, 5)")
    rows = {r["customer_id"]: tuple(r)[1:] for r in features.satisfaction_features(orders, reviews).collect()}
    assert rows == {1: (4, 2, 0), 2: (3, 2, 1)}


def test_frequency_counts_items_or_orders(spark):
    orders = table(spark, ORDER, order(1, 1, "delivered", "2018-08-01 00:00:00", None, "2018-08-03 12:00:00"))
    items = table(spark, "order_id, product_id, seller_id, price, freight_value", *["(1L, 1L, 1L, 1.0D, 0.5D)"] * 3)
    customers = table(spark, "customer_id", "(1L)")
    assert features.rfm_features(customers, orders, items).first()["frequency"] == 3
    assert features.rfm_features(customers, orders, items, distinct=True).first()["frequency"] == 1
    products = table(spark, "product_id, product_category_name", "(1L, 'a')")
    assert tuple(features.behavior_features(orders, items, products).first()) == (1, 3, 2.0, 3)
    assert tuple(features.behavior_features(orders, items, products, distinct=True).first()) == (1, 1, 2.0, 1)


def test_one_pass_features_equal_the_joined_tables(spark):
    from shoplens.sources.marketplace import load_marketplace

    m = load_marketplace(spark, "/root/testdata/sf0.001")
    joined = features.combine_features(
        features.rfm_features(m.customers, m.orders, m.items), features.satisfaction_features(m.orders, m.reviews),
        features.behavior_features(m.orders, m.items, m.products))
    fused = features.customer_features(m.customers, m.orders, m.items, m.products, m.reviews).select(joined.columns)
    assert fused.count() == joined.count() > 100
    assert fused.exceptAll(joined).count() == 0


def test_one_pass_features_with_orphans_and_a_hot_order(spark):
    orders = table(
        spark, ORDER, order(1, 1, "delivered", "2018-08-01 00:00:00", None, "2018-08-03 12:00:00"),
        order(2, 2, "delivered", "2018-08-02 00:00:00"), order(3, 3, "shipped", "2018-08-02 00:00:00"),
        order(4, 9, "delivered", "2018-08-09 00:00:00"), order(5, 1, "delivered", "2018-07-01 00:00:00"))
    items = table(spark, "order_id, product_id, seller_id, price, freight_value",
                  *["(1L, 1L, 1L, 1.0D, 0.5D)"] * 200, "(2L, 77L, 1L, 2.0D, 0.0D)", "(3L, 1L, 1L, 1.0D, 0.0D)",
                  "(4L, 1L, 1L, 1.0D, 0.0D)")
    customers = table(spark, "customer_id", "(1L)", "(2L)", "(3L)")
    products = table(spark, "product_id, product_category_name", "(1L, CAST(NULL AS STRING))")
    reviews = table(spark, "review_id, order_id, review_score", "(1L, 3L, 1)", "(2L, 1L, 5)")
    joined = features.combine_features(
        features.rfm_features(customers, orders, items), features.satisfaction_features(orders, reviews),
        features.behavior_features(orders, items, products))
    fused = features.customer_features(customers, orders, items, products, reviews).select(joined.columns)
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, joined.collect()))
    assert fused.count() == 2


def test_new_engaged_sellers_repeated_and_missing_keys(spark, monkeypatch):
    """Orders that repeat or lack a key count as in a plain join; a task holds a bounded number of items."""
    orders = spark.createDataFrame(
        [(1, datetime(2020, 1, 5)), (1, datetime(2020, 2, 5)), (2, None), (None, datetime(2020, 3, 1))],
        "order_id int, order_purchase_timestamp timestamp")
    items = spark.createDataFrame(
        [(1, 7, 9), (1, 8, 9), (1, None, 9), (2, 7, 9), (None, 7, 9), (2, 7, 5), (1, 7, None)],
        "order_id int, product_id int, seller_id int")
    sellers = spark.createDataFrame([(9,), (9,), (5,)], "seller_id int")
    monkeypatch.setattr(kpi, "ITEMS_PER_TASK", 2)
    found = kpi.new_engaged_sellers(sellers, items, orders, months=3, min_products=0)
    assert [tuple(r) for r in found.collect()] == [(9, datetime(2020, 1, 5), 2, 5)] * 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "RepartitionByExpression [order_id" in plan
