import copy

import pyarrow as pa
import pytest

from shoplens.functions.frames import small_table
from shoplens.operators import scaling, segments

CONFIG = copy.deepcopy(segments.DEFAULT_CONFIG)
CONFIG["monetary"]["high_value"] = 150


def profile(spark, **values):
    row = {"cluster": 0, "size": 10, "share": 0.25, **values}
    kinds = {"cluster": pa.int32(), "size": pa.int64()}
    return small_table(spark, [row], pa.schema([(n, kinds.get(n, pa.float64())) for n in row]))


def rfm(spark, recency, frequency, monetary, **more):
    return profile(spark, recency_days=recency, frequency=frequency, monetary=monetary,
                   all_recency_days=50.0, all_frequency=3.0, all_monetary=180.0, **more)


def only(df, expr):
    return df.select(expr.alias("v")).first()["v"]


def test_names(spark):
    p = rfm(spark, 10.0, 4.0, 200.0, avg_review_score=4.6, all_avg_review_score=4.0)
    assert only(p, segments.segment_name(p, CONFIG)) == "Active Frequent High-value"
    assert only(p, segments.segment_name(p, CONFIG, 4)) == "Active Frequent High-value Very Satisfied"
    p = rfm(spark, 30.0, 1.5, 150.0)
    assert only(p, segments.segment_name(p, CONFIG)) == "Recent One-time Standard-value"
    assert only(p, segments.segment_name(p)) == "Recent One-time Standard-value"
    p = rfm(spark, 90.0, 3.0, 181.0)
    assert only(p, segments.segment_name(p)) == "Inactive Returning High-value"
    p = profile(spark, avg_review_score=3.0)
    assert only(p, segments.segment_name(p)) == "Neutral"
    p = profile(spark, other=1.0)
    assert only(p, segments.segment_name(p)) == "Cluster 0"


def test_insights(spark):
    p = rfm(spark, 10.0, 4.0, 200.0, avg_review_score=2.0, all_avg_review_score=4.0)
    assert [i.split()[0] for i in only(p, segments.insight_list(p))] == ["Recently", "High-value", "Below"]
    p = rfm(spark, 100.0, 2.0, 200.0)
    assert [i.split()[0] for i in only(p, segments.insight_list(p))] == ["Inactive", "Big"]
    p = rfm(spark, 50.0, 3.0, 180.0)
    assert only(p, segments.insight_list(p)) == ["Cluster 0 represents 25.0% of customers."]


def test_actions_are_padded_and_cut(spark):
    p = rfm(spark, 10.0, 3.0, 200.0)
    assert only(p, segments.action_list(p)) == [
        "Upsell premium products/services", "Offer loyalty rewards", "Cross-sell complementary products"]
    p = rfm(spark, 50.0, 1.0, 50.0)
    assert only(p, segments.action_list(p))[-1] == "Monitor segment performance monthly"
    p = profile(spark, avg_review_score=4.0)
    assert only(p, segments.action_list(p)) == ["Monitor segment performance monthly"]


def test_characteristics_use_rounded_numbers(spark):
    p = rfm(spark, 29.6, 2.04, 400.0)
    assert only(p, segments.characteristic_text(p)) == "High spender"
    p = rfm(spark, 29.4, 2.06, 100.0, avg_review_score=3.4, all_avg_review_score=3.0)
    assert only(p, segments.characteristic_text(p)) == "Recently active, Frequent buyer, Unsatisfied"
    p = rfm(spark, 50.0, 1.0, 100.0)
    assert only(p, segments.characteristic_text(p)) == "25.0% of customer base"


def test_metrics_table_text(spark):
    p = rfm(spark, 29.6, 0.5, 400.0, avg_delivery_time=8.25, all_avg_delivery_time=8.0)
    r = segments.metrics_table(p).first()
    assert (r["average_order_value"], r["days_since_last_purchase"], r["average_delivery_time"], r["percentage"]) == (
        "$400.00", "30", "8.3 days", "25.0%")
    assert "satisfaction_score" not in r.asDict()


def labelled(spark):
    rows = [(i, i % 2, float(i), float(i % 3), float(i * i), 1.0 - i % 2, float(i % 2)) for i in range(12)]
    return spark.createDataFrame(
        rows, "customer_id long, cluster int, recency_days double, frequency double, monetary double, "
              "`has_negative_flag_0.0` double, `has_negative_flag_1.0` double")


NAMES = ["recency_days", "frequency", "monetary", "has_negative_flag_0.0", "has_negative_flag_1.0"]


def test_statistics_and_sizes(spark):
    df = labelled(spark)
    stats = {(r["cluster"], r["feature"]): r for r in segments.cluster_statistics(df, NAMES).collect()}
    assert (stats[0, "recency_days"]["mean"], stats[0, "recency_days"]["median"], stats[0, "recency_days"]["max"]) == (5, 5, 10)
    sizes = segments.cluster_sizes(df).collect()
    assert sum(r["size"] for r in sizes) == 12 and sum(r["percentage"] for r in sizes) == 100
    modes = spark.createDataFrame([(0, "b"), (0, "a"), (0, None), (1, None)], "cluster int, kind string")
    assert [tuple(r) for r in segments.categorical_modes(modes, ["kind"]).collect()] == [(0, "kind", "a", 1 / 3)]


def test_radar(spark):
    rows = {(r["cluster"], r["feature"]): r["value"] for r in segments.radar_table(labelled(spark), NAMES[:2]).collect()}
    assert rows[0, "recency_days"] == 0.0 and rows[1, "recency_days"] == 1.0
    assert rows[0, "frequency"] is None


def test_distributions(spark):
    df = labelled(spark)
    assert segments.distribution_features(NAMES, df.columns) == [*NAMES[:3], "has_negative_flag_1.0"]
    original = df.selectExpr("customer_id", "monetary * 10 AS monetary")
    rows = {(r["cluster"], r["feature"]): r for r in segments.feature_distributions(df, NAMES, original).collect()}
    assert len(rows) == 8 and rows[0, "monetary"]["whisker_high"] == 1000.0
    for bad in ("missing", ["missing"]):
        with pytest.raises(ValueError):
            segments.feature_distributions(df, bad)


def test_profile_is_inverted_from_the_means(spark):
    df = spark.createDataFrame([(1, 0.0, 1), (2, 8.0, 1), (3, 2.0, 3)], "customer_id long, monetary double, frequency long")
    model = scaling.fit_scaler(df, [], ["frequency"])
    data = model.transform(df).selectExpr("*", "CAST(customer_id > 2 AS INT) AS cluster")
    rows = {r["cluster"]: r for r in segments.profile_table(data, model.output_columns(), model).collect()}
    assert rows[0]["monetary"] == pytest.approx(4.0) and rows[0]["frequency"] == 1.0 and rows[0]["share"] == pytest.approx(2 / 3)
    assert rows[0]["all_monetary"] == rows[1]["all_monetary"] == pytest.approx(3.0)
    assert rows[1]["all_frequency"] == 2.0


def test_dashboard_isolates_failures(spark, monkeypatch):
    df = labelled(spark)
    parts = segments.segment_dashboard(df, NAMES)
    assert set(parts) == {"cluster_sizes", "feature_comparison", "metrics_table", "action_table", "feature_distributions"}
    assert all(part.count() > 0 for part in parts.values())
    assert "feature_comparison" not in segments.segment_dashboard(df, NAMES[:2])

    def broken(*_):
        raise RuntimeError("no radar")
    monkeypatch.setattr(segments, "radar_table", broken)
    parts = segments.segment_dashboard(df, NAMES)
    assert parts["feature_comparison"].first()["error"] == "RuntimeError: no radar"
    assert parts["metrics_table"].count() == 2
    assert "error" in segments.segment_dashboard(df.limit(0), NAMES)
