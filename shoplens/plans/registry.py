"""The registered queries: name to function of (session, data folder)."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.frames import round_doubles, small_table
from shoplens.functions.quantiles import quantiles_by_feature
from shoplens.operators import features as feat
from shoplens.operators import clustering, kpi, kpi_tables, outliers, profiling, scaling, segments, silhouettes, stability
from shoplens.operators.components import fit_components
from shoplens.plans.workspace import CLUSTERS, START_COLUMN, Workspace, workspace
from shoplens.sources import catalog

CONTINUOUS = ("recency_days", "monetary", "avg_review_score", "avg_delivery_time")

PLOT_COMPONENTS = ("pc1", "pc2", "pc3")

# Thresholds that split the test customers, whose orders are larger and older than shop orders.
SEGMENT_CONFIG = {
    "recency": {"active": 150, "recent": 400},
    "frequency": {"frequent": 14, "returning": 9},
    "monetary": {"high_value": "mean"},
    "satisfaction": {"very_satisfied": 3.2, "satisfied": 3.0, "neutral": 2.8},
}
ACTION_LIMITS = {
    "recent_days": 150, "inactive_days": 400, "high_value": 40_000, "low_value": 450_000, "frequent_orders": 12,
    "low_score": 2.8, "high_score": 3.2,
}

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Callable[[Workspace], DataFrame]] = {}


def query(build: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    """Register a query under its function name. Doubles are rounded to four decimals."""
    _QUERIES[build.__name__] = build
    return build


def _runner(build: Callable[[Workspace], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return round_doubles(build(workspace(spark, folder)))
    run.__name__, run.__doc__ = build.__name__, build.__doc__
    return run


def registered_queries() -> dict[str, Query]:
    return {name: _runner(build) for name, build in _QUERIES.items()}


# --- sources -------------------------------------------------------------------------------------


@query
def table_inventory(w):
    return catalog.inventory({name: w.table(name) for name in catalog.TABLES})


@query
def scan_orders(w):
    return w.table("orders")


@query
def table_preview(w):
    return catalog.preview(w.table("orders"), "o_orderkey")


@query
def sql_text_query(w):
    catalog.register_views(w.spark, w.folder, ["orders"])
    return catalog.run_sql(w.spark, """
        SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, round(avg(o_totalprice), 2) AS mean_price
        FROM orders GROUP BY o_orderstatus, o_orderpriority""")


@query
def materialized_result(w):
    m = w.market
    return w.stored("seller revenue", lambda: kpi.high_revenue_sellers(m.sellers, m.items, m.orders, 0), threshold=0)


@query
def cached_sql_query(w):
    """The second call of a key returns what the first one kept."""
    catalog.register_views(w.spark, w.folder, ["lineitem"])
    text = """SELECT l_returnflag, l_linestatus, count(*) AS n_items, round(sum(l_quantity), 2) AS quantity
              FROM lineitem GROUP BY l_returnflag, l_linestatus"""
    catalog.run_sql(w.spark, text, w.store, "items by flag", folder=w.folder)
    return catalog.run_sql(w.spark, text, w.store, "items by flag", folder=w.folder)


@query
def cached_table(w):
    return catalog.scan(w.spark, w.folder, "nation", w.store)


# --- KPIs ----------------------------------------------------------------------------------------


@query
def late_deliveries(w):
    return kpi.late_deliveries(w.market.orders)


@query
def recent_deliveries(w):
    return kpi.recent_deliveries(w.market.orders)


@query
def high_revenue_sellers(w):
    m = w.market
    return kpi.high_revenue_sellers(m.sellers, m.items, m.orders, threshold=10_500_000)


@query
def new_engaged_sellers(w):
    m = w.market
    # Parts act as sellers: with so few suppliers every one of them sold early.
    sellers = m.products.selectExpr("product_id AS seller_id")
    items = m.items.selectExpr("order_id", "product_id", "product_id AS seller_id")
    return kpi.new_engaged_sellers(sellers, items, m.orders, months=78, min_products=30)


@query
def worst_postcodes(w):
    m = w.market
    return kpi.worst_postcodes(m.customers, m.orders, m.reviews)


@query
def postcode_scores(w):
    m = w.market
    return kpi.postcode_scores(m.customers, m.orders, m.reviews)


@query
def late_delivery_by_month(w):
    return kpi_tables.late_delivery_by_month(kpi.recent_deliveries(w.market.orders))


@query
def top_sellers(w):
    m = w.market
    return kpi_tables.top_sellers(kpi.high_revenue_sellers(m.sellers, m.items, m.orders, 0))


@query
def postcode_coordinates(w):
    return kpi_tables.with_coordinates(w.market.customers.select("customer_zip_code_prefix").distinct())


@query
def postcode_review_map(w):
    m = w.market
    return kpi_tables.with_coordinates(kpi.postcode_scores(m.customers, m.orders, m.reviews))


# --- features ------------------------------------------------------------------------------------


@query
def rfm_features(w):
    m = w.market
    return feat.rfm_features(m.customers, m.orders, m.items)


@query
def satisfaction_features(w):
    return feat.satisfaction_features(w.market.orders, w.market.reviews)


@query
def behavior_features(w):
    m = w.market
    return feat.behavior_features(m.orders, m.items, m.products)


@query
def combined_features(w):
    m = w.market
    return feat.customer_features(m.customers, m.orders, m.items, m.products, m.reviews)


@query
def hybrid_features(w):
    return w.hybrid


@query
def features_with_dates(w):
    return feat.with_last_purchase(w.hybrid, w.market.orders)


# --- profiling -----------------------------------------------------------------------------------


@query
def feature_histograms(w):
    return profiling.feature_histograms(w.features, feat.FEATURE_COLUMNS)


@query
def correlation_matrix(w):
    return profiling.correlation_matrix(w.hybrid, feat.FEATURE_COLUMNS).drop("x_position", "y_position")


@query
def correlation_lower_triangle(w):
    return profiling.lower_triangle(profiling.correlation_matrix(w.hybrid, feat.FEATURE_COLUMNS))


@query
def feature_box_stats(w):
    return profiling.box_statistics(w.features, feat.FEATURE_COLUMNS)


@query
def column_summary(w):
    return profiling.column_summary(
        outliers.without_outliers(w.features, w.limits), feat.FEATURE_COLUMNS, use_log_scale=True)


@query
def density_histogram(w):
    return profiling.density_histogram(outliers.without_outliers(w.features, w.limits), feat.FEATURE_COLUMNS)


# --- outliers ------------------------------------------------------------------------------------


def _rule(w, method):
    return outliers.outlier_rule_table(w.features, feat.FEATURE_COLUMNS, method)


@query
def outliers_z3(w):
    return _rule(w, outliers.Z3)


@query
def outliers_iqr(w):
    return _rule(w, outliers.IQR)


@query
def outliers_z2(w):
    return _rule(w, outliers.Z2)


@query
def outliers_q01_q99(w):
    return _rule(w, outliers.Q01_Q99)


@query
def outliers_q05_q95(w):
    return _rule(w, outliers.Q05_Q95)


@query
def outliers_full_range(w):
    return _rule(w, outliers.FULL_RANGE)


@query
def outlier_summary_all_methods(w):
    return outliers.outlier_summary(w.features, feat.FEATURE_COLUMNS)


@query
def outlier_cleaned(w):
    return outliers.without_outliers(w.features, w.limits)


@query
def outlier_method_comparison(w):
    return outliers.method_comparison(w.features, "monetary")


# --- scaling -------------------------------------------------------------------------------------


def _features_with_segment(w):
    segment = w.table("customer").selectExpr("c_custkey AS customer_id", "c_mktsegment")
    return w.hybrid.join(segment, "customer_id")


@query
def column_roles(w):
    roles = scaling.detect_roles(_features_with_segment(w).drop("order_purchase_timestamp"))
    schema = pa.schema([("feature", pa.string()), ("role", pa.string())])
    return small_table(w.spark, [{"feature": c, "role": r} for c, r in roles.items()], schema)


@query
def impute_mode(w):
    columns = (*feat.FLAG_COLUMNS, "avg_review_score")
    return w.hybrid.select("customer_id", *[
        F.coalesce(F.col(c), F.lit(scaling.learn_mode(w.hybrid, c))).alias(c) for c in columns])


@query
def one_hot(w):
    df = _features_with_segment(w)
    out = []
    for c in (*feat.FLAG_COLUMNS, "c_mktsegment"):
        values, most = scaling.learn_categories(df, c), scaling.learn_mode(df, c)
        hot = scaling.one_hot(F.coalesce(F.col(c), F.lit(most)), values)
        out += [h.alias(scaling.category_name(c, v)) for v, h in zip(values, hot)]
    return df.select("customer_id", *out)


@query
def impute_median(w):
    columns = (*feat.COUNT_COLUMNS, *CONTINUOUS)
    medians = quantiles_by_feature(w.hybrid, columns, [0.5])
    return w.hybrid.select("customer_id", *[F.coalesce(F.col(c), F.lit(medians[c][0])).alias(c) for c in columns])


@query
def log1p_counts(w):
    return w.hybrid.select("customer_id", *[F.log1p(F.col(c)).alias(c) for c in feat.COUNT_COLUMNS])


@query
def robust_scale(w):
    model = scaling.fit_scaler(w.hybrid.select("customer_id", *CONTINUOUS), (), ())
    return model.transform(w.hybrid)


@query
def time_features(w):
    parts = scaling.time_parts(F.col("ts"))
    return w.table("events").select("event_id", *[e.alias(f"ts_{name}") for name, e in parts.items()])


@query
def transform_features(w):
    return w.scaled


@query
def transform_new_data(w):
    """Learned on customers who left before the last year, applied to every customer."""
    past = w.hybrid.where("order_purchase_timestamp < timestamp_ntz'2001-01-01'").drop("order_purchase_timestamp")
    return scaling.fit_scaler(past, feat.FLAG_COLUMNS, feat.COUNT_COLUMNS).transform(w.hybrid)


@query
def inverse_transform(w):
    return w.scaler.inverse_transform(w.scaled)


# --- components and clusters ---------------------------------------------------------------------


@query
def covariance_matrix(w):
    return profiling.covariance_matrix(w.scaled, w.scaled_columns)


@query
def pca_projection(w):
    return w.component_scores


@query
def pca_explained_variance(w):
    return fit_components(w.scaled, w.scaled_columns, 15).explained_variance(w.spark)


@query
def pca_top_loadings(w):
    return w.components.top_loadings(w.spark, 5)


@query
def pca_feature_importance(w):
    return w.components.feature_importance(w.spark, 4)


@query
def kmeans_fit(w):
    """Labels from the first three components, as the segments are drawn."""
    fit = clustering.fit_kmeans(w.component_scores, PLOT_COMPONENTS, CLUSTERS)
    return fit.centers.assign(w.component_scores, ["customer_id"])


@query
def assign_to_centroids(w):
    return w.centers.assign(w.scaled, ["customer_id"])


@query
def kmeans_lloyd_fixed(w):
    return w.centers.frame(w.spark)


@query
def elbow_table(w):
    return clustering.elbow_table(w.component_scores, w.components.names)


@query
def inertia_by_k(w):
    return clustering.inertia_by_k(w.scaled, w.scaled_columns, range(2, 7), START_COLUMN)


@query
def silhouette_samples(w):
    return silhouettes.silhouette_samples(w.labelled, w.scaled_columns)


@query
def silhouette_euclidean_sample(w):
    """Every customer against a sample of 1000."""
    reference = silhouettes.stratified_sample(w.labelled, 1000)
    return silhouettes.euclidean_silhouettes(w.labelled, w.scaled_columns, reference=reference)


@query
def silhouette_report(w):
    return silhouettes.silhouette_report(w.labelled, w.scaled_columns)


@query
def silhouette_order(w):
    return silhouettes.silhouette_order(w.labelled, w.scaled_columns)


@query
def stratified_sample(w):
    return silhouettes.stratified_sample(w.labelled, 1000).select("customer_id", "cluster")


@query
def kmeans_feature_importance(w):
    """Importance under a model fitted on the scaled features."""
    return clustering.permutation_importance(w.scaled, w.fitted.centers)


@query
def importance_fixed_centers(w):
    """Permutation importance under the fixed-start centres, whose shuffles SQL can repeat."""
    return clustering.permutation_importance(w.scaled, w.centers)


@query
def intercluster_distances(w):
    return clustering.intercluster_distances(w.labelled, w.centers)


@query
def cluster_projection(w):
    """Position on the first three components beside the fitted cluster."""
    return w.component_scores.select("customer_id", *PLOT_COMPONENTS).join(
        w.fitted.centers.assign(w.scaled).select("customer_id", "cluster", clustering.cluster_label(F.col("cluster")).alias("name")),
        "customer_id")


# --- stability -----------------------------------------------------------------------------------


@query
def bootstrap_samples(w):
    return stability.bootstrap_samples(w.scaled)


@query
def adjusted_rand_index(w):
    """Agreement of the clusters with the monetary quartiles they started from."""
    cuts = quantiles_by_feature(w.scaled, [START_COLUMN], [i / CLUSTERS for i in range(1, CLUSTERS)])[START_COLUMN]
    start = sum(F.when(F.col(START_COLUMN) > c, 1).otherwise(0) for c in cuts)
    return stability.adjusted_rand_index(w.labelled.withColumn("start", start), "start", "cluster")


@query
def bootstrap_stability(w):
    return stability.bootstrap_stability(w.scaled, w.scaled_columns, CLUSTERS)


@query
def bootstrap_stability_summary(w):
    return stability.ari_summary(stability.bootstrap_stability(w.scaled, w.scaled_columns, CLUSTERS))


@query
def pairwise_ari(w):
    labels = stability.labelled_samples(w.scaled, w.sample_centers, "customer_id", 0.8)
    return stability.pairwise_ari(labels, len(w.sample_centers))


@query
def period_buckets(w):
    orders = w.market.orders.select("order_id", "order_purchase_timestamp")
    df = orders
    for period in ("month", "quarter", "year"):
        df = stability.period_buckets(df, period).withColumnsRenamed(
            {"period": period, "period_start": f"{period}_start"})
    return df.drop("order_purchase_timestamp")


@query
def period_customer_counts(w):
    return stability.period_customer_counts(w.last_dates, "quarter", 5 * CLUSTERS)


def _temporal(w) -> stability.StabilityResult:
    return stability.temporal_stability(w.scaled, w.order_dates, w.scaled_columns, CLUSTERS, "year",
                                        keep=lambda name, build: w.stored(name, build, dates="order_dates"))


def _cross_period(w) -> stability.StabilityResult:
    return stability.cross_period_stability(w.scaled, w.last_dates, w.scaled_columns, CLUSTERS, "quarter", minimum=10,
                                            keep=lambda name, build: w.stored(name, build, dates="last_dates"))


@query
def temporal_stability(w):
    return _temporal(w).scores


@query
def temporal_stability_summary(w):
    return _temporal(w).summary()


@query
def temporal_ari(w):
    """Agreement of consecutive years under fixed-start centres."""
    labels = w.period_centers(w.yearly).assign(w.yearly.rows, ["period", "customer_id"])
    return stability.consecutive_ari(stability.transition_cells(labels, w.yearly.kept), 5 * CLUSTERS)


@query
def cluster_migration(w):
    labels = w.period_centers(w.yearly).assign(w.yearly.rows, ["period", "customer_id"])
    return stability.migration_matrices(stability.transition_cells(labels, w.yearly.kept), CLUSTERS)


@query
def cross_period_stability(w):
    return _cross_period(w).scores


@query
def cross_period_stability_summary(w):
    return _cross_period(w).summary()


@query
def cross_period_ari(w):
    _, sample = stability.evaluation_rows(w.quarterly, w.scaled_columns)
    return stability.cross_period_scores(sample, w.period_centers(w.quarterly).by_group)


# --- segments ------------------------------------------------------------------------------------


@query
def cluster_stats(w):
    return segments.cluster_statistics(w.labelled, w.scaled_columns)


@query
def cluster_categorical_mode(w):
    segment = w.table("customer").selectExpr("c_custkey AS customer_id", "c_mktsegment")
    return segments.categorical_modes(w.labelled.join(segment, "customer_id"), ["c_mktsegment"])


@query
def cluster_sizes(w):
    return segments.cluster_sizes(w.labelled)


@query
def segment_names(w):
    name = segments.segment_name(w.profile, SEGMENT_CONFIG)
    full = segments.segment_name(w.profile, SEGMENT_CONFIG, max_parts=4)
    return w.profile.select("cluster", name.alias("name"), full.alias("full_name"))


@query
def cluster_profiles(w):
    return segments.cluster_profiles(w.profile, SEGMENT_CONFIG)


@query
def cluster_insights(w):
    return segments.cluster_insights(w.profile, SEGMENT_CONFIG)


@query
def cluster_metrics_table(w):
    return segments.metrics_table(w.profile, SEGMENT_CONFIG)


@query
def cluster_radar(w):
    top = [r["feature"] for r in profiling.top_variance_features(w.scaled, w.scaled_columns).collect()]
    return segments.radar_table(w.labelled, top)


@query
def top_variance_features(w):
    return profiling.top_variance_features(w.scaled, w.scaled_columns)


@query
def cluster_feature_box_stats(w):
    return segments.feature_distributions(w.labelled, w.scaled_columns, w.hybrid)


@query
def segment_actions(w):
    return segments.segment_actions(w.profile, SEGMENT_CONFIG, ACTION_LIMITS)


@query
def segment_characteristics(w):
    return segments.segment_characteristics(w.profile, SEGMENT_CONFIG, ACTION_LIMITS)


# --- segments of the fitted model ----------------------------------------------------------------


@query
def fitted_cluster_stats(w):
    return segments.cluster_statistics(w.fitted_labels, w.scaled_columns)


@query
def fitted_segment_profiles(w):
    return segments.cluster_profiles(w.fitted_profile, SEGMENT_CONFIG)


@query
def fitted_segment_actions(w):
    return segments.segment_actions(w.fitted_profile, SEGMENT_CONFIG, ACTION_LIMITS)


def _dashboard_part(name):
    def part(w):
        w.segment_config = SEGMENT_CONFIG
        return w.dashboard[name]
    part.__name__, part.__doc__ = f"dashboard_{name}", f"The part {name} of the dashboard of the fitted segments."
    return query(part)


for _name in ("cluster_sizes", "feature_comparison", "metrics_table", "feature_distributions"):
    _dashboard_part(_name)


# --- columns found by type -----------------------------------------------------------------------


@query
def summary_of_numeric_columns(w):
    """All numeric columns of the features, none named by the caller."""
    return profiling.column_summary(w.hybrid)


@query
def correlation_of_numeric_columns(w):
    return profiling.correlation_matrix(w.hybrid).drop("x_position", "y_position")


@query
def outliers_of_numeric_columns(w):
    return outliers.outlier_summary(w.hybrid, methods=[outliers.IQR]).select("feature", "outlier_count", "below_min", "above_max")
