"""Segment profiles: statistics, names, insights, recommended actions and the tables that show them.

Everything after the per-cluster aggregates runs on one row per cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.frames import col, melt, require_columns, small_table
from shoplens.functions.quantiles import quantile_table
from shoplens.operators.clustering import cluster_label
from shoplens.operators.profiling import box_statistics, top_variance_features
from shoplens.operators.scaling import FeatureScaler

# Default thresholds of segment names. ``mean`` is the mean over the clusters.
DEFAULT_CONFIG = {
    "recency": {"active": 30, "recent": 90},
    "frequency": {"frequent": 3, "returning": 1.5},
    "monetary": {"high_value": "mean"},
    "satisfaction": {"very_satisfied": 4.5, "satisfied": 4.0, "neutral": 3.0},
}

# Thresholds of recommended actions and of key characteristics.
ACTION_LIMITS = {
    "recent_days": 30, "inactive_days": 90, "high_value": 150, "low_value": 100, "frequent_orders": 2,
    "low_score": 3.5, "high_score": 4.5,
}

# Texts of the insights.
INSIGHTS = {
    "recent": "Recently active customers - ideal for upselling opportunities.",
    "inactive": "Inactive customers - consider reactivation campaigns.",
    "loyal": "High-value loyal customers - prioritize retention strategies.",
    "big_spender": "Big spenders but infrequent - opportunity to increase purchase frequency.",
    "frequent_small": "Frequent small purchases - potential for basket size expansion.",
    "dissatisfied": "Below average satisfaction - investigate service/product issues.",
    "satisfied": "Highly satisfied customers - potential brand advocates.",
}

# Texts of the recommended actions.
ACTIONS = {
    "recent_high_value": ("Upsell premium products/services", "Offer loyalty rewards"),
    "inactive_high_value": ("Reactivation campaign with premium offer", "Personal outreach to understand churn reasons"),
    "frequent": ("Cross-sell complementary products", "Subscription or bundle offers"),
    "low_value": ("Product education to show value", "Limited-time discounts on premium alternatives"),
    "dissatisfied": ("Service recovery outreach", "Gather feedback on improvement areas"),
    "satisfied": ("Request referrals and testimonials", "Early access to new products/features"),
    "otherwise": ("Monitor segment performance monthly",),
}

# Texts of the key characteristics.
TRAITS = {
    "recent": "Recently active", "inactive": "Inactive", "high_spender": "High spender", "frequent": "Frequent buyer",
    "satisfied": "Very satisfied", "dissatisfied": "Unsatisfied",
}

FLAG_PREFIX = "has_negative_flag"
POSITIVE_FLAG = "has_negative_flag_1.0"


# --- statistics ----------------------------------------------------------------------------------


def cluster_statistics(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, minimum, maximum and deviation of every feature in every cluster."""
    value = F.col("value")
    moments = melt(labelled, columns, ["cluster"]).groupBy("cluster", "feature").agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.stddev_samp(value).alias("std"))
    medians = quantile_table(labelled, columns, [0.5], ["cluster"])
    return moments.join(medians, ["cluster", "feature"]).select(
        "cluster", "feature", "mean", F.col("quantiles")[0].alias("median"), "min", "max", "std")


def categorical_modes(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per cluster (the smallest on a tie) and its share of the cluster."""
    parts = [labelled.select("cluster", F.lit(c).alias("feature"), col(c).cast("string").alias("value")) for c in columns]
    counted = reduce(DataFrame.unionByName, parts).groupBy("cluster", "feature", "value").agg(F.count("*").alias("n"))
    known = F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("minus_n"), "value"))
    return (
        counted.groupBy("cluster", "feature").agg(F.min(known).alias("best"), F.sum("n").alias("size"))
        .where(F.col("best").isNotNull())
        .select("cluster", "feature", F.col("best.value").alias("mode"),
                (-F.col("best.minus_n") / F.col("size")).alias("frequency"))
    )


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    """Rows per cluster and their percentage."""
    everything = labelled.agg(F.count("*").alias("n")).scalar()
    return labelled.groupBy("cluster").agg(F.count("*").alias("size")).withColumn(
        "percentage", F.col("size") * 100 / everything)


def radar_table(labelled: DataFrame, features: Sequence[str], normalize: bool = True) -> DataFrame:
    """Cluster means, scaled to 0…1 over the clusters; NULL where all clusters are equal."""
    means = melt(labelled, features, ["cluster"]).groupBy("cluster", "feature").agg(F.avg("value").alias("value"))
    if not normalize:
        return means
    over = Window.partitionBy("feature")
    low, high = F.min("value").over(over), F.max("value").over(over)
    return means.select("cluster", "feature", F.try_divide(F.col("value") - low, high - low).alias("value"))


def distribution_features(features: Sequence[str], available: Sequence[str]) -> list[str]:
    """Features that exist, with several one-hot flag columns reduced to the positive one."""
    found = [f for f in features if f in available]
    flags = [f for f in found if f.startswith(FLAG_PREFIX)]
    if len(flags) > 1:
        found = [f for f in found if f not in flags] + [f for f in flags if f == POSITIVE_FLAG or POSITIVE_FLAG not in flags]
    if not found:
        raise ValueError("no valid features to describe")
    return found


def feature_distributions(labelled: DataFrame, features: Sequence[str] | str, original: DataFrame | None = None,
                          key: str = "customer_id") -> DataFrame:
    """Box statistics per cluster, in the original scale where the original frame has the feature."""
    if isinstance(features, str):
        require_columns(labelled, [features])
        features = [features]
    names = distribution_features(features, labelled.columns)
    restored = [] if original is None else [
        f for f in names if f in original.columns and not f.startswith(FLAG_PREFIX)]
    frame = labelled.select(key, "cluster", *[col(f) for f in names if f not in restored])
    if restored:
        frame = frame.join(original.select(key, *[col(f) for f in restored]), key)
    return box_statistics(frame, names, ["cluster"])


# --- profile -------------------------------------------------------------------------------------


def profile_table(labelled: DataFrame, columns: Sequence[str], scaler: FeatureScaler | None = None) -> DataFrame:
    """One row per cluster: ``size``, ``share``, the means in original scale and, as ``all_…``, the
    mean over the clusters. One aggregate over the data; the result is a local table."""
    spark = labelled.sparkSession
    rows = labelled.groupBy("cluster").agg(
        F.count("*").alias("size"), *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).collect()
    if not rows:
        raise ValueError("no clusters to profile")
    everything = sum(r["size"] for r in rows)
    table = [{"cluster": r["cluster"], **{c: r[f"m{i}"] for i, c in enumerate(columns)}} for r in rows]
    present = {c: [t[c] for t in table if t[c] is not None] for c in columns}
    table.append({"cluster": None, **{c: sum(v) / len(v) if v else None for c, v in present.items()}})
    means = small_table(spark, table, pa.schema([("cluster", pa.int32()), *[(c, pa.float64()) for c in columns]]))
    if scaler is not None:
        means = scaler.inverse_transform(means, ["cluster"])
    names = [c for c in means.columns if c != "cluster"]
    restored = {r["cluster"]: r.asDict() for r in means.collect()}
    overall = restored.pop(None)
    profile = [{"cluster": r["cluster"], "size": r["size"], "share": r["size"] / everything,
                **{c: restored[r["cluster"]][c] for c in names}, **{f"all_{c}": overall[c] for c in names}}
               for r in sorted(rows, key=lambda r: r["cluster"])]
    schema = pa.schema([("cluster", pa.int32()), ("size", pa.int64()), ("share", pa.float64()),
                        *[(f"{part}{c}", pa.float64()) for part in ("", "all_") for c in names]])
    return small_table(spark, profile, schema)


def _has(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def segment_name(profile: DataFrame, config: Mapping = DEFAULT_CONFIG, max_parts: int = 3) -> Column:
    """Name from recency, frequency, value and satisfaction classes, at most ``max_parts`` of them."""
    parts: list[Column] = []
    if _has(profile, "recency_days", "frequency", "monetary"):
        recency, frequency = config["recency"], config["frequency"]
        days, orders = F.col("recency_days"), F.col("frequency")
        limit = config["monetary"]["high_value"]
        high = F.col("all_monetary") if limit == "mean" else F.lit(limit)
        parts += [
            F.when(days < recency["active"], "Active").when(days < recency["recent"], "Recent").otherwise("Inactive"),
            F.when(orders > frequency["frequent"], "Frequent").when(orders > frequency["returning"], "Returning")
            .otherwise("One-time"),
            F.when(F.col("monetary") > high, "High-value").otherwise("Standard-value"),
        ]
    if _has(profile, "avg_review_score"):
        limits, score = config["satisfaction"], F.col("avg_review_score")
        parts.append(
            F.when(score >= limits["very_satisfied"], "Very Satisfied").when(score >= limits["satisfied"], "Satisfied")
            .when(score >= limits["neutral"], "Neutral").otherwise("Unsatisfied"))
    return F.concat_ws(" ", *parts[:max_parts]) if parts else cluster_label(F.col("cluster"))


def metric_columns(profile: DataFrame) -> dict[str, Column]:
    """Headline numbers in original scale; those whose features are absent are left out."""
    metrics = {}
    if _has(profile, "recency_days"):
        metrics["days_since_last_purchase"] = F.col("recency_days")
    if _has(profile, "frequency"):
        metrics["number_of_orders"] = F.col("frequency")
    if _has(profile, "monetary", "frequency"):
        metrics["average_order_value"] = F.col("monetary") / F.greatest(F.lit(1.0), F.col("frequency"))
        metrics["total_customer_value"] = F.col("monetary")
    if _has(profile, "avg_review_score"):
        metrics["satisfaction_score"] = F.col("avg_review_score")
    if _has(profile, "avg_delivery_time"):
        metrics["average_delivery_time"] = F.col("avg_delivery_time")
    return metrics


_FORMATS = {
    "days_since_last_purchase": "%.0f", "number_of_orders": "%.1f", "average_order_value": "$%.2f",
    "total_customer_value": "$%.2f", "satisfaction_score": "%.1f/5.0", "average_delivery_time": "%.1f days",
}


def _digits(template: str) -> int:
    return int(template.split(".")[1][0])


def _text(template: str, value: Column) -> Column:
    """Number as text, an exact half rounded up."""
    return F.format_string(template, F.round(value, _digits(template)))


def formatted_metrics(profile: DataFrame) -> dict[str, Column]:
    """Headline numbers as text, by name."""
    return {name: _text(_FORMATS[name], value) for name, value in sorted(metric_columns(profile).items())}


def percentage_text() -> Column:
    return _text("%.1f%%", F.col("share") * 100)


def cluster_profiles(profile: DataFrame, config: Mapping = DEFAULT_CONFIG, max_parts: int = 3) -> DataFrame:
    """Name, size, share and headline numbers per cluster."""
    return profile.select("cluster", segment_name(profile, config, max_parts).alias("name"), "size",
                          (F.col("share") * 100).alias("percentage"),
                          *[v.alias(n) for n, v in metric_columns(profile).items()])


def insight_list(profile: DataFrame, config: Mapping = DEFAULT_CONFIG) -> Column:
    """Business insights in order of importance; a plain statement of size if none applies."""
    found: list[Column] = []
    if _has(profile, "recency_days"):
        days = F.col("recency_days")
        found.append(F.when(days < config["recency"]["active"], INSIGHTS["recent"])
                     .when(days > config["recency"]["recent"], INSIGHTS["inactive"]))
    if _has(profile, "frequency", "monetary"):
        frequent, rare = (F.col("frequency") > F.col("all_frequency")), (F.col("frequency") < F.col("all_frequency"))
        rich, poor = (F.col("monetary") > F.col("all_monetary")), (F.col("monetary") < F.col("all_monetary"))
        found.append(F.when(frequent & rich, INSIGHTS["loyal"]).when(rare & rich, INSIGHTS["big_spender"])
                     .when(frequent & poor, INSIGHTS["frequent_small"]))
    if _has(profile, "avg_review_score"):
        score, limits = F.col("avg_review_score"), config["satisfaction"]
        found.append(F.when(score < limits["neutral"], INSIGHTS["dissatisfied"])
                     .when(score >= limits["very_satisfied"], INSIGHTS["satisfied"]))
    generic = F.array(F.concat(cluster_label(F.col("cluster")), F.lit(" represents "), percentage_text(),
                               F.lit(" of customers.")))
    if not found:
        return generic
    insights = F.array_compact(F.array(*found))
    return F.when(F.size(insights) > 0, insights).otherwise(generic)


def cluster_insights(profile: DataFrame, config: Mapping = DEFAULT_CONFIG) -> DataFrame:
    """One row per cluster and insight, numbered from 1."""
    return profile.select("cluster", F.posexplode(insight_list(profile, config)).alias("position", "insight")).select(
        "cluster", (F.col("position") + 1).alias("position"), "insight")


def metrics_table(profile: DataFrame, config: Mapping = DEFAULT_CONFIG, max_parts: int = 3) -> DataFrame:
    """Table as shown to readers: formatted metrics in name order and the first insight."""
    return profile.select(
        cluster_label(F.col("cluster")).alias("cluster"), segment_name(profile, config, max_parts).alias("name"),
        "size", percentage_text().alias("percentage"),
        *[F.coalesce(v, F.lit("-")).alias(n) for n, v in formatted_metrics(profile).items()],
        F.coalesce(F.try_element_at(insight_list(profile, config), F.lit(1)), F.lit("-")).alias("key_insight"))


def action_list(profile: DataFrame, limits: Mapping = ACTION_LIMITS, most: int = 3) -> Column:
    """Recommended actions, the first three that apply."""
    options: list[Column] = []

    def add(condition: Column, situation: str) -> None:
        options.extend(F.when(condition, F.lit(text)) for text in ACTIONS[situation])

    if _has(profile, "recency_days", "frequency", "monetary"):
        rich = F.col("monetary") > limits["high_value"]
        add((F.col("recency_days") < limits["recent_days"]) & rich, "recent_high_value")
        add((F.col("recency_days") > limits["inactive_days"]) & rich, "inactive_high_value")
        add(F.col("frequency") > limits["frequent_orders"], "frequent")
        add(F.col("monetary") < limits["low_value"], "low_value")
    if _has(profile, "avg_review_score"):
        add(F.col("avg_review_score") < limits["low_score"], "dissatisfied")
        add(F.col("avg_review_score") > limits["high_score"], "satisfied")
    # The last resort comes after all others, so it is only reached with fewer than three.
    add(F.lit(True), "otherwise")
    return F.slice(F.array_compact(F.array(*options)), 1, most)


def segment_actions(profile: DataFrame, config: Mapping = DEFAULT_CONFIG, limits: Mapping = ACTION_LIMITS) -> DataFrame:
    """Segment name and its recommended actions as a bullet list."""
    bullets = F.transform(action_list(profile, limits), lambda a: F.concat(F.lit("• "), a))
    return profile.select("cluster", segment_name(profile, config).alias("name"),
                          F.array_join(bullets, "\n").alias("recommended_actions"))


def characteristic_text(profile: DataFrame, limits: Mapping = ACTION_LIMITS, most: int = 3) -> Column:
    """Key characteristics, judged on the rounded numbers that readers see."""
    metrics = metric_columns(profile)

    def shown(name: str) -> Column:
        return F.round(metrics[name], _digits(_FORMATS[name]))

    found: list[Column] = []
    if "days_since_last_purchase" in metrics:
        days = shown("days_since_last_purchase")
        found.append(F.when(days < limits["recent_days"], TRAITS["recent"])
                     .when(days > limits["inactive_days"], TRAITS["inactive"]))
    if "average_order_value" in metrics and "number_of_orders" in metrics:
        found += [F.when(shown("average_order_value") > limits["high_value"], TRAITS["high_spender"]),
                  F.when(shown("number_of_orders") > limits["frequent_orders"], TRAITS["frequent"])]
    if "satisfaction_score" in metrics:
        score = shown("satisfaction_score")
        found.append(F.when(score > limits["high_score"], TRAITS["satisfied"])
                     .when(score < limits["low_score"], TRAITS["dissatisfied"]))
    generic = F.concat(percentage_text(), F.lit(" of customer base"))
    if not found:
        return generic
    traits = F.slice(F.array_compact(F.array(*found)), 1, most)
    return F.when(F.size(traits) > 0, F.array_join(traits, ", ")).otherwise(generic)


def segment_characteristics(profile: DataFrame, config: Mapping = DEFAULT_CONFIG,
                            limits: Mapping = ACTION_LIMITS) -> DataFrame:
    return profile.select("cluster", segment_name(profile, config).alias("name"),
                          characteristic_text(profile, limits).alias("key_characteristics"))


# --- everything together -------------------------------------------------------------------------


def segment_dashboard(labelled: DataFrame, columns: Sequence[str], scaler: FeatureScaler | None = None,
                      config: Mapping | None = None, original: DataFrame | None = None,
                      key: str = "customer_id") -> dict[str, DataFrame]:
    """All segment tables by name. A part that cannot be built yields a one-row table with the reason
    and leaves the others untouched."""
    config = config or DEFAULT_CONFIG
    spark, result = labelled.sparkSession, {}

    def part(name: str, build) -> None:
        try:
            result[name] = build()
        except Exception as error:
            result[name] = small_table(spark, [{"error": f"{type(error).__name__}: {error}"}],
                                       pa.schema([("error", pa.string())]))

    try:
        profile = profile_table(labelled, columns, scaler)
    except Exception as error:
        return {"error": small_table(spark, [{"error": str(error)}], pa.schema([("error", pa.string())]))}
    name = segment_name(profile, config)
    part("cluster_sizes", lambda: profile.select(
        "cluster", F.concat(cluster_label(F.col("cluster")), F.lit(": "), name).alias("label"), "size",
        (F.col("share") * 100).alias("percentage")))
    if len(columns) >= 3:
        part("feature_comparison", lambda: radar_table(labelled, _most_varied(labelled, columns)))
    part("metrics_table", lambda: metrics_table(profile, config))
    part("action_table", lambda: segment_characteristics(profile, config).join(
        segment_actions(profile, config).drop("name"), "cluster"))
    part("feature_distributions", lambda: feature_distributions(
        labelled, _most_varied(labelled, columns), original, key))
    return result


def _most_varied(labelled: DataFrame, columns: Sequence[str], n: int = 6) -> list[str]:
    return [r["feature"] for r in top_variance_features(labelled, columns, n).collect()]
