"""Six outlier rules: their limits, a summary per rule and column, and the cleaned columns."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.frames import chosen_columns, col, melt, small_table
from shoplens.functions.moments import corrected_skewness
from shoplens.functions.quantiles import quantiles_at, quantiles_by_feature

# The rule names of the reports.
Z3, IQR, Z2 = "Z-score (±3)", "IQR 1.5", "Z-score (±2)"
Q01_Q99, Q05_Q95, FULL_RANGE = "Quantile 1-99", "Quantile 5-95", "Full Range"
METHODS = (Z3, IQR, Z2, Q01_Q99, Q05_Q95, FULL_RANGE)

_PROBS = (0.01, 0.05, 0.25, 0.75, 0.95, 0.99)
_QUANTILE_METHODS = {IQR, Q01_Q99, Q05_Q95}

Limits = dict[str, dict[str, tuple[float | None, float | None]]]


def outlier_limits(df: DataFrame, columns: Sequence[str] | None = None, methods: Sequence[str] = METHODS) -> Limits:
    """Lower and upper limit by rule and column (all numeric ones by default); columns without a value are left out."""
    columns = chosen_columns(df, columns)
    kinds = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "least": F.min, "greatest": F.max}
    row = df.agg(*[fn(col(c).cast("double")).alias(f"{kind}_{i}")
                   for i, c in enumerate(columns) for kind, fn in kinds.items()]).first()
    present = [(i, c) for i, c in enumerate(columns) if row[f"n_{i}"]]
    quantiles = (quantiles_by_feature(df, [c for _, c in present], _PROBS)
                 if present and _QUANTILE_METHODS & set(methods) else {})
    limits: Limits = {method: {} for method in methods}
    for i, column in present:
        mean, std = row[f"mean_{i}"], row[f"std_{i}"]
        q = dict(zip(_PROBS, quantiles.get(column, [None] * len(_PROBS))))

        def around(width: float):
            return (None, None) if std is None else (mean - width * std, mean + width * std)

        rules = {
            Z3: lambda: around(3), Z2: lambda: around(2),
            IQR: lambda: (q[0.25] - 1.5 * (q[0.75] - q[0.25]), q[0.75] + 1.5 * (q[0.75] - q[0.25])),
            Q01_Q99: lambda: (q[0.01], q[0.99]), Q05_Q95: lambda: (q[0.05], q[0.95]),
            FULL_RANGE: lambda: (row[f"least_{i}"], row[f"greatest_{i}"]),
        }
        for method in methods:
            limits[method][column] = rules[method]()
    return limits


def cleaned_columns(limits: Mapping[str, tuple[float | None, float | None]]) -> dict[str, Column]:
    """Expression per column that turns values outside its limits into NULL."""
    return {
        c: col(c) if lo is None else F.when(col(c).between(lo, hi), col(c))
        for c, (lo, hi) in limits.items()
    }


def without_outliers(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """All rows and columns, with outlying values set to NULL."""
    cleaned = cleaned_columns(limits)
    return df.select([cleaned[c].alias(c) if c in cleaned else col(c) for c in df.columns])


def _limit_table(df: DataFrame, limits: Limits) -> DataFrame:
    """One row per column with the limits of each rule side by side (``lo0``, ``hi0``, ``lo1`` …)."""
    columns = list(dict.fromkeys(c for by_column in limits.values() for c in by_column))
    schema = pa.schema([("feature", pa.string()), *[
        (f"{end}{k}", pa.float64()) for k in range(len(limits)) for end in ("lo", "hi")]])
    rows = [{"feature": c, **{f"{end}{k}": v for k, by_column in enumerate(limits.values())
                              for end, v in zip(("lo", "hi"), by_column[c])}} for c in columns]
    return small_table(df.sparkSession, rows, schema)


def outlier_statistics(df: DataFrame, columns: Sequence[str] | None = None, methods: Sequence[str] = METHODS) -> DataFrame:
    """Counts, limits, extremes and moments with and without outliers, per rule and column.

    The limits are one row per column, joined to the long form as a local table; all rules are then
    summed in one pass. Cleaning cuts off both ends of the sorted values, so the median without
    outliers is the value at a known rank and needs no second copy of the data per rule.
    """
    limits = outlier_limits(df, columns, methods)
    present = list(dict.fromkeys(c for by_column in limits.values() for c in by_column))
    value = F.col("value")
    aggregates = [F.count(value).alias("n"), F.avg(value).alias("mean_with"), F.stddev_samp(value).alias("std_with"),
                  corrected_skewness(value).alias("skewness")]
    for k in range(len(methods)):
        below, above = value < F.col(f"lo{k}"), value > F.col(f"hi{k}")
        inside = F.when(~F.coalesce(below | above, F.lit(False)), value)
        aggregates += [
            F.count_if(below).alias(f"below_min{k}"), F.count_if(above).alias(f"above_max{k}"),
            F.min(F.when(below, value)).alias(f"extreme_min{k}"), F.max(F.when(above, value)).alias(f"extreme_max{k}"),
            F.avg(inside).alias(f"mean_without{k}"), F.stddev_samp(inside).alias(f"std_without{k}")]
    rows = (
        melt(df, present).join(_limit_table(df, limits), "feature").groupBy("feature").agg(*aggregates).collect()
    )
    positions = {}
    for r in rows:
        clean = [(r[f"below_min{k}"], r["n"] - r[f"below_min{k}"] - r[f"above_max{k}"]) for k in range(len(methods))]
        positions[r["feature"]] = [(r["n"] - 1) / 2] + [below + max(0, left - 1) / 2 for below, left in clean]
    medians = quantiles_at(df, positions)
    table = []
    for r in rows:
        feature, n = r["feature"], r["n"]
        for k, method in enumerate(methods):
            parts = {name: r[f"{name}{k}"] for name in (
                "below_min", "above_max", "extreme_min", "extreme_max", "mean_without", "std_without")}
            lo, hi = limits[method][feature]
            outside = parts["below_min"] + parts["above_max"]
            table.append({
                "method": method, "method_order": k, "feature": feature, "lower_bound": lo, "upper_bound": hi,
                "outlier_count": outside, "outlier_pct": outside / n * 100,
                **{name: r[name] for name in ("mean_with", "std_with", "skewness")}, **parts,
                "median_with": medians[feature][0],
                "median_without": medians[feature][k + 1] if outside < n else None})
    # One row per rule and column, whatever the size of the data.
    kinds = {"method": pa.string(), "method_order": pa.int32(), "feature": pa.string(),
             "outlier_count": pa.int64(), "below_min": pa.int64(), "above_max": pa.int64()}
    names = ("method", "method_order", "feature", "lower_bound", "upper_bound", "outlier_count", "outlier_pct",
             "below_min", "above_max", "extreme_min", "extreme_max", "mean_with", "std_with", "median_with",
             "mean_without", "std_without", "median_without", "skewness")
    return small_table(df.sparkSession, table, pa.schema([(n, kinds.get(n, pa.float64())) for n in names]))


def outlier_summary(df: DataFrame, columns: Sequence[str] | None = None, methods: Sequence[str] = METHODS) -> DataFrame:
    """Report per rule and column, the columns with most outliers first within a rule.

    The change of the mean is 0 where the mean without outliers is 0 or missing.
    """
    change = F.coalesce(_percent_change("mean"), F.lit(0.0))
    return (
        outlier_statistics(df, columns, methods)
        .orderBy("method_order", F.desc("outlier_count"), "feature")
        .select("method", "feature", "outlier_count", "outlier_pct", "below_min", "above_max",
                F.col("lower_bound").alias("min_limit"), F.col("upper_bound").alias("max_limit"),
                "extreme_min", "extreme_max", "mean_with", "mean_without", change.alias("mean_pct_change"),
                "skewness", "median_with", "std_with", "median_without", "std_without")
    )


def _percent_change(moment: str) -> Column:
    before, after = F.col(f"{moment}_with"), F.col(f"{moment}_without")
    return F.try_divide(before - after, after) * 100


def outlier_rule_table(df: DataFrame, columns: Sequence[str], method: str) -> DataFrame:
    """Limits of one rule per column and how many values lie outside them."""
    limits = outlier_limits(df, columns, [method])
    outside = (F.col("value") < F.col("lo0")) | (F.col("value") > F.col("hi0"))
    return (
        melt(df, list(limits[method])).join(_limit_table(df, limits), "feature")
        .groupBy("feature", F.col("lo0").alias("lower_bound"), F.col("hi0").alias("upper_bound"))
        .agg(F.count_if(outside).alias("outlier_count"))
    )


def method_comparison(df: DataFrame, variable: str) -> DataFrame | None:
    """All rules on one column, missing values left out. An unknown column gives a warning and None."""
    if variable not in df.columns:
        warnings.warn(f"Variable '{variable}' not found in dataframe.", stacklevel=2)
        return None
    return (
        outlier_statistics(df, [variable], METHODS).orderBy("method_order")
        .select("method", "lower_bound", "upper_bound", "outlier_count", "outlier_pct", "mean_with", "mean_without",
                _percent_change("mean").alias("mean_pct_change"), "median_with", "median_without", "std_with",
                "std_without", _percent_change("std").alias("std_pct_change"))
    )
