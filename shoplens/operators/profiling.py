"""Profiles of numeric columns: histograms, correlation, box statistics, summary, density."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.frames import chosen_columns, col, melt, small_table
from shoplens.functions.moments import corrected_skewness
from shoplens.functions.quantiles import quantile_table

QUARTILES = (0.25, 0.5, 0.75)


def _products(df: DataFrame, columns: Sequence[str]) -> dict[str, np.ndarray]:
    """For every two columns x, y the sums over rows where both are present: n, x, y, x², y² and xy, around the means.

    A batch is one matrix of values, 0 where missing, and one of presence; its sums are products of these. Each task
    hands on one matrix per sum, so no row is multiplied. Values are taken relative to the column's mean, which keeps
    the sums exact where values are large and differ little.
    """
    width, names = len(columns), ("n", "x", "xx", "xy")
    means = df.agg(*[F.avg(col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([m or 0.0 for m in means])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(names), width, width))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float) - shift
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            values = np.where(there > 0, values, 0.0)
            sums += [there.T @ there, values.T @ there, (values ** 2).T @ there, values.T @ values]
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    one = df.select(*[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInArrow(run, "sums array<double>")
    rows = one.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(names) * width * width)
    for r in rows:
        flat[r["at"]] = r["v"]
    found = dict(zip(names, flat.reshape(len(names), width, width)))
    return found | {"y": found["x"].T, "yy": found["xx"].T}


def _matrix_frame(spark: SparkSession, columns: Sequence[str], name: str, values: np.ndarray, extra: bool) -> DataFrame:
    rows = [{"feature_x": a, "feature_y": b, "x_position": i, "y_position": j,
             name: None if np.isnan(values[i, j]) else float(values[i, j])}
            for i, a in enumerate(columns) for j, b in enumerate(columns)]
    kinds = [("feature_x", pa.string()), ("feature_y", pa.string()), ("x_position", pa.int32()), ("y_position", pa.int32()),
             (name, pa.float64())]
    return small_table(spark, rows, pa.schema(kinds if extra else [kinds[0], kinds[1], kinds[4]]))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of columns over rows where both are present; NULL where one does not vary.

    Without ``columns``, of all numeric columns but the key.
    """
    columns = chosen_columns(df, columns)
    s = _products(df, columns)
    with np.errstate(all="ignore"):
        spread_x, spread_y = s["xx"] - s["x"] ** 2 / s["n"], s["yy"] - s["y"] ** 2 / s["n"]
        # What rounding leaves of a column that does not vary counts as nothing.
        flat = (spread_x <= 1e-24 * (1 + s["xx"])) | (spread_y <= 1e-24 * (1 + s["yy"]))
        found = np.where(flat, np.nan, (s["xy"] - s["x"] * s["y"] / s["n"]) / np.sqrt(spread_x * spread_y))
    found[np.diag_indices(len(columns))] = np.where(np.isnan(np.diag(found)), np.nan, 1.0)
    return _matrix_frame(df.sparkSession, columns, "correlation", found, True)


def lower_triangle(matrix: DataFrame, digits: int = 2) -> DataFrame:
    """Entries below the diagonal of a correlation matrix, with the rounded label."""
    return matrix.where(F.col("x_position") > F.col("y_position")).select(
        "feature_x", "feature_y", "correlation", F.round("correlation", digits).alias("label"))


def covariance_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sample covariance of every pair of columns; NULL below two rows with both."""
    columns = chosen_columns(df, columns)
    s = _products(df, columns)
    with np.errstate(all="ignore"):
        found = np.where(s["n"] > 1, (s["xy"] - s["x"] * s["y"] / s["n"]) / (s["n"] - 1), np.nan)
    return _matrix_frame(df.sparkSession, columns, "covariance", found, False)


def box_statistics(df: DataFrame, columns: Sequence[str] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers and mean per feature (and per key value)."""
    columns = chosen_columns(df, columns, keys)
    ranges = melt(df, columns, keys).groupBy(*keys, "feature").agg(
        F.min("value").alias("least"), F.max("value").alias("greatest"), F.avg("value").alias("mean"))
    quartiles = quantile_table(df, columns, QUARTILES, keys)
    q1, median, q3 = (F.col("quantiles")[i] for i in range(3))
    reach = 1.5 * (q3 - q1)
    return quartiles.join(ranges, [*keys, "feature"]).select(
        *keys, "feature", "n", q1.alias("q1"), median.alias("median"), q3.alias("q3"),
        F.greatest(F.col("least"), q1 - reach).alias("whisker_low"),
        F.least(F.col("greatest"), q3 + reach).alias("whisker_high"), "mean")


def column_summary(df: DataFrame, columns: Sequence[str] | None = None, use_log_scale: bool = False) -> DataFrame:
    """Skewness, mean, median, deviation and whether a log axis is possible; empty columns are left out."""
    columns = chosen_columns(df, columns)
    value = F.col("value")
    log_possible = (F.min(value) > 0) if use_log_scale else F.lit(False)
    moments = melt(df, columns).groupBy("feature").agg(
        corrected_skewness(value).alias("skewness"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), log_possible.alias("can_use_log"))
    medians = quantile_table(df, columns, [0.5], ())
    return moments.join(medians, "feature").select(
        "feature", "skewness", "mean", F.col("quantiles")[0].alias("median"), "std", "can_use_log")


def sturges_bins(n: int, least: int = 10, most: int = 50) -> int:
    return min(most, max(least, math.ceil(math.log2(n)) + 1)) if n else least


def _bin_layout(df: DataFrame, columns: Sequence[str], bins: int | None) -> list[dict]:
    """Range, bin count and moments per column that holds a value."""
    names = {f"{part}_{i}": (part, c) for i, c in enumerate(columns) for part in ("n", "lo", "hi", "mean", "std")}
    kinds = {"n": F.count, "lo": F.min, "hi": F.max, "mean": F.avg, "std": F.stddev_samp}
    row = df.agg(*[kinds[part](col(c).cast("double")).alias(name) for name, (part, c) in names.items()]).first()
    layout = []
    for i, column in enumerate(columns):
        n, lo, hi = row[f"n_{i}"], row[f"lo_{i}"], row[f"hi_{i}"]
        if not n:
            continue
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        count = bins or sturges_bins(n)
        layout.append({"feature": column, "total": n, "lo": lo, "width": (hi - lo) / count, "bins": count,
                       "mean": row[f"mean_{i}"], "std": row[f"std_{i}"]})
    return layout


def _bin_of(value: Column, lo: Column, width: Column, bins: Column) -> Column:
    """Bin number by half-open bins whose edges are ``lo + i * width``; the last bin is closed."""
    first = F.least(F.floor((value - lo) / width).cast("int"), bins - 1)
    return (F.when(value < lo + first * width, first - 1)
            .when((value >= lo + (first + 1) * width) & (first < bins - 1), first + 1).otherwise(first))


def _binned(df: DataFrame, layout: list[dict]) -> DataFrame:
    """Every bin of every column with its edges and count, empty bins included."""
    spark = df.sparkSession
    floats = ("lo", "width", "mean", "std")
    schema = pa.schema([("feature", pa.string()), ("total", pa.int64()), ("bins", pa.int32()),
                        *[(name, pa.float64()) for name in floats]])
    plan = small_table(spark, [{k: r[k] for k in schema.names} for r in layout], schema)
    counted = (
        melt(df, [r["feature"] for r in layout]).join(plan, "feature")
        .groupBy("feature", _bin_of(F.col("value"), F.col("lo"), F.col("width"), F.col("bins")).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    edge = F.col("lo") + F.col("bin") * F.col("width")
    return grid.join(counted, ["feature", "bin"], "left").select(
        "feature", "bin", edge.alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "total", "width", "mean", "std")


def feature_histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Equal-width histogram per column."""
    columns = chosen_columns(df, columns)
    return _binned(df, _bin_layout(df, columns, bins)).select("feature", "bin", "bin_start", "bin_end", "n")


def density_histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Histogram with Sturges' bin number, as a density, beside the fitted normal density."""
    columns = chosen_columns(df, columns)
    centre = (F.col("bin_start") + F.col("bin_end")) / 2
    z = (centre - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0))
    normal = F.exp(-z * z / 2) / (F.col("std") * math.sqrt(2 * math.pi))
    return _binned(df, _bin_layout(df, columns, None)).select(
        "feature", "bin", centre.alias("bin_center"), "n",
        (F.col("n") / (F.col("total") * F.col("width"))).alias("density"),
        F.when(F.col("std") > 0, normal).alias("normal_density"))


def top_variance_features(df: DataFrame, columns: Sequence[str] | None = None, n: int = 6) -> DataFrame:
    """The columns with the largest sample variance."""
    columns = chosen_columns(df, columns)
    return (
        df.agg(*[F.var_samp(col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)])
        .select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])))
        .orderBy(F.desc("variance"), "feature").limit(n)
    )
