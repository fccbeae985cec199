"""k-means: fitting, assignment, choice of k, distances between clusters, feature importance.

Centres are a few numbers on the driver. Assigning rows to them is a projection with the centres as
literals, so it runs inside the scan's stage without a join or a Python worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoplens.functions.frames import col, small_table
from shoplens.functions.geometry import labels_under, nearest, squared_distance, total
from shoplens.functions.quantiles import grouped_quantiles, quantiles_by_feature
from shoplens.operators import silhouettes
from shoplens.operators.lloyd_steps import MOST_STEPS, best_of, converge, starting_rows

#: First of the numbers that name a fit's restarts.
SEED = 42
#: Fits from different starts of which the best is kept.
RESTARTS = 10


def cluster_label(cluster: Column) -> Column:
    """Display name of a cluster id."""
    return F.concat(F.lit("Cluster "), cluster.cast("string"))


@dataclass(frozen=True)
class Centers:
    """Centres by cluster id, over named columns."""

    columns: tuple[str, ...]
    by_cluster: Mapping[int, tuple[float, ...]]

    def nearest(self) -> Column:
        """Struct of squared distance and cluster id."""
        return nearest({k: squared_distance(self.columns, center) for k, center in self.by_cluster.items()})

    def assign(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Add ``cluster`` and ``squared_distance``; without ``keep`` all columns stay."""
        kept = df.columns if keep is None else keep
        return df.withColumn("_near", self.nearest()).select(
            *[col(k) for k in kept], F.col("_near.cluster").alias("cluster"),
            F.col("_near.distance").alias("squared_distance"))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [{"cluster": k, **dict(zip(self.columns, c))} for k, c in sorted(self.by_cluster.items())]
        return small_table(spark, rows, pa.schema([("cluster", pa.int32()), *[(c, pa.float64()) for c in self.columns]]))


def renumbered(columns: Sequence[str], centers: Sequence[Sequence[float]], sizes: Sequence[int]) -> Centers:
    """Ids by falling size, then by coordinates, so a refit gives the same numbers."""
    order = sorted(range(len(centers)), key=lambda i: (-sizes[i], tuple(centers[i])))
    return Centers(tuple(columns), {new: tuple(map(float, centers[old])) for new, old in enumerate(order)})


@dataclass(frozen=True)
class KMeansFit:
    centers: Centers
    cost: float


def fit_groups(df: DataFrame, columns: Sequence[str], ks: Sequence[int], groups: Column, key: str = "customer_id",
               seed: int = SEED, restarts: int = RESTARTS, max_iter: int = MOST_STEPS) -> dict[tuple[str, int], KMeansFit]:
    """Best of ``restarts`` fits by cost for every group of rows and every k, all stepped in the same jobs.

    ``groups`` is an array of the names of the groups that a row belongs to.
    """
    starts = starting_rows(df, columns, max(ks), restarts, key, groups, seed)
    models = {f"{r}-{k}-{g}": (g, dict(enumerate(rows[:k])))
              for g, own in starts.items() for r, rows in enumerate(own) for k in ks}
    found = converge(df, columns, models, groups, max_iter)
    out = {}
    for g in starts:
        for k in ks:
            best = best_of([found[f"{r}-{k}-{g}"] for r in range(restarts)])
            ids = sorted(best.centers)
            out[g, k] = KMeansFit(renumbered(columns, [best.centers[c] for c in ids], [best.sizes[c] for c in ids]), best.cost)
    return out


def fit_kmeans(df: DataFrame, columns: Sequence[str], k: int, seed: int = SEED, restarts: int = RESTARTS,
               max_iter: int = MOST_STEPS, key: str = "customer_id") -> KMeansFit:
    """Best of ``restarts`` fits by cost, each stepped until its centres stand still."""
    return fit_groups(df, columns, [k], F.array(F.lit("all")), key, seed, restarts, max_iter)["all", k]


def _means(df: DataFrame, columns: Sequence[str], cluster: Column) -> Centers:
    rows = df.groupBy(cluster.alias("cluster")).agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).collect()
    return Centers(tuple(columns), {r["cluster"]: tuple(r[f"m{i}"] for i in range(len(columns))) for r in rows})


def lloyd(df: DataFrame, columns: Sequence[str], k: int, start_column: str, iterations: int = MOST_STEPS) -> Centers:
    """k-means from a fixed start until nothing moves: how many of the i/k quantiles of one column a row exceeds.

    Nothing is random, so two engines can be compared. Clusters that lose all rows are dropped.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    cuts = quantiles_by_feature(df, [start_column], [i / k for i in range(1, k)])[start_column]
    label = total([F.when(col(start_column) > cut, 1).otherwise(0) for cut in cuts])
    start = _means(df, columns, label).by_cluster
    if iterations == 1:
        return Centers(tuple(columns), dict(start))
    found = converge(df, columns, {"all": ("all", start)}, F.array(F.lit("all")), iterations - 1)["all"]
    return Centers(tuple(columns), found.centers)


class GroupedCenters:
    """Centres per group (for example per period), joined to rows as a table of one row per group.

    Each coordinate is a column of its own: reading array elements was several times slower.
    """

    def __init__(self, columns: Sequence[str], by_group: Mapping[str, Centers], group: str):
        self.columns, self.by_group, self.group = tuple(columns), dict(by_group), group
        self.clusters = sorted({c for centers in by_group.values() for c in centers.by_cluster})

    def _names(self, cluster: int) -> list[str]:
        return [f"_c{cluster}_{i}" for i in range(len(self.columns))]

    def table(self, spark: SparkSession) -> DataFrame:
        names = [name for c in self.clusters for name in self._names(c)]
        rows = [{self.group: g, **{name: value for c, center in centers.by_cluster.items()
                                   for name, value in zip(self._names(c), center)}}
                for g, centers in self.by_group.items()]
        return small_table(spark, rows, pa.schema([(self.group, pa.string()), *[(n, pa.float64()) for n in names]]))

    def assign(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Nearest centre of the row's own group; rows of other groups are dropped."""
        distances = {c: squared_distance(self.columns, self._names(c)) for c in self.clusters}
        near = nearest(distances, {c: self._names(c)[0] for c in self.clusters})
        return df.join(self.table(df.sparkSession), self.group).withColumn("_near", near).select(
            *[col(k) for k in keep], F.col("_near.cluster").alias("cluster"),
            F.col("_near.distance").alias("squared_distance"))


def grouped_lloyd(df: DataFrame, columns: Sequence[str], cuts: Mapping[str, Sequence[float]], start_column: str,
                  group: str, iterations: int = MOST_STEPS) -> GroupedCenters:
    """``lloyd`` inside every group at once: one job per step however many groups there are.

    ``cuts`` holds the start quantiles of each group; groups may have different numbers of them.
    """
    found = grouped_starts(df, columns, cuts, start_column, group)
    if iterations > 1 and found:
        models = {g: (g, centers) for g, centers in found.items()}
        found |= {g: o.centers for g, o in converge(df, columns, models, F.array(col(group)), iterations - 1).items()}
    return GroupedCenters(columns, {g: Centers(tuple(columns), c) for g, c in found.items()}, group)


def grouped_starts(df: DataFrame, columns: Sequence[str], cuts: Mapping[str, Sequence[float]], start_column: str,
                   group: str) -> dict[str, dict[int, tuple[float, ...]]]:
    """Per group the means of the rows that exceed equally many of the group's cuts, by that number."""
    schema = pa.schema([(group, pa.string()), ("_cuts", pa.list_(pa.float64()))])
    table = small_table(df.sparkSession, [{group: g, "_cuts": list(c)} for g, c in cuts.items()], schema)
    start = F.size(F.filter("_cuts", lambda cut: col(start_column) > cut))
    rows = df.join(table, group).groupBy(group, start.alias("cluster")).agg(
        *[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).collect()
    found: dict[str, dict] = {}
    for r in rows:
        found.setdefault(r[group], {})[r["cluster"]] = tuple(r[f"m{i}"] for i in range(len(columns)))
    return found


def start_cuts(df: DataFrame, k: int, start_column: str, group: str) -> dict[str, list[float]]:
    """The i/k quantiles of the start column in every group."""
    long = df.select(group, col(start_column).alias("value"))
    rows = grouped_quantiles(long, [group], [i / k for i in range(1, k)]).collect()
    return {r[group]: list(r["quantiles"]) for r in rows}


def inertia_by_k(df: DataFrame, columns: Sequence[str], ks: Iterable[int], start_column: str) -> DataFrame:
    """Sum of squared distances to the nearest fixed-start centre per k; every step serves all k.

    Rows are repeated per k for the starts and the final sums only; the steps read each row once for all k.
    """
    ks = list(ks)
    probs = sorted({i / k for k in ks for i in range(1, k)})
    found = quantiles_by_feature(df, [start_column], probs)[start_column]
    at = dict(zip(probs, found))
    cuts = {str(k): [at[i / k] for i in range(1, k)] for k in ks}
    every = df.select(F.explode(F.array(*[F.lit(str(k)) for k in ks])).alias("k"), *[col(c) for c in columns])
    starts = grouped_starts(every, columns, cuts, start_column, "k")
    found = converge(df, columns, {k: ("all", at) for k, at in starts.items()}, F.array(F.lit("all")), MOST_STEPS - 1)
    centers = GroupedCenters(columns, {k: Centers(tuple(columns), found[k].centers) for k in starts}, "k")
    return centers.assign(every, ["k"]).groupBy(F.col("k").cast("int").alias("k")).agg(
        F.sum("squared_distance").alias("inertia"))


def elbow_table(df: DataFrame, columns: Sequence[str], ks: Iterable[int] = range(2, 11), seed: int = SEED,
                restarts: int = RESTARTS, key: str = "customer_id") -> DataFrame:
    """Cost and mean silhouette per k; the silhouette needs two clusters. All fits of all k share their jobs."""
    ks = list(ks)
    fits = fit_groups(df, columns, ks, F.array(F.lit("all")), key, seed, restarts)
    names = [f"x{i}" for i in range(len(columns))]
    plain = df.select(*[col(c).alias(n) for c, n in zip(columns, names)])
    label = labels_under([fits["all", k].centers.by_cluster for k in ks], [F.col(n) for n in names])
    labelled = plain.withColumn("_labels", label).select(*names, F.posexplode("_labels").alias("position", "cluster"))
    scored = {r["position"]: r["silhouette"] for r in silhouettes.grouped_mean_silhouette(labelled, names, ["position"]).collect()}
    rows = [{"k": k, "inertia": fits["all", k].cost, "silhouette": scored[i] if k > 1 else None} for i, k in enumerate(ks)]
    return small_table(df.sparkSession, rows, pa.schema(
        [("k", pa.int32()), ("inertia", pa.float64()), ("silhouette", pa.float64())]))


def intercluster_distances(labelled: DataFrame, centers: Centers) -> DataFrame:
    """Distance between every two centres, also relative to the largest, with the cluster sizes."""
    sizes = {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()}
    largest = max(sizes.values())
    ids = sorted(centers.by_cluster)
    pairs = [(a, b, math.dist(centers.by_cluster[a], centers.by_cluster[b]))
             for i, a in enumerate(ids) for b in ids[i + 1:]]
    furthest = max((d for *_, d in pairs), default=0.0)
    rows = [{"cluster_a": a, "cluster_b": b, "distance": d,
             "normalized_distance": d / furthest if furthest else None,
             "relative_size_a": sizes.get(a, 0) / largest, "relative_size_b": sizes.get(b, 0) / largest}
            for a, b, d in pairs]
    return small_table(labelled.sparkSession, rows, pa.schema(
        [("cluster_a", pa.int32()), ("cluster_b", pa.int32()), ("distance", pa.float64()),
         ("normalized_distance", pa.float64()), ("relative_size_a", pa.float64()), ("relative_size_b", pa.float64())]))


def hashed_order(key: str, salt: object) -> Column:
    """Reproducible random order of rows."""
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"-{salt}")))


def permutation_importance(df: DataFrame, centers: Centers, key: str = "customer_id", n_repeats: int = 3,
                           sample_size: int | None = None, bucket_rows: int = 2_000) -> DataFrame:
    """Loss of mean silhouette when one feature is shuffled: mean and deviation over the repeats.

    All rows count. If ``sample_size`` is given, about so many rows do: those whose hash lies below a threshold, which is
    decided where a row is read.

    Rows are put in random order inside random buckets of bounded size and each takes the value of
    the next row, so a shuffle of a column needs no global sort. All features and repeats are scored
    in the same two passes.
    """
    columns = list(centers.columns)
    sample, n = df.select(col(key), *[col(c) for c in columns]), df.count()
    if sample_size is not None and n > sample_size:
        number = F.conv(F.substring(hashed_order(key, "sample"), 1, 8), 16, 10).cast("bigint")
        sample, n = sample.where(number < F.lit(math.ceil(sample_size / n * (1 << 32)))), sample_size
    buckets = max(1, math.ceil(n / bucket_rows))
    baseline = silhouettes.mean_silhouette(centers.assign(sample, columns), columns)
    long = None
    for repeat in range(n_repeats):
        order = hashed_order(key, repeat)
        bucket = F.conv(F.substring(hashed_order(key, f"b{repeat}"), 1, 8), 16, 10).cast("bigint") % buckets
        window = Window.partitionBy("_bucket").orderBy(order, key)
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        row = F.struct(*[col(c).alias(f"v{i}") for i, c in enumerate(columns)])
        shuffled = sample.withColumn("_bucket", bucket).select(
            *[col(c) for c in columns], F.coalesce(F.lead(row).over(window), F.first(row).over(whole)).alias("_next"))
        # Labels are taken after the rows are multiplied, so their code exists once, not per variant.
        variants = []
        for i in range(len(columns)):
            values = ", ".join(f"'x{j}', " + (f"_next.v{i}" if i == j else f"`{name}`") for j, name in enumerate(columns))
            variants.append(f"named_struct('repeat', {repeat}, 'feature_position', {i}, {values})")
        part = shuffled.selectExpr(f"inline(array({', '.join(variants)}))")
        long = part if long is None else long.unionByName(part)
    names = [f"x{j}" for j in range(len(columns))]
    relabelled = long.withColumn("cluster", Centers(tuple(names), centers.by_cluster).nearest()["cluster"])
    scored = silhouettes.grouped_mean_silhouette(relabelled, names, ["repeat", "feature_position"])
    label = F.array(*[F.lit(c) for c in columns])
    return (
        scored.groupBy("feature_position")
        .agg(F.avg(baseline - F.col("silhouette")).alias("importance"),
             F.stddev_pop(baseline - F.col("silhouette")).alias("std"))
        .select(label[F.col("feature_position")].alias("feature"), "importance", "std")
        .orderBy(F.desc("importance"), "feature")
    )
