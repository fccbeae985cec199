"""Silhouette scores and the stratified sample they may be taken on.

With squared Euclidean distance the mean distance from a row to a cluster is its distance to the
centre plus the cluster's own variance. Scores of all rows thus need one aggregate and one
projection, and no pair of rows is ever formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.frames import col, small_table
from shoplens.functions.geometry import squared_distance, total

#: Rows that Euclidean scores are taken against, as in the source reports.
REFERENCE_ROWS = 20_000


def _moments(labelled: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Size, centre and summed variance of every cluster."""
    return labelled.groupBy(*keys, "cluster").agg(
        F.count("*").alias("size"),
        F.array(*[F.avg(col(c)) for c in columns]).alias("center"),
        total([F.var_pop(col(c)) for c in columns]).alias("spread"))


def _scored(df: DataFrame, columns: Sequence[str], clusters: Sequence[tuple[int, Column, Sequence, Column]],
            keep: Sequence[str]) -> DataFrame:
    """Add ``silhouette``; ``clusters`` holds id, size, centre and spread (NULL if absent).

    The distances are columns of their own, so each is computed once per row.
    """
    own = F.col("cluster")
    away = {k: F.col(f"_d{k}") for k, *_ in clusters}
    sizes = {k: F.col(f"_n{k}") for k, *_ in clusters}
    inside = F.coalesce(*[F.when((own == k) & (sizes[k] > 1), away[k] * sizes[k] / (sizes[k] - 1)) for k in away])
    others = [F.when(own != k, d) for k, d in away.items()]
    outside = others[0] if len(others) == 1 else F.least(*others)
    a, b = F.col("_inside"), F.col("_outside")
    # A cluster of one row has no inner distance: its score is 0 by definition.
    score = F.when(a.isNull() | (F.greatest(a, b) <= 0), 0.0).otherwise((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)))
    kept = [col(k) for k in keep]
    return (
        df.select(*kept, "cluster", *[size.alias(f"_n{k}") for k, size, *_ in clusters], *[
            (F.expr(squared_distance(columns, center)) + spread).alias(f"_d{k}") for k, _, center, spread in clusters])
        .select(*kept, "cluster", inside.alias("_inside"), outside.alias("_outside"))
        .select(*kept, "cluster", score.alias("silhouette"))
    )


def _require_clusters(rows: list) -> None:
    if len(rows) < 2:
        raise ValueError("a silhouette needs at least two clusters")


def silhouette_samples(labelled: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Silhouette of every row, squared Euclidean distance."""
    rows = _moments(labelled, columns).collect()
    _require_clusters(rows)
    clusters = [(r["cluster"], F.lit(r["size"]), list(r["center"]), F.lit(r["spread"])) for r in rows]
    return _scored(labelled, columns, clusters, keep)


def mean_silhouette(labelled: DataFrame, columns: Sequence[str]) -> float:
    return silhouette_samples(labelled, columns, ()).agg(F.avg("silhouette")).first()[0]


def grouped_mean_silhouette(labelled: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean silhouette of each group of labelled rows; a group with one cluster scores 0.

    The groups must be few: their cluster moments come back as one small row per group.
    """
    rows = _moments(labelled, columns, keys).collect()
    ids = sorted({r["cluster"] for r in rows})
    kinds = {f.name: pa.int32() if f.dataType.simpleString() == "int" else pa.string()
             for f in labelled.schema.fields if f.name in keys}
    centers = {c: [f"_m{c}_{i}" for i in range(len(columns))] for c in ids}
    schema = pa.schema([*[(k, kinds[k]) for k in keys], *[
        part for c in ids for part in (
            (f"_size{c}", pa.int64()), (f"_spread{c}", pa.float64()), *[(m, pa.float64()) for m in centers[c]])]])
    table: dict[tuple, dict] = {}
    for r in rows:
        c = r["cluster"]
        entry = table.setdefault(tuple(r[k] for k in keys), {k: r[k] for k in keys})
        entry.update({f"_size{c}": r["size"], f"_spread{c}": r["spread"], **dict(zip(centers[c], r["center"]))})
    clusters = [(c, F.col(f"_size{c}"), centers[c], F.col(f"_spread{c}")) for c in ids]
    joined = labelled.join(small_table(labelled.sparkSession, list(table.values()), schema), list(keys))
    return _scored(joined, columns, clusters, keys).groupBy(*keys).agg(
        F.avg(F.coalesce("silhouette", F.lit(0.0))).alias("silhouette"))


def silhouette_report(labelled: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, share and mean silhouette of every cluster, and of all rows (``cluster`` NULL)."""
    scores = silhouette_samples(labelled, columns, ())
    return (
        scores.rollup("cluster").agg(F.count("*").alias("size"), F.avg("silhouette").alias("mean_silhouette"),
                                     F.min("silhouette").alias("least_silhouette"))
        .select("cluster", "size", (F.col("size") * 100 / labelled.agg(F.count("*").alias("n")).scalar()).alias("percentage"),
                "mean_silhouette", "least_silhouette")
    )


def silhouette_order(labelled: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Rows as the silhouette plot stacks them: by cluster, in each from the lowest score to the highest."""
    return silhouette_samples(labelled, columns, keep).orderBy("cluster", "silhouette", *keep)


def _id_order(key: str) -> Column:
    return F.md5(col(key).cast("string"))


def stratified_sample(labelled: DataFrame, n: int, key: str = "customer_id") -> DataFrame:
    """``n`` rows in proportion to the cluster sizes; rounding losses are filled up at random.

    The random order is the md5 of the key. Where a row is read, its md5 is held against a threshold per cluster that lets
    through the wanted share with a margin; only what passes, about ``n`` rows, is ranked. A margin that proves too
    small is widened.
    """
    sizes = {r["cluster"]: r["count"] for r in labelled.groupBy("cluster").count().collect()}
    everything = sum(sizes.values())
    if everything <= n:
        return labelled
    share = {c: n * size // everything for c, size in sizes.items()}
    missing = n - sum(share.values())
    need = {c: min(size, share[c] + missing) for c, size in sizes.items()}
    number = F.conv(F.substring(_id_order(key), 1, 8), 16, 10).cast("bigint")

    def by_cluster(values: dict) -> Column:
        return F.coalesce(*[F.when(F.col("cluster") == c, F.lit(v)) for c, v in values.items()])

    margin = 6.0
    while True:
        limit = {c: math.ceil(min(1.0, (need[c] + margin * (math.sqrt(need[c]) + 1)) / size) * (1 << 32)) for c, size in sizes.items()}
        passed = labelled.where(number < by_cluster(limit))
        counts = {r["cluster"]: r["count"] for r in passed.groupBy("cluster").count().collect()}
        if all(counts.get(c, 0) >= need[c] for c in sizes):
            break
        margin *= 4
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(_id_order(key), key))
    ranked = passed.withColumn("rank", rank)
    wanted = by_cluster(share)
    chosen = ranked.where(F.col("rank") <= wanted)
    extra = ranked.where((F.col("rank") > wanted) & (F.col("rank") <= wanted + missing)).orderBy(_id_order(key), key).limit(missing)
    return chosen.unionByName(extra).drop("rank")


def euclidean_silhouettes(labelled: DataFrame, columns: Sequence[str], key: str = "customer_id",
                          reference: DataFrame | None = None, reference_rows: int = REFERENCE_ROWS) -> DataFrame:
    """Silhouette with Euclidean distance of every row, against a reference sample of all clusters.

    reference: rows of ``labelled``, few enough to be sent to every task as one matrix; by default a stratified sample of
    ``reference_rows``. A row's mean distance to a cluster is taken over the reference rows of that cluster, itself left
    out.
    """
    reference = stratified_sample(labelled, reference_rows, key) if reference is None else reference
    names = [f"x{i}" for i in range(len(columns))]
    points = [col(c).cast("double").alias(n) for c, n in zip(columns, names)]
    table = reference.select(col(key), "cluster", *points).toArrow()
    matrix = np.column_stack([table[c].to_numpy() for c in names]) if table.num_rows else np.empty((0, len(names)))
    owner, members = table["cluster"].to_numpy(), np.array(table[key].to_pylist())
    ids = np.unique(owner)
    _require_clusters(list(ids))
    spark = labelled.sparkSession
    shared = spark.sparkContext.broadcast((matrix, np.searchsorted(ids, owner), np.sort(members), ids))
    chunk = 64

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, groups, present, clusters = shared.value
        hot = np.eye(len(clusters))[groups]
        counts = hot.sum(axis=0)
        for batch in batches:
            rows, own = batch[names].to_numpy(), np.searchsorted(clusters, batch["cluster"].to_numpy())
            found = np.searchsorted(present, batch[key].to_numpy())
            inside = present[np.minimum(found, len(present) - 1)] == batch[key].to_numpy()
            sums = np.concatenate([np.sqrt(((rows[s:s + chunk, None, :] - values[None]) ** 2).sum(axis=2)) @ hot
                                   for s in range(0, len(rows), chunk)] or [np.zeros((0, len(clusters)))])
            at = np.arange(len(rows))
            others = counts[own] - inside
            with np.errstate(all="ignore"):
                a = sums[at, own] / others
                away = sums / counts
                away[at, own] = np.inf
                b = away.min(axis=1)
                scores = np.where((others < 1) | (np.maximum(a, b) <= 0), 0.0, (b - a) / np.maximum(a, b))
            yield pd.DataFrame({key: batch[key], "cluster": batch["cluster"], "silhouette": scores})

    kind = dict(labelled.dtypes)
    return labelled.select(col(key), "cluster", *points).repartition(key).mapInPandas(
        score, f"`{key}` {kind[key]}, cluster {kind['cluster']}, silhouette double")
