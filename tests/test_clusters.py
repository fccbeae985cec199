import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.operators import clustering, silhouettes
from shoplens.operators.clustering import Centers
from shoplens.operators.components import fit_components

COLUMNS = ["x", "y"]


def blobs(spark, sizes=(60, 30, 10), seed=5):
    rng = np.random.default_rng(seed)
    spots = [(0, 0), (8, 1), (3, 9)]
    rows = []
    for (cx, cy), n in zip(spots, sizes):
        rows += [(len(rows) + i, float(cx + a), float(cy + b)) for i, (a, b) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "customer_id long, x double, y double").repartition(3)


def matrix(df):
    rows = df.orderBy("customer_id").collect()
    return np.array([[r[c] for c in COLUMNS] for r in rows]), np.array([r["cluster"] for r in rows]) if "cluster" in df.columns else None


def test_assignment_takes_the_lowest_id_on_a_tie(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0)], "x double, y double")
    rows = Centers(("x", "y"), {0: (1.0, 0.0), 1: (-1.0, 0.0)}).assign(df).orderBy("x").collect()
    assert [(r["cluster"], r["squared_distance"]) for r in rows] == [(0, 1.0), (0, 1.0)]
    assert Centers(("x", "y"), {4: (0.0, 0.0)}).assign(df).agg(F.max("cluster")).first()[0] == 4


def test_kmeans_finds_the_blobs_and_numbers_by_size(spark):
    df = blobs(spark)
    fit = clustering.fit_kmeans(df, COLUMNS, 3, restarts=3)
    sizes = [r["count"] for r in fit.centers.assign(df).groupBy("cluster").count().orderBy("cluster").collect()]
    assert sizes == [60, 30, 10]
    cost = fit.centers.assign(df).agg(F.sum("squared_distance")).first()[0]
    assert cost == pytest.approx(fit.cost)


def test_fixed_start_steps_equal_numpy(spark):
    df = blobs(spark)
    x, _ = matrix(df)
    cuts = np.quantile(x[:, 0], [1 / 3, 2 / 3])
    labels = (x[:, [0]] > cuts).sum(axis=1)
    for _ in range(3):
        centers = np.array([x[labels == k].mean(axis=0) for k in range(3)])
        labels = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    found = clustering.lloyd(df, COLUMNS, 3, "x")
    np.testing.assert_allclose([found.by_cluster[k] for k in range(3)], centers)
    grouped = clustering.grouped_lloyd(
        df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")).withColumn("x", F.col("x") + 100)),
        COLUMNS, {"a": cuts.tolist(), "b": (cuts + 100).tolist()}, "x", "g")
    np.testing.assert_allclose([grouped.by_group["a"].by_cluster[k] for k in range(3)], centers)
    np.testing.assert_allclose([grouped.by_group["b"].by_cluster[k][0] for k in range(3)], centers[:, 0] + 100)


def test_inertia_falls_and_equals_single_fits(spark):
    df = blobs(spark)
    rows = {r["k"]: r["inertia"] for r in clustering.inertia_by_k(df, COLUMNS, range(2, 5), "x").collect()}
    for k, inertia in rows.items():
        one = clustering.lloyd(df, COLUMNS, k, "x").assign(df).agg(F.sum("squared_distance")).first()[0]
        assert inertia == pytest.approx(one)
    elbow = {r["k"]: r for r in clustering.elbow_table(df, COLUMNS, range(1, 5), restarts=2).collect()}
    assert elbow[1]["silhouette"] is None and elbow[1]["inertia"] > elbow[2]["inertia"] > elbow[3]["inertia"]
    assert max(elbow.values(), key=lambda r: r["silhouette"] or -1)["k"] == 3


def brute_silhouette(x, labels, squared):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d = d if squared else np.sqrt(d)
    out = []
    for i, own in enumerate(labels):
        mine = labels == own
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, mine].sum() / (mine.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {own})
        out.append((b - a) / max(a, b))
    return out


def test_silhouettes_equal_brute_force(spark):
    df = blobs(spark, (25, 10, 1))
    labelled = Centers(("x", "y"), {0: (0.0, 0.0), 1: (8.0, 1.0), 2: (3.0, 9.0)}).assign(df).drop("squared_distance")
    x, labels = matrix(labelled)
    for squared, found in ((True, silhouettes.silhouette_samples(labelled, COLUMNS)),
                           (False, silhouettes.euclidean_silhouettes(labelled, COLUMNS))):
        got = [r["silhouette"] for r in found.orderBy("customer_id").collect()]
        np.testing.assert_allclose(got, brute_silhouette(x, labels, squared), atol=1e-9)
    with pytest.raises(ValueError):
        silhouettes.mean_silhouette(labelled.withColumn("cluster", F.lit(0)), COLUMNS)


def test_stratified_sample_is_proportional_and_exact(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("customer_id"), F.when(F.col("id") < 700, 0).when(F.col("id") < 993, 1).otherwise(2).alias("cluster"))
    sample = silhouettes.stratified_sample(rows, 101)
    counts = {r["cluster"]: r["count"] for r in sample.groupBy("cluster").count().collect()}
    assert sample.count() == sample.select("customer_id").distinct().count() == 101
    assert counts[0] in (70, 71, 72) and counts[1] in (29, 30, 31)
    assert silhouettes.stratified_sample(rows, 5000).count() == 1000


def test_importance_equals_brute_force(spark):
    df = blobs(spark)
    centers = Centers(("x", "y"), {0: (0.0, 0.0), 1: (8.0, 1.0), 2: (3.0, 9.0)})
    x, _ = matrix(df)
    spots = np.array([centers.by_cluster[k] for k in range(3)])

    def quality(points):
        labels = ((points[:, None] - spots[None]) ** 2).sum(axis=2).argmin(axis=1)
        return np.mean(brute_silhouette(points, labels, True))

    losses = {0: [], 1: []}
    for repeat in range(3):
        order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"{i}-{repeat}".encode()).hexdigest())
        following = {i: order[(at + 1) % len(order)] for at, i in enumerate(order)}
        for d in (0, 1):
            shuffled = x.copy()
            shuffled[:, d] = [x[following[i], d] for i in range(len(x))]
            losses[d].append(quality(x) - quality(shuffled))
    rows = {r["feature"]: r for r in clustering.permutation_importance(df, centers).collect()}
    for d, name in enumerate(COLUMNS):
        assert rows[name]["importance"] == pytest.approx(np.mean(losses[d]))
        assert rows[name]["std"] == pytest.approx(np.std(losses[d]))


def test_importance_in_buckets_and_on_a_sample(spark):
    df = blobs(spark).withColumn("noise", F.col("customer_id") * 1e-6)
    fit = clustering.fit_kmeans(df, ["x", "y", "noise"], 3, restarts=2)
    rows = clustering.permutation_importance(df, fit.centers, sample_size=90, bucket_rows=40).collect()
    assert len(rows) == 3 and rows[0]["importance"] > abs(rows[-1]["importance"])
    assert rows[-1]["feature"] == "noise" and rows[-1]["importance"] == pytest.approx(0, abs=1e-3)


def test_distances_between_clusters(spark):
    centers = Centers(("x", "y"), {0: (0.0, 0.0), 1: (3.0, 4.0), 2: (0.0, 10.0)})
    labelled = spark.createDataFrame([(0,), (0,), (1,), (2,)], "cluster int")
    rows = {(r["cluster_a"], r["cluster_b"]): r for r in clustering.intercluster_distances(labelled, centers).collect()}
    assert rows[0, 1]["distance"] == 5.0 and rows[0, 1]["normalized_distance"] == 0.5
    assert rows[0, 2]["relative_size_a"] == 1.0 and rows[0, 2]["relative_size_b"] == 0.5


def test_components_equal_numpy(spark):
    df = blobs(spark).withColumn("z", F.col("x") * 0.5 + F.col("y"))
    names = ["x", "y", "z"]
    data = np.array([[r[c] for c in names] for r in df.orderBy("customer_id").collect()])
    values, vectors = np.linalg.eigh(np.cov(data.T))
    found = fit_components(df, names)
    np.testing.assert_allclose(found.variance_ratios[:2], values[::-1][:2] / values.sum(), rtol=1e-6)
    scores = np.array([tuple(r)[1:] for r in found.project(df).orderBy("customer_id").collect()])
    np.testing.assert_allclose(scores.mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(np.abs(scores[:, 0]), np.abs((data - data.mean(axis=0)) @ vectors[:, 2]), atol=1e-6)
    cumulative = [r["cumulative_variance"] for r in found.explained_variance(spark).collect()]
    assert cumulative == sorted(cumulative) and cumulative[-1] == pytest.approx(1)
    assert found.top_loadings(spark, 2).count() == 2
    totals = [r["total_loading"] for r in found.feature_importance(spark, 2).collect()]
    assert totals == sorted(totals, reverse=True)


def test_fits_do_not_depend_on_partitions(spark):
    df = blobs(spark)
    fits = [clustering.fit_kmeans(df.repartition(n), COLUMNS, 3, restarts=4) for n in (1, 4, 16)]
    for fit in fits[1:]:
        assert fit.cost == pytest.approx(fits[0].cost, rel=1e-9)
        for cluster, center in fits[0].centers.by_cluster.items():
            assert fit.centers.by_cluster[cluster] == pytest.approx(center, rel=1e-9)


def test_steps_end_when_no_label_moves(spark):
    df = blobs(spark)
    centers = clustering.lloyd(df, COLUMNS, 3, "x")
    again = df.withColumn("_label", centers.nearest()["cluster"]).groupBy("_label").agg(*[F.avg(c).alias(c) for c in COLUMNS])
    for r in again.collect():
        assert centers.by_cluster[r["_label"]] == pytest.approx(tuple(r[c] for c in COLUMNS), abs=1e-9)


def test_every_row_counts_in_importance(spark):
    df = blobs(spark)
    fit = clustering.fit_kmeans(df, COLUMNS, 3, restarts=2)
    assert clustering.permutation_importance(df, fit.centers).collect() == clustering.permutation_importance(
        df, fit.centers, sample_size=10**9).collect()
