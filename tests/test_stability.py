from itertools import combinations
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.operators import stability
from shoplens.operators.clustering import Centers


def ari(spark, a, b):
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    return stability.adjusted_rand_index(df, "a", "b").first()["ari"]


def brute_ari(a, b):
    n = len(a)
    both = [(a[i] == a[j], b[i] == b[j]) for i, j in combinations(range(n), 2)]
    index = sum(x and y for x, y in both)
    in_a, in_b = sum(x for x, _ in both), sum(y for _, y in both)
    expected, most = in_a * in_b / comb(n, 2), (in_a + in_b) / 2
    return 1.0 if most == expected else (index - expected) / (most - expected)


def test_ari(spark):
    assert ari(spark, [0, 0, 1, 1], [1, 1, 0, 0]) == 1.0
    assert ari(spark, [0, 0, 1, 1], [0, 1, 0, 1]) == pytest.approx(-0.5)
    assert ari(spark, [0, 0, 0], [1, 1, 1]) == 1.0 and ari(spark, [0, 1, 2], [0, 1, 2]) == 1.0
    assert ari(spark, [0, 0, 0], [0, 1, 2]) == 0.0 and ari(spark, [0], [1]) == 1.0
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 4, 40)
    assert ari(spark, a, b) == pytest.approx(ari(spark, b, a)) == pytest.approx(brute_ari(a, b))


def test_pairwise_ari_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    labels = [[None if rng.random() < 0.2 else int(v) for v in rng.integers(0, 3, 3)] for _ in range(60)]
    df = spark.createDataFrame([(row,) for row in labels], "labels array<int>")
    found = {(r["i"], r["j"]): r for r in stability.pairwise_ari(df, 3).collect()}
    for i, j in combinations(range(3), 2):
        common = [(r[i], r[j]) for r in labels if r[i] is not None and r[j] is not None]
        assert found[i, j]["n_common"] == len(common)
        assert found[i, j]["ari"] == pytest.approx(brute_ari(*zip(*common)))
    assert stability.pairwise_ari(df, 3, least_common=61).count() == 0


def customers(spark, n=400):
    rng = np.random.default_rng(8)
    spots = rng.integers(0, 3, n)
    rows = [(i, float(10 * s + rng.normal()), float(5 * (s % 2) + rng.normal())) for i, s in enumerate(spots)]
    return spark.createDataFrame(rows, "customer_id long, x double, y double")


def test_samples_have_the_wanted_size_and_overlap(spark):
    df = spark.range(5000).withColumnRenamed("id", "customer_id")
    members = stability.bootstrap_samples(df, n_iterations=3)
    sizes = [r["count"] for r in members.groupBy("iteration").count().collect()]
    assert all(abs(s / 5000 - 0.8) < 0.03 for s in sizes)
    a, b = (members.where(f"iteration = {i}").select("customer_id") for i in (0, 2))
    assert abs(a.intersect(b).count() / 5000 - 0.64) < 0.03
    assert stability.bootstrap_samples(df, n_iterations=1, fraction=1.0).count() == 5000
    with pytest.raises(ValueError):
        stability.sample_cuts(df, fraction=0.0)


@pytest.mark.parametrize("n, fraction", [(5003, 0.8), (7, 0.5), (1, 0.8), (40, 1.0)])
def test_samples_have_exact_size_and_equal_a_plain_ranking(spark, n, fraction):
    import hashlib
    rows = [(k,) for k in range(n)] + [(None,)]
    df = spark.createDataFrame(rows, "customer_id long")
    members = stability.bootstrap_samples(df, n_iterations=3, fraction=fraction)
    got = {(r["iteration"], r["customer_id"]) for r in members.collect()}
    want = set()
    for i in range(3):
        ranked = sorted(range(n), key=lambda k: (hashlib.md5(f"{k}-{i}".encode()).hexdigest(), k))
        want |= {(i, k) for k in ranked[:int(fraction * n)]}
    assert got == want


def test_clear_blobs_are_stable(spark):
    scores = stability.bootstrap_stability(customers(spark), ["x", "y"], 3, n_iterations=4, restarts=3)
    summary = stability.ari_summary(scores).first()
    assert summary["n_pairs"] == 6 and summary["mean_ari"] > 0.95


def dated(spark, df):
    day = F.when(F.col("customer_id") % 2 == 0, "2020-01-05").otherwise("2020-05-05")
    first = df.select("customer_id", day.cast("timestamp_ntz").alias("order_purchase_timestamp"))
    again = df.select("customer_id", F.lit("2020-08-01").cast("timestamp_ntz").alias("order_purchase_timestamp"))
    return first.unionByName(again)


def test_stability_over_time(spark):
    df = customers(spark)
    result = stability.temporal_stability(df, dated(spark, df), ["x", "y"], 3, "quarter", restarts=3)
    scores = {(r["from_period"], r["to_period"]): r for r in result.scores.collect()}
    assert scores.keys() == {("2020Q2", "2020Q3")} and scores["2020Q2", "2020Q3"]["n_common"] == 200
    assert scores["2020Q2", "2020Q3"]["ari"] > 0.95
    cells = result.migration.collect()
    assert len(cells) == 9
    for a in range(3):
        assert sum(r["percentage"] for r in cells if r["from_cluster"] == a) == pytest.approx(100)
    assert {r["period"]: r["n_customers"] for r in result.counts.collect()} == {"2020Q1": 200, "2020Q2": 200, "2020Q3": 400}


def test_migration_from_an_empty_cluster_is_zero(spark):
    cells = spark.createDataFrame([("a", "b", 0, 1, 12)], "from_period string, to_period string, a int, b int, n long")
    rows = {(r["from_cluster"], r["to_cluster"]): r["percentage"] for r in stability.migration_matrices(cells, 2).collect()}
    assert rows == {(0, 0): 0.0, (0, 1): 100.0, (1, 0): 0.0, (1, 1): 0.0}
    assert stability.migration_matrices(cells, 2, least_common=13).count() == 0


def test_cross_period_stability(spark):
    df = customers(spark)
    result = stability.cross_period_stability(
        df, dated(spark, df), ["x", "y"], 3, "quarter", sample_size=50, minimum=10, restarts=3)
    rows = result.scores.collect()
    assert result.largest_period == "2020Q3" and len(rows) == 3
    assert all(r["n_common"] == 50 and r["ari"] > 0.9 for r in rows)
    none = stability.cross_period_stability(df, dated(spark, df), ["x", "y"], 3, "year", minimum=1000)
    assert none.error and none.scores is None and none.counts.count() == 1


def test_bad_arguments(spark):
    df = customers(spark, 20)
    with pytest.raises(ValueError):
        stability.temporal_stability(df, None, ["x"])
    with pytest.raises(ValueError):
        stability.cross_period_stability(df, df, ["x"], period="quarter")
    with pytest.raises(ValueError):
        stability.temporal_stability(df, dated(spark, df), ["x"], period="week")


def test_labels_are_missing_outside_the_sample(spark):
    df = customers(spark, 50)
    centers = Centers(("x", "y"), {0: (0.0, 0.0), 1: (20.0, 0.0)})
    rows = stability.labelled_samples(df, [centers, centers], "customer_id", 0.5).collect()
    members = {(r["iteration"], r["customer_id"]) for r in stability.bootstrap_samples(df, n_iterations=2, fraction=0.5).collect()}
    for r in rows:
        for i, label in enumerate(r["labels"]):
            assert (label is not None) == ((i, r["customer_id"]) in members)


def test_steps_read_each_row_once_for_all_models(spark, monkeypatch):
    """Values of k and samples are models over the same rows: no row is repeated per model in the steps."""
    from shoplens.operators import clustering
    sizes, real = [], clustering.converge

    def spy(df, *args, **kwargs):
        sizes.append(df.count())
        return real(df, *args, **kwargs)

    monkeypatch.setattr(clustering, "converge", spy)
    df = spark.range(60).selectExpr("id AS customer_id", "cast(id % 7 AS double) AS a", "cast(id * id AS double) AS b")
    found = clustering.inertia_by_k(df, ["a", "b"], [2, 3, 4], "b").collect()
    assert sizes == [60] and sorted(r["k"] for r in found) == [2, 3, 4]
