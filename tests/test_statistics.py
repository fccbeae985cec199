import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.functions.moments import corrected_skewness
from shoplens.functions.quantiles import grouped_quantiles, quantile_table, quantiles_at, quantiles_by_feature
from shoplens.operators import profiling


def doubles(spark, **columns):
    names = list(columns)
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def test_quantile_interpolates(spark):
    df = doubles(spark, x=[1.0, 2.0, 3.0, 10.0])
    assert quantiles_by_feature(df, ["x"], [0.25])["x"] == [1.75]


PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("bins", [2, 16, 4096])
def test_quantiles_equal_numpy_on_skewed_groups(spark, monkeypatch, bins):
    monkeypatch.setattr("shoplens.functions.quantiles.BINS", bins)
    rng = np.random.default_rng(7)
    groups = {
        "heavy": np.exp(rng.normal(8, 3, 4000)), "ties": rng.integers(0, 3, 1500).astype(float),
        "constant": np.full(300, 4.0), "tiny": np.array([5.0, -1.0]), "single": np.array([2.5]),
        "hot": np.concatenate([np.full(2000, 7.0), rng.normal(7, 1e-3, 1000)]),
        "wide": np.array([-1.7e308, -1e-300, 0.0, 5e-324, 1e-9, 1.0, 1.7e308])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    long = spark.createDataFrame(rows, "g string, value double").repartition(5)
    found = {r["g"]: r for r in grouped_quantiles(long, ["g"], PROBS).collect()}
    assert found.keys() == groups.keys()
    for g, values in groups.items():
        assert found[g]["n"] == len(values)
        if g != "wide":
            np.testing.assert_allclose(found[g]["quantiles"], np.quantile(values, PROBS), rtol=1e-12, err_msg=g)
    assert found["wide"]["quantiles"][3] == 5e-324


def test_values_at_ranks_that_differ_by_column(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=500), rng.normal(size=500)
    found = quantiles_at(doubles(spark, a=a.tolist(), b=b.tolist()), {"a": [3, 10.5], "b": [0, 499]})
    a.sort(), b.sort()
    np.testing.assert_allclose(found["a"], [a[3], (a[10] + a[11]) / 2])
    np.testing.assert_allclose(found["b"], [b[0], b[499]])


def test_quantile_table_skips_missing_values(spark):
    df = doubles(spark, x=[1.0, None, 3.0], y=[None, None, None])
    rows = quantile_table(df, ["x", "y"], [0.5]).collect()
    assert [(r["feature"], r["n"], list(r["quantiles"])) for r in rows] == [("x", 2, [2.0])]


def test_skewness_is_corrected(spark):
    df = doubles(spark, x=[1.0, 2.0, 3.0, 10.0], c=[2.0, 2.0, 2.0, 2.0], few=[1.0, 5.0, None, None])
    row = df.agg(*[corrected_skewness(F.col(c)).alias(c) for c in df.columns]).first()
    assert row["x"] == pytest.approx(1.7636, abs=1e-4)
    assert row["c"] == 0.0 and row["few"] is None


def test_correlation_is_pairwise_and_null_for_constants(spark):
    df = doubles(spark, x=[1.0, 2.0, 3.0, None], y=[2.0, 4.0, 7.0, 1.0], c=[1.0, 1.0, 1.0, 1.0])
    cells = {(r["feature_x"], r["feature_y"]): r["correlation"] for r in profiling.correlation_matrix(df, df.columns).collect()}
    assert len(cells) == 9 and cells["x", "x"] == 1.0
    assert cells["x", "y"] == cells["y", "x"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert cells["x", "c"] is None and cells["c", "c"] is None
    lower = profiling.lower_triangle(profiling.correlation_matrix(df, df.columns)).collect()
    assert {(r["feature_x"], r["feature_y"]) for r in lower} == {("y", "x"), ("c", "x"), ("c", "y")}


def test_covariance(spark):
    x, y = [1.0, 2.0, 4.0], [3.0, 1.0, 9.0]
    cells = {(r["feature_x"], r["feature_y"]): r["covariance"]
             for r in profiling.covariance_matrix(doubles(spark, x=x, y=y), ["x", "y"]).collect()}
    expected = np.cov(x, y)
    assert cells["x", "y"] == pytest.approx(expected[0, 1]) and cells["y", "y"] == pytest.approx(expected[1, 1])


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500), [0.1 * i for i in range(20)]])
    df = doubles(spark, x=values.tolist(), c=[3.0] * len(values))
    rows = profiling.feature_histograms(df, ["x", "c"], 20).orderBy("feature", "bin").collect()
    counts, edges = np.histogram(values, 20)
    assert [r["n"] for r in rows if r["feature"] == "x"] == counts.tolist()
    np.testing.assert_allclose([r["bin_start"] for r in rows if r["feature"] == "x"], edges[:-1], atol=1e-12)
    assert sum(r["n"] for r in rows if r["feature"] == "c") == len(values)


def test_density_integrates_to_one(spark):
    df = doubles(spark, x=[float(i) for i in range(100)], c=[1.0] * 100)
    rows = profiling.density_histogram(df, ["x", "c"]).collect()
    x = [r for r in rows if r["feature"] == "x"]
    assert len(x) == profiling.sturges_bins(100) == 10
    assert sum(r["density"] for r in x) * 9.9 == pytest.approx(1.0)
    assert all(r["normal_density"] is None for r in rows if r["feature"] == "c")


def test_box_statistics(spark):
    df = doubles(spark, x=[1.0, 2.0, 3.0, 4.0, 100.0])
    r = profiling.box_statistics(df, ["x"]).first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["mean"]) == (2, 3, 4, 1, 7, 22)


def test_column_summary_leaves_empty_columns_out(spark):
    df = doubles(spark, x=[1.0, 2.0, 3.0], y=[-1.0, 2.0, 3.0], e=[None, None, None])
    rows = {r["feature"]: r for r in profiling.column_summary(df, df.columns, use_log_scale=True).collect()}
    assert rows.keys() == {"x", "y"} and rows["x"]["can_use_log"] and not rows["y"]["can_use_log"]


def test_top_variance(spark):
    df = doubles(spark, a=[1.0, 2.0], b=[1.0, 9.0], c=[1.0, 1.0])
    assert [r["feature"] for r in profiling.top_variance_features(df, ["a", "b", "c"], 2).collect()] == ["b", "a"]
