"""Steps that settle whole cells give the centres, sizes and costs of plain steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.operators import lloyd_cells
from shoplens.operators.lloyd_steps import converge, starting_rows


def frame(spark, seed=1):
    rng = np.random.default_rng(seed)
    points = np.concatenate([rng.normal(c, 0.4, (700, 3)) for c in ([0, 0, 0], [3, 3, 0], [0, 4, 4], [5, 0, 1])])
    points = np.concatenate([points, points[:50], np.tile([[1.5, 1.5, 0.0]], (30, 1))])  # repeated rows and ties
    rows = [(i, *map(float, p), 7.0) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "customer_id long, a double, b double, c double, flat double")
    groups = F.filter(F.array(F.lit("all"), F.when(F.col("customer_id") % 3 == 0, "third"),
                              F.when(F.col("customer_id") == 5, "one")), lambda g: g.isNotNull())
    return df, groups


@pytest.mark.parametrize("columns", [["a", "b", "c"], ["a", "flat"]])
def test_equal_to_plain_steps(spark, columns):
    df, groups = frame(spark)
    starts = starting_rows(df, columns, 4, 3, "customer_id", groups)
    models = {f"{g}-{r}": (g, dict(enumerate(s))) for g, own in starts.items() for r, s in enumerate(own)}
    plain = converge(df, columns, models, groups, cells=False)
    cells = converge(df, columns, models, groups, cells=True)
    assert plain.keys() == cells.keys() and "one-0" in plain
    for name, want in plain.items():
        got = cells[name]
        assert got.sizes == want.sizes and got.steps == want.steps
        assert abs(got.cost - want.cost) <= 1e-9 * max(want.cost, 1.0)
        for c, at in want.centers.items():
            assert np.allclose(got.centers[c], at, rtol=0, atol=1e-9)
        assert len(got.read) == got.steps and all(0 <= r <= 1 for r in got.read)
    assert min(cells["all-0"].read) < 0.5  # most rows settled by their cell in later steps


def test_settle_is_conservative():
    stats = {"lo": np.array([[0.0, 0.0], [0.9, 0.0]]), "hi": np.array([[0.4, 1.0], [1.1, 1.0]])}
    centers = np.array([[0.0, 0.5], [2.0, 0.5]])
    assert lloyd_cells.settle(stats, centers).tolist() == [0, -1]  # the bisector x = 1 cuts the second box
    centers = np.array([[0.0, 0.5], [2.0, 0.5], [1.0, 0.5]])
    assert lloyd_cells.settle(stats, centers).tolist() == [0, 2]
    tie = {"lo": np.array([[1.0, 0.0]]), "hi": np.array([[1.0, 0.0]])}
    assert lloyd_cells.settle(tie, np.array([[0.0, 0.0], [2.0, 0.0]])).tolist() == [-1]


def test_rows_are_made_once_for_all_steps(spark):
    df, _ = frame(spark)
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def everyone(_):
        made.add(1)
        return ["all"]

    found = converge(df, ["a", "b"], {"m": ("all", {0: (0.0, 0.0), 1: (0.5, 0.1), 2: (0.6, 0.2)})}, everyone("customer_id"))["m"]
    assert found.steps > 3 and sum(found.sizes.values()) == df.count()
    assert made.value <= 2 * df.count()


def test_step_equals_differences_with_ties_and_missing_numbers(spark):
    """Labels by products are those of summed squared differences, far from the origin and on ties too."""
    rng = np.random.default_rng(4)
    points = 1e7 + rng.integers(0, 4, (500, 2)).astype(float)
    points[0, 0] = np.inf
    centers = {3: (1e7, 1e7), 5: (1e7 + 2, 1e7), 8: (1e7 + 3, 1e7 + 3)}
    df = spark.createDataFrame([tuple(map(float, p)) for p in points], "a double, b double")
    got = converge(df, ["a", "b"], {"m": ("all", centers)}, F.array(F.lit("all")), 1)["m"]
    distance = np.stack([((points - np.array(centers[c])) ** 2).sum(axis=1) for c in (3, 5, 8)])
    label = distance.argmin(axis=0)
    assert got.sizes == {c: int((label == j).sum()) for j, c in enumerate((3, 5, 8)) if (label == j).any()}
    assert np.allclose(got.centers[8], points[label == 2].mean(axis=0), rtol=0, atol=1e-6)


def test_starts_are_the_rows_of_least_hash(spark):
    df, groups = frame(spark)
    df = df.unionByName(df.where("customer_id < 40").withColumn("a", F.col("a") - 1)).unionByName(
        df.limit(1).withColumn("customer_id", F.lit(None).cast("long")))
    starts = starting_rows(df, ["a", "b"], 11, 2, "customer_id", groups, seed=3)
    assert set(starts) == {"all", "third", "one"}
    for g, own in starts.items():
        members = df.where(F.array_contains(groups, g))
        for r, j in ((0, 0), (0, 10), (1, 4)):
            digest = F.md5(F.concat(F.col("customer_id").cast("string"), F.lit(f"-{3 + r}-{j // 10}")))
            place = F.concat(F.substring(digest, 3 * (j % 10) + 1, 3), digest)
            want = members.agg(F.min(F.struct(place, F.array("a", "b").alias("at")))["at"].alias("at")).first()["at"]
            assert own[r][j] == tuple(want)
