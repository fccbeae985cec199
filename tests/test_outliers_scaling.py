import pytest

from shoplens.operators import outliers, scaling
from shoplens.operators.features import hybrid_features


def doubles(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} double" for n in names))


def test_summary_counts_and_clean_moments(spark):
    x = [float(i) for i in range(1, 21)] + [500.0, None]
    df = doubles(spark, x=x, c=[1.0] * 22, e=[None] * 22)
    rows = {(r["method"], r["feature"]): r for r in outliers.outlier_summary(df, ["x", "c", "e"]).collect()}
    assert len(rows) == 12
    r = rows[outliers.IQR, "x"]
    assert (r["outlier_count"], r["above_max"], r["below_min"], r["extreme_max"], r["extreme_min"]) == (1, 1, 0, 500.0, None)
    assert r["mean_without"] == 10.5 and r["median_without"] == 10.5 and r["median_with"] == 11.0
    assert r["mean_pct_change"] == pytest.approx((710 / 21 - 10.5) / 10.5 * 100)
    assert all(r["below_min"] + r["above_max"] == r["outlier_count"] for r in rows.values())
    assert all(rows[outliers.FULL_RANGE, c]["outlier_count"] == 0 for c in ("x", "c"))
    assert rows[outliers.Z3, "c"]["skewness"] == 0.0


def test_cleaning_keeps_rows_and_hybrid_restores(spark):
    df = doubles(spark, x=[1.0] * 20 + [100.0], frequency=[1.0] * 20 + [50.0])
    limits = outliers.outlier_limits(df, ["x", "frequency"], [outliers.Z3])[outliers.Z3]
    cleaned = outliers.without_outliers(df, limits)
    assert cleaned.count() == 21 and cleaned.where("x IS NULL AND frequency IS NULL").count() == 1
    hybrid = hybrid_features(df, outliers.cleaned_columns(limits))
    assert hybrid.where("x IS NULL AND frequency = 50").count() == 1


def test_unknown_variable_warns(spark):
    with pytest.warns(UserWarning):
        assert outliers.method_comparison(doubles(spark, x=[1.0]), "y") is None


def test_single_value_has_no_deviation_limits(spark):
    df = doubles(spark, x=[5.0])
    limits = outliers.outlier_limits(df, ["x"])
    assert limits[outliers.Z3]["x"] == (None, None)
    assert outliers.without_outliers(df, limits[outliers.Z3]).first()["x"] == 5.0


def people(spark):
    return spark.createDataFrame(
        [(1, 0, 2, 10.0, "b"), (2, 1, 0, 20.0, "a"), (3, 1, None, None, None), (4, None, 5, 40.0, "b"), (5, 0, 9, 90.0, "a")],
        "customer_id long, flag long, n long, amount double, kind string")


def test_transform_order_names_and_round_trip(spark):
    df = people(spark)
    model = scaling.fit_scaler(df, ["flag", "kind"], ["n"])
    out = model.transform(df)
    assert out.columns == ["customer_id", "flag_0.0", "flag_1.0", "kind_a", "kind_b", "n", "amount"]
    assert model.output_columns() == out.columns[1:]
    assert model.output_counts() == {"categorical": 4, "count": 1, "timestamp": 0, "numerical": 1}
    assert model.fills == {"flag": 0, "kind": "a", "n": 3.5, "amount": 30.0}
    rows = {r["customer_id"]: r for r in out.collect()}
    assert tuple(rows[4])[1:3] == (1.0, 0.0) and tuple(rows[3])[3:5] == (1.0, 0.0)
    assert rows[1]["amount"] == (10 - 30) / 20
    back = {r["customer_id"]: r for r in model.inverse_transform(out).collect()}
    assert back[5]["n"] == 9 and back[5]["amount"] == pytest.approx(90.0) and back[3]["n"] == 4


def test_unknown_category_gives_zeros(spark):
    model = scaling.fit_scaler(people(spark).select("customer_id", "kind"), ["kind"], [])
    new = spark.createDataFrame([(9, "z")], "customer_id long, kind string")
    assert tuple(model.transform(new).first()) == (9, 0.0, 0.0)


def test_column_without_spread_keeps_its_unit(spark):
    df = doubles(spark, x=[1.0] * 9 + [4.0])
    out = scaling.fit_scaler(df, [], [], keys=()).transform(df, keep=())
    assert sorted(r["x"] for r in out.collect()) == [0.0] * 9 + [3.0]


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(2,), (2,), (1,), (1,), (3,)], "x long")
    assert (scaling.learn_categories(df, "x"), scaling.learn_mode(df, "x")) == ([1, 2, 3], 1)


def test_roles_are_detected(spark):
    rows = [(i, i % 3, i, -1, f"k{i % 2}", i / 2) for i in range(100)]
    df = spark.createDataFrame(rows, "customer_id long, few long, many long, negative long, kind string, part double")
    roles = scaling.detect_roles(df)
    assert roles.categorical == ("kind",) and roles.count == ("few",)
    assert roles.numerical == ("many", "negative", "part")
    with pytest.raises(ValueError):
        scaling.detect_roles(df, categorical=[])
    with pytest.raises(ValueError):
        scaling.detect_roles(df, count=["missing"])


def test_timestamps_become_parts(spark):
    df = spark.sql("SELECT 1L AS customer_id, timestamp_ntz'2024-05-06 10:00:00' AS t")
    model = scaling.fit_scaler(df, [], [], "t")
    assert tuple(model.transform(df).first()) == (1, 0.0, 5.0, 2.0)
    assert model.output_columns() == ["t_day_of_week", "t_month", "t_quarter"]


def test_unfitted_scaler_is_an_error(spark):
    scaler = scaling.GenericScaler()
    with pytest.raises(ValueError):
        scaler.transform(people(spark))
    assert scaler.fit_transform(people(spark), categorical=["flag", "kind"], count=["n"]).count() == 5
    assert scaler.transform(people(spark)).count() == 5


def test_result_does_not_depend_on_partitions(spark):
    df = people(spark)
    a = scaling.fit_scaler(df, ["flag", "kind"], ["n"]).transform(df)
    b = scaling.fit_scaler(df.repartition(7), ["flag", "kind"], ["n"]).transform(df.repartition(3))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_empty_column_cannot_be_learned(spark):
    df = spark.createDataFrame([(1, None)], "customer_id long, x double")
    with pytest.raises(ValueError):
        scaling.fit_scaler(df, [], [])
