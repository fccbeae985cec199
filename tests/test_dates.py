import pytest
from pyspark.sql import functions as F

from shoplens.functions import dates


def moments(spark, *pairs):
    rows = ", ".join(f"(timestamp_ntz'{a}', timestamp_ntz'{b}')" for a, b in pairs)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(a, b)")


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_month_overflow_runs_into_next_month(spark):
    df = moments(spark, ("2018-05-31 10:00:00", "2018-08-29 15:00:37"))
    assert str(one(df, dates.months_before(F.col("a"), 3))[0]) == "2018-03-03 00:00:00"
    assert str(one(df, dates.months_before(F.col("b"), 3))[0]) == "2018-05-29 00:00:00"


def test_whole_days_truncate_and_floor_days_round_down(spark):
    df = moments(spark, ("2018-08-26 15:00:38", "2018-08-29 15:00:37"), ("2018-08-01 12:00:00", "2018-08-01 00:00:00"),
                 ("2018-08-03 00:00:00", "2018-08-01 00:00:00"))
    assert one(df, dates.whole_days(F.col("a"), F.col("b"))) == [2, 0, -2]
    assert one(df, dates.floor_days(F.col("a"), F.col("b"))) == [2, -1, -2]


def test_period_labels(spark):
    df = moments(spark, ("2018-08-26 15:00:38", "2018-08-29 15:00:37"))
    assert [one(df, dates.period_label(F.col("a"), p))[0] for p in dates.PERIODS] == ["2018-08", "2018Q3", "2018"]
    assert [str(one(df, dates.period_start(F.col("a"), p))[0]) for p in dates.PERIODS] == [
        "2018-08-01", "2018-07-01", "2018-01-01"]
    with pytest.raises(ValueError):
        dates.period_label(F.col("a"), "week")
