"""Frame helpers: quoting, numeric columns, long form, small driver-made tables, top rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by exact name; one-hot names such as ``flag_1.0`` hold a dot."""
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ("customer_id",)) -> list[str]:
    """Names of the numeric columns, in schema order, without the excluded ones."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def chosen_columns(df: DataFrame, columns: Sequence[str] | None, keys: Iterable[str] = ()) -> list[str]:
    """The given columns, or all numeric ones that are no key."""
    return numeric_columns(df, {"customer_id", *keys}) if columns is None else list(columns)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (),
         drop_missing: bool = True) -> DataFrame:
    """Long form: the keys, ``feature`` and ``value`` (double)."""
    typed = df.select(*[col(k) for k in keys], *[col(c).cast("double").alias(c) for c in columns])
    long = typed.unpivot([col(k) for k in keys], [col(c) for c in columns], "feature", "value")
    return long.where(F.col("value").isNotNull()) if drop_missing else long


def small_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A driver-made table as a local relation, whose size Spark knows when it plans a join."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def spread_out(df: DataFrame, least_rows: int = 1_000, most_rows: int = 1_000_000) -> DataFrame:
    """Partitions that keep every core busy on a small table and stay bounded in rows on a large one.

    For tables that many compute-heavy steps read again; adaptive execution sizes partitions by bytes
    and would leave a small table in one.
    """
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, math.ceil(n / most_rows), min(cores, math.ceil(n / least_rows))))


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column, so results do not depend on the order of additions."""
    return df.select([
        F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else col(f.name)
        for f in df.schema.fields
    ])

