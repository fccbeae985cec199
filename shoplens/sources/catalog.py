"""Tables: listing, scanning, previewing, and running a SQL text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.sources.store import ResultStore

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def scan(spark: SparkSession, folder: str, name: str, store: ResultStore | None = None) -> DataFrame:
    """Whole table, lazily; Catalyst prunes columns and pushes filters into the file scan.

    With a store the table is read once and later reads come from there, for sources that are slow to read again.
    """
    df = spark.read.parquet(table_path(folder, name))
    return df if store is None else store.fetch(f"table {name}", lambda: df, folder=folder)


def register_views(spark: SparkSession, folder: str, names: Sequence[str] = TABLES) -> None:
    """Make each table a temporary view, so that SQL text can name it."""
    for name in names:
        scan(spark, folder, name).createOrReplaceTempView(name)


def table_names(spark: SparkSession) -> list[str]:
    """Sorted names of the tables and views of the session."""
    return sorted(t.name for t in spark.catalog.listTables())


def inventory(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: name, number of rows and of columns."""
    if not tables:
        raise ValueError("no tables given")
    rows = [
        df.agg(F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def preview(df: DataFrame, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows by key. The order is explicit, since a distributed table has none."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)


def run_sql(spark: SparkSession, text: str, store: ResultStore | None = None, cache_key: str | None = None,
            **parameters) -> DataFrame:
    """Result of a SQL text. With a store and a key it is kept: the same key, text and parameters (such as the folder
    of the tables) give the kept result."""
    if cache_key is None:
        return spark.sql(text)
    if store is None:
        raise ValueError("a cache key needs a store")
    return store.fetch(cache_key, lambda: spark.sql(text), text=text, **parameters)
