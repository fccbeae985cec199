"""Every registered query with SQL is run against DuckDB on the smallest tables."""

import pytest

import __spark_entry__
from check_oracles import compare, duckdb_tables
from shoplens.plans.oracles import oracle_texts
from shoplens.plans.registry import registered_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, TEXTS = registered_queries(), oracle_texts()
@pytest.fixture(scope="module")
def tables():
    return duckdb_tables(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(TEXTS)


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_query_equals_sql(spark, tables, name):
    good, note = compare(spark, tables, FOLDER, name, QUERIES[name], TEXTS[name])
    assert good and "TYPES" not in note, note


def test_entry_point_offers_them_all():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(TEXTS) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 145
