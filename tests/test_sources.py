import pytest
from pyspark.sql import functions as F

from shoplens.sources import catalog
from shoplens.sources.store import ResultStore

FOLDER = "/root/testdata/sf0.001"


def test_store_keeps_the_first_result(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}")
    assert store.load("a") is None
    first = store.fetch("my key/1", lambda: spark.range(3))
    again = store.fetch("my key/1", lambda: spark.range(99))
    assert first.count() == again.count() == 3
    assert store.fetch("mykey1", lambda: spark.range(4)).count() == 4
    assert store.fetch("my key/1", lambda: spark.range(5), folder="b").count() == 5
    store.clear()
    assert store.load("my key/1") is None


def test_results_without_a_shared_folder_are_persisted_once(spark, monkeypatch):
    store = ResultStore(spark)
    store.root = None
    built = []
    first = store.fetch("k", lambda: built.append(1) or spark.range(7))
    assert store.fetch("k", lambda: built.append(1) or spark.range(8)) is first and built == [1]
    assert first.count() == 7 and first.is_cached
    store.clear()
    assert not first.is_cached and store.load("k") is None


def test_kept_sql_and_tables(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}")
    text = "SELECT uuid() AS u"
    one, two = (catalog.run_sql(spark, text, store, "u").first()[0] for _ in range(2))
    assert one == two != catalog.run_sql(spark, text).first()[0]
    assert catalog.run_sql(spark, text + " WHERE true", store, "u").first()[0] != one
    with pytest.raises(ValueError):
        catalog.run_sql(spark, text, cache_key="u")
    assert catalog.scan(spark, FOLDER, "nation", store).count() == 25 and store.load("table nation", folder=FOLDER) is not None


def test_unfinished_write_is_not_a_result(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}")
    store.fetch("k", lambda: spark.range(3))
    next(p for p in tmp_path.rglob("_SUCCESS")).unlink()
    assert ResultStore(spark, f"file://{tmp_path}").load("k") is None


def test_failed_write_warns_and_goes_on(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}")
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).cast("string").alias("x"))
    with pytest.warns(UserWarning):
        assert store.fetch("k", lambda: bad) is bad


def test_shared_folder_of_the_cluster_is_used(spark):
    assert ResultStore(spark).root.startswith(spark.conf.get("spark.checkpoint.dir") + "/shoplens-")


def test_catalog(spark):
    catalog.register_views(spark, FOLDER, ["region", "nation"])
    assert {"region", "nation"} <= set(catalog.table_names(spark))
    assert catalog.run_sql(spark, "SELECT count(*) FROM nation").first()[0] == 25
    assert [r["n_regionkey"] for r in catalog.preview(spark.table("nation"), "n_nationkey", 2).collect()] == [0, 1]
    assert tuple(catalog.inventory({"r": spark.table("region")}).first()) == ("r", 5, 2)
    with pytest.raises(ValueError):
        catalog.inventory({})

