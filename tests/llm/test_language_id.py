"""Language identification by zstandard dictionaries: held-out accuracy and odd inputs."""

import pandas as pd
from pyspark.sql import functions as F

from shoplens.llm import language_id
from shoplens.llm.queries import op12_language_id


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = op12_language_id(spark, folder).toPandas()
    docs = pd.read_parquet(f"{folder}/documents.parquet")[["doc_id", "lang", "text"]]
    assert len(got) == len(docs) and got["doc_id"].is_unique
    both = got.merge(docs, on="doc_id")
    held = both[both["held_out"]]
    assert 200 < len(held) < 300
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.88
    assert set(both["lang_pred"]) <= set(docs["lang"].dropna()) | {"und"}
    assert both["score"].between(0, 1).all()
    confident = held[~held["rejected"]]
    assert (confident["lang_pred"] == confident["lang"]).mean() >= (held["lang_pred"] == held["lang"]).mean()


def test_odd_texts(spark):
    train = spark.createDataFrame([("en", "the cat and the dog with the bird " * 20), ("fr", "le chat et le chien avec l'oiseau " * 20),
                                   ("de", "die Katze und der Hund mit dem Vogel " * 20)], "lang string, text string")
    dicts = language_id.dictionaries(train)
    assert sorted(dicts) == ["de", "en", "fr"] and all(len(d) <= language_id.DICT_BYTES for d in dicts.values())
    rows = [(1, None, "x"), (2, "", "y"), (3, "1234 !!", "z"), (4, "the dog and the cat " * 5000, "w"), (5, "le chien et le chat", "v"),
            (5, "le chien et le chat", "v"), (None, "die Katze und der Hund", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = language_id.predicted(docs.withColumnRenamed("lang_pred", "lang"), dicts).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["de", "und", "und", "und", "en", "fr", "fr"]
    assert [r.lang for r in got][:2] == [None, "x"]
    assert got[1].score == 0.0 and got[1].rejected
    assert got[5].score == got[6].score


def test_empty_and_unlearned(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert language_id.dictionaries(empty) == {}
    docs = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.predicted(docs, {}).collect()] == ["und"]
    assert language_id.predicted(docs.where(F.lit(False)), {"en": b"the"}).count() == 0
