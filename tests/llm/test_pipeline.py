"""Every stage of the pipeline against a brute-force version, on the smallest tables."""

from collections import Counter

import duckdb
import numpy as np
import pytest
from test_simhash import slow_classes, slow_fingerprint

import corpus_pipeline
from shoplens.llm import quality_model, sentencepiece_unigram
from shoplens.llm.oracles import MIXING

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each, as (doc_id, ...) tuples by column."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    out.append(docs.toPandas())
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(f"file://{folder}/{number}")
        docs = spark.read.parquet(f"file://{folder}/{number}")
        out.append(docs.toPandas())
    return out


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources", "SentencePiece"]
    for frame in stages[1:5]:
        assert list(frame.columns) == list(stages[0].columns) and frame.dtypes.equals(stages[0].dtypes)


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality_model.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {d for d, t in zip(stages[0].doc_id, stages[0].text) if model.scores([quality_model.passages(t)])[0] >= 0.3}
    assert sorted(stages[1].doc_id) == sorted(want) and 0 < len(want) < len(stages[0])
    labels = dict(spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").collect())
    assert np.mean([(d in want) == bool(labels[d]) for d in labels]) > 0.95


def test_exact_dedup(stages):
    want = {}
    for d, t in zip(stages[1].doc_id, stages[1].text):
        want[t] = max(d, want.get(t, d))
    assert sorted(stages[2].doc_id) == sorted(want.values())


def test_near_dedup(stages):
    ids = list(stages[2].doc_id)
    label = slow_classes([slow_fingerprint(t) for t in stages[2].text], 4)
    smallest = {}
    for d, l in zip(ids, label):
        smallest[l] = min(d, smallest.get(l, d))
    assert sorted(stages[3].doc_id) == sorted(smallest.values())


def test_mixing(stages):
    connection = duckdb.connect()
    frame = stages[3]  # noqa: F841 - read by the query
    connection.execute("CREATE TABLE mixing_input AS SELECT doc_id, source, coalesce(text, '') AS body FROM frame")
    want = {d: n for d, n in connection.execute(f"WITH {MIXING.strip().rstrip(',')} SELECT doc_id, copies FROM mixed").fetchall() if n}
    assert Counter(stages[4].doc_id) == want and max(want.values()) <= 2


def test_encoding(stages):
    vocabulary = sentencepiece_unigram.load()
    assert sorted(stages[5].doc_id) == sorted(stages[4].doc_id) and stages[5].restored.all()
    for text, pieces in zip(stages[5].text, stages[5].pieces):
        assert vocabulary.encode(text) == list(pieces) and vocabulary.decode(pieces) == text


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert list(got.columns) == list(stages[5].columns)
    assert sorted(zip(got.doc_id, got.n_pieces)) == sorted(zip(stages[5].doc_id, stages[5].n_pieces))
