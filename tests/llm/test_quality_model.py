"""The classifier's gradients, its held-out accuracy, and how it treats odd inputs."""

import zlib

import numpy as np
import pytest

from shoplens.llm import quality_model as q
from shoplens.llm.queries import llm_queries


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, q.FEATURES)) for n in (1, 3, 5)]
    labels = np.array([0.0, 1.0, 1.0])
    model = q.fit(bags, labels, steps=3)
    rows, starts = np.concatenate(bags), np.array([0, 1, 4])
    def loss():
        p = model.forward(rows, starts)["score"]
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))
    slopes = q._gradients(model, rows, starts, labels)
    for name, w in model.weights.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in w.shape)
            held = w[at]
            w[at] = held + 1e-5
            up = loss()
            w[at] = held - 1e-5
            down, w[at] = loss(), held
            assert slopes[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for k in range(300):
        bag = rng.normal(size=(8, q.FEATURES))
        bag[:, 0] = 0
        if k % 2:
            bag[rng.integers(8), 0] = 6
        bags.append(bag)
        labels.append(float(k % 2))
    model = q.fit(bags[:200], np.array(labels[:200]))
    assert np.mean((model.scores(bags[200:]) > 0.5) == np.array(labels[200:])) > 0.9
    shares = [model.forward(b, np.array([0]))["share"][b[:, 0].argmax()] for b in bags[201::2]]
    assert np.mean(shares) > 0.3


def test_passages():
    text = "Word " * 130 + "\n" + "X!! " * 10
    rows = q.passages(text)
    assert rows.shape == (3, q.FEATURES) and rows[0, 10] == 63 / 64 and rows[0, 9] == 1 / 64
    assert (q.passages(None) == 0).all() and q.passages("").shape == q.passages(" \n").shape == (1, q.FEATURES)
    assert np.isfinite(q.passages("😀\u0000 ｶﾅ" * 50)).all()


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(q, "PART", 1000)
    text = "some words of a text " * 500
    assert sum(len(p) for p in q._parts(text)) == len(text) and max(len(p) for p in q._parts(text)) <= 1000
    assert len(q.passages(text)) >= 2000 // 64 + 1
    assert "".join(q._parts("x" * 5000)) == "x" * 5000


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = llm_queries()["op7_quality_classifier"](spark, folder).collect()
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert len(got) == 1000 and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_odd_inputs(spark):
    rows = [(k, ("fine words here . " if k % 2 else "%% ## ") * 30, "z") for k in range(60)] + [(None, None, "z"), (3, "", "z"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (5, None), (77, 0)], "doc_id long, quality int")
    model = q.train(docs, labels, steps=100)
    got = q.scored(docs, model).collect()
    assert len(got) == 63 and all(r.predicted == r.doc_id % 2 for r in got if r.text)
    assert q.scored(docs.limit(0), model).count() == 0
    untaught = q.train(docs, labels.limit(0))
    assert {r.score for r in q.scored(docs, untaught).collect()} == {0.5}
    a, b = (q.train(docs.repartition(n), labels, steps=5).weights["score"] for n in (1, 5))
    assert (a == b).all()
