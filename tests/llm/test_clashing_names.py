"""Columns of the input that have the names operators use for themselves come through unchanged."""

import pytest
from pyspark.sql import functions as F

from shoplens.llm import exact_dedup, html_text, mixing, quality_model, quality_rules, sentencepiece_unigram, sharding, simhash

NAMES = ["_own_id", "_own_text", "_own_nth", "_own_u", "_own_", "_Own_size", "_salt_at", "_run", "_digest", "keep_id", "kept2", "_best",
         "fingerprint", "component", "vertex", "of", "a", "b", "u", "edge_bin", "coarse", "id", "word", "matches", "_nth"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(k, f"some words of text {k // 2}", "s") for k in range(6)], "doc_id long, text string, source string")
    return rows.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in NAMES])


def test_operators_keep_extra_columns(spark, docs):
    model = quality_model.fit([], [])
    field = html_text.ChainField({}, [[0.0, 0.0], [0.0, 0.0]])
    field.steps = __import__("numpy").array(field.steps)
    results = {
        "exact": exact_dedup.drop_duplicates(docs), "near": simhash.drop_near_duplicates(docs), "mix": mixing.mix(docs),
        "repeated": mixing.repeated(docs), "rules": quality_rules.judged(docs), "scored": quality_model.scored(docs, model),
        "accepted": quality_model.accepted(docs, model), "pieces": sentencepiece_unigram.encoded(docs),
        "placed": sharding.place(docs, ["x", "y"]), "page": html_text.extracted(docs.withColumn("html", F.col("text")), field=field),
    }
    for name, df in results.items():
        rows = df.collect()
        assert rows and set(NAMES) <= set(df.columns), name
        assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in NAMES), name
    for name in ("exact", "near", "repeated", "accepted"):
        assert results[name].columns == docs.columns, name
    assert simhash.near_duplicate_components(docs).count() == exact_dedup.duplicate_groups(docs).count() == 6
