"""Phrase collocations by fingerprints against plain counting of every n-gram."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplens.llm import phrases
from shoplens.llm.queries import op13_phrase_collocations


def plain(rows, at_least, top, longest=5):
    grams, totals = {}, Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        words, pieces = phrases.words_of(text)
        totals[lang] += len(words)
        c = grams.setdefault(lang, Counter())
        for i in range(len(words)):
            for m in range(1, longest + 1):
                if i + m <= len(words) and pieces[i] == pieces[i + m - 1]:
                    c[tuple(words[i:i + m])] += 1
    out = []
    for lang, c in grams.items():
        n = totals[lang]
        cand = {g: a for g, a in c.items() if 2 <= len(g) and a >= at_least}
        found = []
        for g, a in cand.items():
            if any(len(h) > len(g) and b >= a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                   for h, b in cand.items()):
                continue
            score, k, l, r = min((1000 * a * n // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            found.append((score, a, " ".join(g), l, r))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def spark_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def fixture(count=300, seed=3):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "Dé", "e", "the", "x\ty", "THE"]
    texts = [None, "", "no punctuation at all", "!!!...", "A B. a b; A b? a B\nx"]
    for _ in range(count):
        texts.append(" ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", ".", "!", "\n"]) for _ in range(rng.randint(0, 30))))
    return [(rng.choice(["en", "fr", None]), t) for t in texts] + [("en", "a b c " * 3000)] * 2


@pytest.mark.parametrize("at_least, top", [(3, 40), (20, 5), (10_000, 10)])
def test_equal_to_plain(spark, at_least, top):
    rows = fixture()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert spark_rows(phrases.collocations(df, at_least=at_least, top=top)) == plain(rows, at_least, top)


def test_collisions_are_counted_by_text(spark, monkeypatch):
    """Word hashes of four values force colliding fingerprints; the recount by text keeps results exact."""
    monkeypatch.setattr(phrases, "_first_hash", lambda word: F.pmod(F.xxhash64(word), F.lit(4)))
    rows = fixture(200, seed=5)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert spark_rows(phrases.collocations(df, at_least=3, top=30)) == plain(rows, 3, 30)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    rows = [("en", "p q r. p q r", 1, "x")] * 5
    df = spark.createDataFrame(rows, "lang string, text string, _row long, phrase string")
    assert spark_rows(phrases.collocations(df, at_least=5, top=3)) == plain([r[:2] for r in rows], 5, 3)


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    rows = [(None if pd.isna(l) else l, None if t is None else t) for l, t in zip(docs["lang"], docs["text"])]
    got = spark_rows(op13_phrase_collocations(spark, folder))
    assert got == plain(rows, 100, 2000) and len(got) > 0


def test_shuffles_carry_fingerprint_and_count_only(spark):
    """Eight bytes a word are stored and two numbers a row shuffled; languages and words do not cancel each other."""
    df = spark.createDataFrame([("es", "de"), ("de", "es"), ("es", "es"), ("de", "de")], "lang string, text string")
    hashed = phrases.tokens(df.withColumn("_row", F.monotonically_increasing_id()))
    assert "h2" not in hashed.columns
    counted = phrases._counted(hashed, 1, None)
    assert counted.columns == ["fp", "n"] and [r["n"] for r in counted.collect()] == [1] * 4


def test_tasks_report_only_places_that_are_not_known(spark):
    """After the first look a task sends a wanted fingerprint only if it has no place yet or another check value."""
    rows = spark.createDataFrame([("en", "a b a b a b")] * 400, "lang string, text string").withColumn(
        "_row", F.monotonically_increasing_id())
    wanted = {m: phrases.np.sort(phrases._counted(phrases.tokens(rows), m, None).toPandas()["fp"].to_numpy()) for m in (1, 2)}
    placed = phrases._placed(rows, wanted).toPandas()
    assert len(placed) == 4 and (placed["check_lo"] == placed["check_hi"]).all()
    known = {m: tuple(placed[placed["m"] == m].sort_values("fp")[k].to_numpy() for k in ("fp", "check_lo")) for m in (1, 2)}
    assert phrases._places(rows, wanted, {}).count() >= 4
    assert phrases._places(rows, wanted, known).count() == 0
    other = known | {2: (known[2][0], known[2][1] + 1)}
    assert {r["m"] for r in phrases._places(rows, wanted, other).collect()} == {2}


def test_spelled_from_broadcast_and_from_shuffled_texts(spark, monkeypatch):
    rows = fixture(100, seed=7)
    df = spark.createDataFrame(rows, "lang string, text string")
    for bound in (0, 500_000):
        monkeypatch.setattr(phrases, "SPELL_BOUND", bound)
        assert spark_rows(phrases.collocations(df, at_least=3, top=30)) == plain(rows, 3, 30)


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_words_from_bytes_equal_plain_splitting(spark, monkeypatch, most):
    """Words, pieces and codes taken from UTF-8 bytes, for shares of one text and of many; codes tell words apart."""
    texts = [t for _, t in fixture(40)] + ["", " ", "é", "a", "ÀB\tc\x0b d\x85e f", "中" * 50 + " " + "中" * 49 + "文 X", "end.", ".,"]
    batch = phrases.pa.RecordBatch.from_pydict({
        "lang": ["en"] * len(texts), "tongue": [1] * len(texts), "_row": list(range(len(texts))), "text": [t or "" for t in texts]})
    monkeypatch.setattr(phrases, "CHUNK_BYTES", most)
    got = [r for part in phrases._coded(True, True)([batch.slice(0, 30), batch.slice(30)]) for r in part.to_pylist()]
    codes = {}
    for r, text in zip(got, texts):
        words, pieces = phrases.words_of(text)
        assert r["words"] == words and r["sizes"] == [pieces.count(p) for p in sorted(set(pieces))]
        for word, pair in zip(words, zip(r["code"], r["h2"]), strict=True):
            assert codes.setdefault(word, pair) == pair
    assert len(got) == len(texts) and len(set(codes.values())) == len(codes)
    assert len({a for a, _ in codes.values()} | {b for _, b in codes.values()}) == 2 * len(codes)


def test_a_text_is_split_once_for_all_its_places(spark):
    """The words of a text are taken before its places are spelled, not again for each of them."""
    rows = spark.createDataFrame([("en", "p q r. p q r")], "lang string, text string").withColumn("_row", F.lit(0).cast("long"))
    found = spark.createDataFrame([(0, m, s, 2) for m, s in [(1, 0), (2, 1), (3, 3)]], "_row long, m int, _start long, n long")
    spelled = phrases._spelled(rows, found)
    assert sorted(tuple(r) for r in spelled.collect()) == [("en", 1, "p", 2), ("en", 2, "q r", 2), ("en", 3, "p q r", 2)]
    inner = spelled._jdf.queryExecution().optimizedPlan().toString()
    assert inner.count("regexp_extract_all") == 1 and "slice(flatten" not in inner


def test_nothing_of_the_size_of_the_texts_is_stored(spark, tmp_path, monkeypatch):
    """The passes split the texts again instead of storing word hashes: what is stored holds frequent phrases only."""
    stored = []
    monkeypatch.setattr(phrases, "checkpointed", lambda df: stored.append(df.localCheckpoint()) or stored[-1])
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.parquet", lambda *_, **__: pytest.fail("a table is written"))
    rows = [("en", f"w{i} x{i} a b. y{i}") for i in range(500)]
    phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), at_least=100).collect()
    assert stored and max(df.count() for df in stored) <= 3
