"""SimHash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from shoplens.llm import simhash
from shoplens.llm.components import components


def slow_fingerprint(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(prints, radius):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(prints):
            for j, y in enumerate(prints):
                if (x ^ y).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts(count):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Über", "ÉTÉ", "ABC"]
    out = ["", None, " \t\n", "one", "One", "one two three", "a b c d", "é b c d e"]
    while len(out) < count:
        base = [rng.choice(words) for _ in range(rng.choice([3, 20, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out[:count]


@pytest.mark.parametrize("settings", [{}, {"tree_size": 3}, {"blocks": 6}, {"radius": 6, "blocks": 8}])
def test_components_equal_brute_force(spark, settings):
    rows = [(10 + i, t, "x") for i, t in enumerate(texts(150))] + [(11, None, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = simhash.near_duplicate_components(docs, **settings).collect()
    prints = [slow_fingerprint(t or "") for _, t, _ in rows]
    label = slow_classes(prints, settings.get("radius", 4))
    smallest = {}
    for (doc, _, _), l in zip(rows, label):
        smallest[l] = min(doc, smallest.get(l, doc))
    want = sorted((d, f"{p:016x}", smallest[l]) for (d, _, _), p, l in zip(rows, prints, label))
    assert sorted(map(tuple, got)) == want
    stay = simhash.drop_near_duplicates(docs, **settings)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(smallest.values())


def test_dense_shard_is_cut_into_trees(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(600)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    label = slow_classes(prints, 4)
    for size in (20, 10_000):
        found = {r.vertex: r.component for r in components(simhash.links(df, tree_size=size)).collect()}
        groups = {}
        for p, l in zip(signed, label):
            groups.setdefault(l, set()).add(found.get(p, p))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_search_finds_every_component_of_a_forest():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 12, 300).astype(np.uint64)
    prints = np.unique(prints)
    shards = np.sort(rng.integers(0, 4, len(prints)))
    shards = np.searchsorted(np.unique(shards), shards)
    forest = simhash.Forest(shards, prints)
    query, node = forest.links(prints, shards, np.arange(len(prints)), 2)
    assert (np.bitwise_count(prints[query] ^ prints[node]) <= 2).all() and (shards[query] == shards[node]).all()
    for s in range(4):
        own = prints[shards == s]
        label = slow_classes([int(x) for x in own], 2)
        a, b = simhash._stars(prints[query][shards[query] == s], prints[node][shards[query] == s])
        low = dict(zip(a, b))
        assert len({(l, low.get(x, x)) for l, x in zip(label, own)}) == len(set(label))


def test_edges_of_a_long_chain_are_one_component(spark):
    edges = [(k, k - 1) for k in range(1, 200)] + [(900, 900), (500, 501), (501, 500)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.vertex, r.component) for r in got} == {(k, 0) for k in range(200)} | {(500, 500), (501, 500)}


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    got = simhash.near_duplicate_components(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7"), ("None", "7"), ("None", "None")]
    assert simhash.drop_near_duplicates(docs).count() == 2


def test_one_row_per_component_by_text(spark):
    rows = [(None, "a b c d", 1), (None, "q r s t u", 2), (5, "k l m n o", 3), (5, "v w x y z", 4), (5, "v w x y z", 5),
            (6, "V W X Y Z", 6), (None, "k l m n o", 7), (8, "f g h i j", 8), (8, "F g h i j", 9)]
    for kind in ("long", "string"):
        docs = spark.createDataFrame([(d if d is None or kind == "long" else f"d{d}", t, n) for d, t, n in rows],
                                     f"doc_id {kind}, text string, nth int")
        got = sorted((str(r.doc_id)[-1], r.text.lower()) for r in simhash.drop_near_duplicates(docs).collect())
        assert got == [("5", "k l m n o"), ("5", "v w x y z"), ("8", "f g h i j"), ("e", "a b c d"), ("e", "q r s t u")]


def test_long_text_is_hashed_in_parts(monkeypatch):
    text = " ".join(f"v{k % 97}" for k in range(1000)).encode()
    whole = simhash.fingerprint(text, 4)
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 7)
    assert simhash.fingerprint(text, 4) == whole
