"""Placement, mixing, exact dedup and quality rules against brute force; their plans hold no Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from check_oracles import compare, duckdb_tables
from shoplens.llm import exact_dedup, mixing, quality_rules, sharding
from shoplens.llm.queries import llm_oracles, llm_queries
from shoplens.llm.shared import attach

FOLDER = "/root/testdata/sf0.001"
ROW = "doc_id long, text string, source string, kept string, size string"


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_queries_equal_sql(spark, name):
    good, note = compare(spark, duckdb_tables(FOLDER), FOLDER, name, llm_queries()[name], llm_oracles()[name])
    assert good and "TYPES" not in note, note


@pytest.mark.parametrize("name", ["op2_sharding", "op3_source_mixing", "op4_exact_dedup", "op6_quality_rules"])
def test_native_plans(spark, name):
    plan = llm_queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def rows_with_copies(count=400):
    rng = random.Random(6)
    texts = ["", None, "a", "A", "a ", "é", "x" * 9000] + [f"text {k}" for k in range(30)]
    return [(rng.choice([k, k, None]) if k % 50 == 7 else k, rng.choice(texts) if k % 3 else "hot", rng.choice("abc"), "k", "s")
            for k in range(count)]


@pytest.mark.parametrize("keep, pick", [("smallest", min), ("largest", max)])
def test_exact_dedup(spark, keep, pick):
    rows = rows_with_copies()
    rows += rows[:20]
    docs = spark.createDataFrame(rows, ROW)
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    best = {t: pick([d for d in ids if d is not None], default=None) for t, ids in groups.items()}
    want = {(d, best[t or ""], len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest())
            for d, t, *_ in rows}
    got = exact_dedup.duplicate_groups(docs, keep=keep, fan_in=2).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    stay = exact_dedup.drop_duplicates(docs, keep=keep)
    assert stay.columns == docs.columns
    assert Counter((r.doc_id, r.text or "") for r in stay.collect()) == Counter((d, t) for t, d in best.items())


def test_exact_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], ROW)
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_equal_ids_with_other_texts_are_other_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b")], "doc_id long, text string")
    assert sorted(map(tuple, exact_dedup.drop_duplicates(docs).collect())) == [(1, "a"), (1, "b")]


def test_table_is_filled_in_turns():
    names = [f"s{k}" for k in range(7)]
    owner = sharding.fill_table(names, 1009)
    counts = Counter(owner)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    # By hand: in each round every shard takes its first free slot.
    slots, taken = [-1] * 1009, 0
    orders = []
    for n in names:
        offset, step = sharding.preference(n, 1009)
        orders.append(iter([(offset + j * step) % 1009 for j in range(1009)]))
    while taken < 1009:
        for k, order in enumerate(orders):
            if taken < 1009:
                slots[next(s for s in order if slots[s] < 0)] = k
                taken += 1
    assert slots == owner
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 6)
    assert moved < 0.25 * 1009
    heavy = Counter(sharding.fill_table(names, 1009, [2, 1, 1, 1, 1, 1, 0]))
    assert heavy[0] > 1.8 * heavy[1] and 6 not in heavy
    for bad in ((names, 1000, None), ([], 7, None), (names, 5, None), (["a", "a"], 7, None), (["a"], 7, [0])):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_placement(spark):
    rows = [(k, "t", k) for k in range(2000)] + [(None, "t", 1), (5, "t", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    names = ["a", "b", "c"]
    got = sharding.place(docs, names, size=101).collect()
    owner = sharding.fill_table(names, 101)
    assert len(got) == len(rows) and all(owner[r.slot] == r.shard and names[r.shard] == r.shard_name for r in got)
    assert len({r.slot for r in got if r.doc_id == 5}) == 1 and max(Counter(r.shard for r in got).values()) < 900
    assert sharding.place(docs.limit(0), names).count() == 0


def fixpoint(sizes, weights, share, most):
    """Targets by reshuffling the excess until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def mixing_rows():
    rng = random.Random(8)
    names = ["big", "big", "big", "é", "Z", "a", None, "tiny", "blank"]
    rows = [(k, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))), rng.choice(names[:-1]), "k", "s") for k in range(1500)]
    return rows + [(9000 + k, t, "blank", "k", "s") for k, t in enumerate((None, "", " \n"))]


def test_mixing_reaches_its_targets(spark):
    rows = mixing_rows()
    got = mixing.mix(spark.createDataFrame(rows, ROW)).collect()
    sizes = {(d, s): len(re.findall("[^\x20\x09-\x0D]+", t or "")) for d, t, s, *_ in rows}
    by_source = Counter()
    for (_, s), n in sizes.items():
        by_source[s] += n
    target = fixpoint(by_source, (3, 1, 2), 1.5, 2)
    taken = Counter()
    for r in got:
        assert r.size == sizes[r.doc_id, r.source] and r.source_size == by_source[r.source]
        assert r.target == pytest.approx(target[r.source]) and r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 20 for s in by_source)
    again = mixing.mix(spark.createDataFrame(rows, ROW).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sample_is_the_smallest_pareto_ranks(spark):
    rows = [(k, "one two", "s", "k", "s") for k in range(1000)]
    docs = spark.createDataFrame(rows, ROW).selectExpr("*", "if(doc_id < 200, 9.0, 1.0) AS odds")
    got = {r.doc_id: r.copies for r in mixing.mix(docs, share=0.3, odds_col="odds").collect()}
    def rank(d):
        u = (int(hashlib.md5(f"42:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
        return u / (1 - u) / ((9 if d < 200 else 1) * 0.3 / 0.7)
    assert {d for d, n in got.items() if n} == set(sorted(got, key=rank)[:300])
    assert sum(got[d] for d in range(200)) > 120


def test_repeated_corpus_and_empty_table(spark):
    docs = spark.createDataFrame(mixing_rows(), ROW)
    mixed = {(r.doc_id, r.source): r.copies for r in mixing.mix(docs).collect()}
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == {k: n for k, n in mixed.items() if n}
    empty = spark.createDataFrame([], ROW)
    assert mixing.mix(empty).count() == 0 and mixing.repeated(empty).count() == 0


def test_salted_join_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "hot" if k % 2 else None, k) for k in range(50)], "k int, key string, v int")
    small = spark.createDataFrame([("hot", 1), (None, 2), ("cold", 3)], "of string, n int")
    plain = sorted(map(tuple, attach(rows, small, "key", "of", "k").collect()), key=str)
    monkeypatch.setattr("shoplens.llm.shared.BROADCAST_ROWS", 0)
    assert sorted(map(tuple, attach(rows, small, "key", "of", "k").collect()), key=str) == plain and len(plain) == 50


def slow_measures(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_quality_measures(spark):
    rng = random.Random(2)
    bits = ["the", "a", "b", "c", "é日", "#x", "\n", "\n", "\t", "und", "w|w", "\x0b", "\xa0"]
    texts = [" ".join(rng.choice(bits[:rng.randrange(2, len(bits))]) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["", None, "\n\n", "a b c d e a b c d e", "z " * 3000, "x\r\nx\r\nx", "one two three four five"]
    rows = [(k, t, "s", "k", "old") for k, t in enumerate(texts)]
    got = quality_rules.judged(spark.createDataFrame(rows, ROW)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_measures(texts[r.doc_id]), texts[r.doc_id]
        words = re.findall("[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        assert r.n_again_words == sum(a == b for a, b in zip(words, words[1:]))
        assert r.kept == (not r.broken_rules) and (r.n_words >= 10 or "long_enough" in r.broken_rules)
    assert quality_rules.judged(spark.createDataFrame([], ROW)).count() == 0


def test_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, "abcdef"), (3, None)], "doc_id long, text string")
    rules = [quality_rules.Rule("short", "mean_word_length", low=3), quality_rules.Rule("many", "n_words", high=1, min_words=0)]
    got = {r.doc_id: r.broken_rules for r in quality_rules.judged(docs, rules=rules).collect()}
    assert got == {1: ["short", "many"], 2: [], 3: []}
