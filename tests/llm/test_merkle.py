"""Merkle manifest against a plain implementation of the contract."""

import hashlib
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shoplens.llm import merkle
from shoplens.llm.queries import op11_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain(rows, tamper):
    """doc_id, leaf, subroot, root, proof, folded per row, in any order."""
    def key(v):
        return (v is not None, v.encode() if isinstance(v, str) else v)

    def levels(hs):
        out = [hs]
        while len(out[-1]) > 1:
            cur = out[-1]
            out.append([H(cur[i] + (cur[i + 1] if i + 1 < len(cur) else "")) for i in range(0, len(cur), 2)])
        return out

    def path(tree, i):
        steps = []
        for lv in tree[:-1]:
            sib = i ^ 1
            steps.append((lv[sib], sib < i) if sib < len(lv) else (None, None))
            i >>= 1
        return steps

    def fold(h, steps):
        for s, left in steps:
            h = H(h if s is None else (s + h if left else h + s))
        return h

    if not rows:
        return []
    leaves = [(r, H("".join(field(v) for v in r)), tamper(r)) for r in rows]
    langs = sorted({r[2] for r in rows}, key=key)
    trees = {}
    for g in langs:
        mine = sorted([x for x in leaves if x[0][2] == g], key=lambda x: (key(x[0][0]), x[1]))
        trees[g] = (mine, levels([x[1] for x in mine]))
    top = levels([trees[g][1][-1][0] for g in langs])
    root = top[-1][0]
    out = []
    for gi, g in enumerate(langs):
        mine, tree = trees[g]
        for i, (r, h, t) in enumerate(mine):
            steps = path(tree, i) + path(top, gi)
            changed = (r[0], r[1], r[2], r[3] + 1 if (t and r[3] is not None) else r[3], r[4])
            lh = H("".join(field(v) for v in changed))
            out.append((r[0], h, tree[-1][0], root, H("".join(s for s, _ in steps if s)), fold(lh, steps)))
    return sorted(out, key=lambda x: (key(x[0]), x[1]))


def spark_rows(df):
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()]
    return sorted(got, key=lambda x: (x[0] is not None, x[0], x[1]))


def odd_rows():
    rows = [(k, f"s{k % 3}" if k % 5 else None, [None, "en", "de", "é", "fr"][k % 5] if k < 90 else "en", k * 3 if k % 7 else None,
             None if k % 11 == 0 else ("" if k % 13 == 0 else f"text {k} " * (k % 4)))
            for k in range(120)]
    rows += [rows[3], rows[3], (None, "s", "en", 5, "no id"), (None, None, None, None, None), (7, "s", "en", 1, "x" * 50_000)]
    return rows


@pytest.mark.parametrize("count", [0, 1, 2, 3, 17, 125])
def test_equal_to_plain(spark, count):
    rows = odd_rows()[:count]
    df = spark.createDataFrame(rows, SCHEMA)
    tamper = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    got = merkle.manifest(df, (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("doc_id").isNotNull())
    want = plain(rows, tamper)
    assert [g[:6] for g in spark_rows(got)] == want
    for g in spark_rows(got):
        assert g[6] == (g[5] == g[3])


def test_small_blocks_fetch(spark, monkeypatch):
    """Many partitions: each block fetches its outside siblings, proofs are unchanged."""
    monkeypatch.setattr(merkle, "ROWS_PER_BLOCK", 7)
    rows = odd_rows()
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), F.lit(False))
    assert [g[:6] for g in spark_rows(got)] == plain(rows, lambda r: False)
    assert all(g[6] for g in spark_rows(got))


def test_clashing_columns(spark):
    rows = [(k, "s", "en", 3, "abc", "x", 1) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA + ", _mid string, _pid int")
    got = merkle.manifest(df)
    assert [g[:6] for g in spark_rows(got)] == plain([r[:5] for r in rows], lambda r: False)


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    rows = [tuple(None if pd.isna(v) else (int(v) if isinstance(v, float) or hasattr(v, "item") else v) for v in
                  (r.doc_id, r.source, r.lang, r.n_chars, r.text)) for r in docs.itertuples()]
    tamper = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
    got = spark_rows(op11_merkle_manifest(spark, folder))
    assert [g[:6] for g in got] == plain(rows, tamper)
    assert sum(not g[6] for g in got) == sum(tamper(r) and r[3] is not None for r in rows) > 0
