"""A Merkle manifest of a table, with every row's proof found by octopus multiproofs.

Leaves are SHA-256 digests of a row's fields. Per group (for documents: per language) leaves are numbered in
order and folded pairwise, level by level, into a subroot; the subroots, in group order, fold into the root.
An odd last node of a level is hashed alone. Digests are lowercase hex and parents hash their children's
hex text.

The interior nodes are built by Spark: aligned blocks of 16 nodes are grouped and four levels are hashed at
once with array functions, so a tree of n leaves takes about log16(n) shuffles of shrinking tables, each
stored in the shared checkpoint folder.

Proofs do not join every leaf with every level. Leaves are range partitioned in tree order; each partition
holds, per group, one contiguous block of leaves. For the block the minimal set of nodes it cannot derive
itself is worked out (at most two per level, never inside the block), all partitions' wants are joined once
with the node table, and each partition, together with what it fetched, derives the shared interior nodes
and expands the proof of each of its leaves locally.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.shared import attach, checkpointed

#: Nodes of a level hashed together in one group: four levels per shuffle.
BLOCK = 16
#: Leaves per range partition of the proof pass; with ~300 bytes a leaf, some 60 MB a task.
ROWS_PER_BLOCK = 200_000
STEPS = "array<struct<h:string,left:boolean>>"


def _field(c: Column) -> Column:
    """'-' for null, else the UTF-8 byte count, ':' and the value (integers in decimal)."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """Lowercase hex SHA-256 of the fields' encodings, concatenated."""
    return F.sha2(F.concat(*[_field(c) for c in columns]), 256)


def height(count: Column) -> Column:
    """Levels above count leaves: halvings (rounded up) until one node is left."""
    return F.when(count <= 1, F.lit(0)).otherwise(F.length(F.bin(count - 1)))


def positions(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df stored in tree order with _pid (its partition) and _idx (place within its group, from 0).

    Ranks come from a range partitioned sort and per partition counts; no task holds a whole group.
    """
    count = df.count()
    parts = max(1, -(-count // ROWS_PER_BLOCK))
    keys = [F.col(group).asc_nulls_first()] + [F.col(c).asc_nulls_first() for c in order]
    stored = checkpointed(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))
    placed = (stored.withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1)))
    # one run per (partition, group): its first position and size; offsets sum the runs of earlier partitions
    placed = placed.withColumn("_run", F.concat_ws(":", F.col("_pid").cast("string"), _group_key(F.col(group))))
    runs = placed.groupBy("_run", "_pid", group).agg(F.min("_pos").alias("_start"), F.count("*").alias("_cnt"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = checkpointed(runs.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
                        .select(F.col("_run").alias("_rrun"), "_start", "_offset"))
    joined = attach(placed, runs, "_run", "_rrun", "_mid")
    return joined.withColumn("_idx", F.col("_offset") + F.col("_pos") - F.col("_start")).drop(
        "_run", "_rrun", "_start", "_offset", "_pos")


def _group_key(c: Column) -> Column:
    """Text that tells groups apart, null included."""
    return F.concat(F.when(c.isNull(), "n").otherwise("v"), F.coalesce(c.cast("string"), F.lit("")))


def _paired(a: Column) -> Column:
    """The next level of an array of hex digests: pairs hashed, an odd last one alone."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) + 1) / 2).cast("int") - 1),
                       lambda i: F.sha2(F.concat(F.get(a, 2 * i), F.coalesce(F.get(a, 2 * i + 1), F.lit(""))), 256))


def nodes(leaves: DataFrame, group: str) -> DataFrame:
    """All nodes (group, level, idx, h) above and including leaves (group, idx, h, levels: height of the group)."""
    found = [leaves.select(group, F.lit(0).alias("level"), "idx", "h")]
    frontier, level = leaves.select(group, "idx", "h", "levels"), 0
    while True:
        frontier = frontier.where(F.col("levels") > level)
        block = frontier.groupBy(group, F.floor(F.col("idx") / BLOCK).alias("_block")).agg(
            F.first("levels").alias("levels"),
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda s: s["h"]).alias("_l0"))
        for k in range(1, 5):
            block = block.withColumn(f"_l{k}", _paired(F.col(f"_l{k - 1}")))
        made = checkpointed(block.select(
            group, "levels", F.explode(F.array(*[
                F.struct(F.lit(level + k).alias("level"), F.col("_block"), F.lit(BLOCK >> k).alias("_width"),
                         F.col(f"_l{k}").alias("_hs")) for k in range(1, 5)])).alias("_lv"))
            .where(F.col("_lv.level") <= F.col("levels"))
            .select(group, "levels", "_lv.level", "_lv._block", "_lv._width", F.posexplode("_lv._hs").alias("_at", "h"))
            .select(group, "levels", "level", (F.col("_block") * F.col("_width") + F.col("_at")).alias("idx"), "h"))
        found.append(made.select(group, "level", "idx", "h"))
        level += 4
        frontier = made.where(F.col("level") == level).select(group, "idx", "h", "levels")
        if frontier.where(F.col("levels") > level).limit(1).count() == 0:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(blocks: DataFrame) -> DataFrame:
    """(level, idx) of the nodes each block (_a.._b of _count leaves, levels) must fetch to prove its leaves.

    Every ancestor of the block's leaves is derived from the block's leaves and what was fetched below it, so
    only siblings outside the block are fetched: left of the first ancestor where that one is odd, right of
    the last where that one is even and a right neighbour exists. At most two per level; the set is minimal.
    """
    level = F.col("_lv")
    lo, hi = F.expr("shiftright(_a, _lv)"), F.expr("shiftright(_b, _lv)")
    size = F.expr("shiftright(_count - 1, _lv) + 1")
    sides = F.array(F.when(lo % 2 == 1, lo - 1), F.when((hi % 2 == 0) & (hi + 1 < size), hi + 1))
    return (blocks.where(F.col("levels") > 0)
            .select("*", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("_lv"))
            .select("_pid", "_gk", level.alias("level"), F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("idx")))


def _expand(carry: list[str]):
    def expand(leaves: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        have: dict = {}
        for g, lv, i, h in zip(fetched["_gk"], fetched["level"], fetched["idx"], fetched["h"]):
            have.setdefault((g, int(lv)), {})[int(i)] = h
        mids, steps = [], []
        for g, block in leaves.groupby("_gk", sort=False):
            count = int(block["_count"].iloc[0])
            a, b = int(block["_idx"].min()), int(block["_idx"].max())
            level_nodes = [dict(zip(block["_idx"].astype(int), block["h"]))]
            size, level = count, 0
            while size > 1:
                cur = level_nodes[level]
                cur.update(have.get((g, level), {}))
                up = (size + 1) // 2
                level_nodes.append({p: _digest(cur[2 * p] + (cur[2 * p + 1] if 2 * p + 1 < size else ""))
                                    for p in range(a >> (level + 1), (b >> (level + 1)) + 1)})
                size, level = up, level + 1
            for mid, i in zip(block["_mid"], block["_idx"]):
                path, size, level, at = [], count, 0, int(i)
                while size > 1:
                    sib = at ^ 1
                    path.append({"h": level_nodes[level][sib], "left": sib < at} if sib < size else {"h": None, "left": None})
                    at, size, level = at >> 1, (size + 1) // 2, level + 1
                mids.append(mid)
                steps.append(path)
        out = pd.DataFrame({"_mid": pd.Series(mids, dtype="int64"), "steps": pd.Series(steps, dtype=object)})
        return out.merge(leaves[["_mid", *carry]], on="_mid", how="left")[["_mid", *carry, "steps"]]
    return expand


def proofs(placed: DataFrame, group: str, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of placed: _mid, carry as text, steps from leaf to subroot; subroots: group, levels, subroot).

    placed: positions() output with column h (the leaf). A step is (h, left): the sibling and whether it stands
    left; a lone node hashed by itself is a step with null h. The leaves cross the cluster once, grouped by
    their partition (a bounded block), together with the nodes that block fetched.
    """
    gkey = _group_key(F.col(group))
    counts = checkpointed(placed.groupBy(F.col(group).alias("_cg")).agg(F.count("*").alias("_count"))
                          .withColumn("levels", height(F.col("_count"))))
    placed = attach(placed, counts, group, "_cg", "_mid").drop("_cg").withColumn("_gk", gkey)
    tree = checkpointed(nodes(placed.select(group, F.col("_idx").alias("idx"), "h", "levels"), group)
                        .withColumn("_gk", gkey))
    subroots = (tree.join(counts, tree[group].eqNullSafe(counts["_cg"]))
                .where(F.col("level") == F.col("levels")).select(group, "levels", F.col("h").alias("subroot")))
    blocks = placed.groupBy("_pid", "_gk").agg(F.min("_idx").alias("_a"), F.max("_idx").alias("_b"),
                                               F.first("_count").alias("_count"), F.first("levels").alias("levels"))
    fetched = checkpointed(wanted(blocks).join(tree.select("_gk", "level", "idx", "h"), ["_gk", "level", "idx"]))
    leaves = placed.select("_pid", "_mid", "_gk", "_idx", "h", "_count", *[F.col(c).cast("string").alias(c) for c in carry if c != "h"])
    cols = ", ".join(f"{c} string" for c in carry)
    steps = leaves.groupBy("_pid").cogroup(fetched.groupBy("_pid")).applyInPandas(
        _expand(carry), f"_mid long, {cols}, steps {STEPS}")
    return steps, subroots


def fold(start: Column, steps: Column) -> Column:
    """The root reached from start along steps."""
    return F.aggregate(steps, start, lambda acc, s: F.sha2(
        F.when(s["left"].isNull(), acc).when(s["left"], F.concat(s["h"], acc)).otherwise(F.concat(acc, s["h"])), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, subroot, root and proof of every row of docs (doc_id, source, lang, n_chars, text).

    Per lang, leaves ascend by doc_id (nulls first; equal ids by leaf); subroots ascend by lang (null first,
    UTF-8 bytewise). Returns doc_id, lang, leaf, subroot, root, proof_sha256 (SHA-256 of the siblings' hex,
    leaf level first, up to the root; of the empty text without siblings), steps, folded_root (the root
    recomputed from the row's leaf, with n_chars raised by 1 where `tampered` (a boolean of the input row)
    holds, null staying null, and the original siblings) and verified (folded_root equals root). Other
    columns are not read; repeated rows are separate leaves; null fields are encoded as '-'; texts are hashed
    whole; an empty table gives no rows.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = docs.select(*fields, (tampered if tampered is not None else F.lit(False)).alias("_tamper"))
    changed = F.when(F.col("_tamper"), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = rows.select("doc_id", "lang", leaf(*[F.col(c) for c in fields]).alias("h"),
                       leaf(*[changed if c == "n_chars" else F.col(c) for c in fields]).alias("_changed"))
    placed = positions(rows, "lang", ["doc_id", "h"])
    with_steps, subroots = proofs(placed, "lang", ["doc_id", "lang", "h", "_changed"])
    top_placed = positions(subroots.select("lang", F.col("subroot").alias("h"), F.lit(0).alias("_all")), "_all", ["lang"])
    top_steps, root = proofs(top_placed, "_all", ["lang", "h"])
    top = checkpointed(attach(top_steps.withColumn("_all", F.lit(0)), root.select(F.col("_all").alias("_ra"), F.col("subroot").alias("root")),
                              "_all", "_ra", "_mid")
                       .select(F.col("lang").alias("_tl"), F.col("h").alias("subroot"), F.col("steps").alias("_top"), "root"))
    out = attach(with_steps, top, "lang", "_tl", "_mid")
    path = F.concat(F.col("steps"), F.col("_top"))
    return out.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("h").alias("leaf"), "subroot", "root",
        F.sha2(F.array_join(F.transform(path, lambda s: s["h"]), ""), 256).alias("proof_sha256"),
        path.alias("steps"), fold(F.col("_changed"), path).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
