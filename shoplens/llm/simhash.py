"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

A text's fingerprint has a bit set if the bit is set in more than half of its shingles' hashes. Fingerprints
within a few differing bits are linked. A BK-tree keys the children of a node by their Hamming distance to it,
so all of a subtree has one distance to the parent and a search follows only the edges within the radius.

Two fingerprints that differ in at most r bits agree in at least n - r of n blocks of bits. Shards are the
fingerprints that agree in such a choice of blocks, and every shard has a tree of its own; the number of blocks
grows slowly with the corpus, so that shards stay small. All trees together are as large as the corpus, so they
are not broadcast: shards are shuffled to their queries. A crowded shard is cut into trees of bounded size, and
each of its fingerprints is sent through these trees. Equal fingerprints are one vertex from the start, and a
task returns a spanning star of each linked set that it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.components import components
from shoplens.llm.shared import attach, checkpointed, shuffle_partitions, unused_prefix, whole_text

BITS = 64
#: Fingerprints per tree at most.
TREE_SIZE = 1024
#: Fingerprints per shard to aim at when the number of blocks is chosen.
SHARD_SIZE = 256
#: Words that are shingled at a time, so that very long texts need bounded memory.
WORDS_AT_ONCE = 1 << 16
#: Pairs of query and node that a search may hold at once.
FRONTIER = 1 << 21


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of `width` words, repeats included; of the whole text if it has fewer words, none if empty."""
    words, some = text.lower().split(), False  # of bytes: lowers A-Z, splits at space and tab to carriage return
    for start in range(0, len(words) - width + 1, WORDS_AT_ONCE):
        stop, some = min(start + WORDS_AT_ONCE, len(words) - width + 1), True
        yield np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + width]), 42) for i in range(start, stop)),
                          np.uint64, stop - start)
    if words and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)


def fingerprint(text: bytes, width: int) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    total, counts = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, width):
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * counts > total).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                 digests: bool = False) -> DataFrame:
    """id_col and fingerprint of every row, on demand the SHA-256 of its text (digest); a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:]],
                                             names=["id", "fingerprint", *batch.schema.names[2:]])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       *[F.unhex(F.sha2(whole_text(text_col), 256)).alias("digest")] * digests)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, fingerprint bigint" + ", digest binary" * digests
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def blocks_for(count: int, radius: int) -> int:
    """Number of blocks so that a shard holds few fingerprints on average."""
    blocks = radius + 1
    while blocks < radius + 4 and count / 2.0 ** (BITS * (blocks - radius) / blocks) > SHARD_SIZE:
        blocks += 1
    return blocks


def shard_keys(blocks: int, radius: int, column: str = "fingerprint") -> Column:
    """An array of (choice, key): the bits of every choice of blocks - radius blocks."""
    ends = [BITS * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, choice in enumerate(combinations(range(blocks), blocks - radius)):
        key, filled = F.lit(0).cast("long"), 0
        for k in choice:
            width = ends[k + 1] - ends[k]
            part = F.shiftrightunsigned(column, ends[k]).bitwiseAND(F.lit((1 << width) - 1))
            key, filled = key.bitwiseOR(F.shiftleft(part, filled)), filled + width
        keys.append(F.struct(F.lit(number).alias("choice"), key.alias("key")))
    return F.array(*keys)


def _first_of(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), starts[1], ..."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Forest:
    """BK-trees of many shards at once. Nodes are positions in `prints`; the first of a shard is its root."""

    def __init__(self, shards: np.ndarray, prints: np.ndarray):
        """shards: sorted numbers 0, 1, ... without gaps."""
        self.prints, self.roots = prints, _first_of(shards)
        keys, children = [], []
        pending = np.setdiff1d(np.arange(len(prints)), self.roots)
        at = self.roots[shards[pending]]
        while len(pending):  # all nodes below `at` arrive there together: the first per distance becomes the child
            edge = at * (BITS + 1) + np.bitwise_count(prints[pending] ^ prints[at])
            edges, first, which = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(edges)
            children.append(pending[first])
            left = np.ones(len(pending), bool)
            left[first] = False
            pending, at = pending[left], pending[first][which][left]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if keys else np.zeros(0, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.children = self.keys[order], self.children[order]

    def links(self, queries: np.ndarray, shards: np.ndarray, before: np.ndarray, radius: int
              ) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) within the radius, enough of them to connect all that are.

        before: a query meets only nodes of a smaller number. Where it meets a node within the radius, the edges up
        to the radius are not followed: what hangs there is linked to that node already.
        """
        found, query, node = [], np.arange(len(queries)), self.roots[shards]
        while len(query):
            keep = node < before[query]  # children have greater numbers than their parent
            query, node = query[keep], node[keep]
            distance = np.bitwise_count(queries[query] ^ self.prints[node]).astype(np.int64)
            hit = distance <= radius
            found.append((query[hit], node[hit]))
            low = np.where(hit, radius + 1, np.maximum(distance - radius, 0))
            base = node * (BITS + 1)
            start = np.searchsorted(self.keys, base + low)
            count = np.searchsorted(self.keys, base + np.minimum(distance + radius, BITS) + 1) - start
            query, node = np.repeat(query, count), self.children[_ranges(start, count)]
        return (np.concatenate([f[0] for f in found] or [query]), np.concatenate([f[1] for f in found] or [node]))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For edges between values: every value of a linked set but the smallest, and the smallest."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ends[:len(a)], ends[len(a):], np.arange(len(values))
    while True:
        low = np.minimum(label[x], label[y])
        if (label[x] == low).all() and (label[y] == low).all():
            break
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    inner = label != np.arange(len(values))
    return values[inner], values[label[inner]]


def _linked(rows: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links inside each (choice, key, tree); rows are sorted by these."""
    names = np.stack([rows["choice"], rows["key"], rows["tree"]])
    shard = np.cumsum(np.r_[0, (names[:, 1:] != names[:, :-1]).any(axis=0)])
    prints = rows["fingerprint"].view(np.uint64)  # bits of signed numbers are counted of their absolute value
    member = rows["member"].astype(bool)
    filled = np.bincount(shard, member, minlength=shard[-1] + 1).astype(np.int64) if len(shard) else shard
    number = np.cumsum(filled > 0) - 1
    usable = filled[shard] > 0
    shard, prints, member, filled = number[shard[usable]], prints[usable], member[usable], filled[filled > 0]
    forest = Forest(shard[member], prints[member])
    before = np.full(len(prints), np.iinfo(np.int64).max)
    before[member] = np.arange(member.sum())
    a, b, start = [], [], 0
    work = np.cumsum(filled[shard])
    while start < len(prints):
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + FRONTIER)))
        query, node = forest.links(prints[start:stop], shard[start:stop], before[start:stop], radius)
        a.append(prints[start:stop][query])
        b.append(forest.prints[node])
        start = stop
    return tuple(x.view(np.int64) for x in _stars(np.concatenate(a or [prints]), np.concatenate(b or [prints])))


def links(prints: DataFrame, radius: int = 4, blocks: int | None = None, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those within `radius` bits.

    prints: column fingerprint, distinct values. blocks: bits are cut into so many blocks, by default by the count.
    """
    blocks = blocks or blocks_for(prints.count(), radius)
    rows = prints.select("fingerprint", F.explode(shard_keys(blocks, radius)).alias("_shard")).select(
        "fingerprint", "_shard.choice", "_shard.key")
    crowded = (rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > tree_size)
               .withColumn("trees", F.ceil(F.col("n") / tree_size).cast("int")).drop("n"))
    own = F.pmod(F.xxhash64("fingerprint"), F.coalesce("trees", F.lit(1))).cast("int")
    # A pair in two trees of a shard is found by the member of the later tree: it is sent to the earlier ones as well.
    spread = (rows.join(crowded, ["choice", "key"], "left").withColumn("own", own)
              .withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("own"))))
              .select("choice", "key", "tree", "fingerprint", (F.col("tree") == F.col("own")).alias("member")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            a, b = _linked({c: whole[c].to_numpy() for c in whole.column_names}, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= FRONTIER // 4:
                # All but the last shard are complete.
                whole = pa.Table.from_batches(held).combine_chunks()
                names = [whole[c].to_numpy() for c in ("choice", "key", "tree")]
                open_at = int(np.flatnonzero(np.any([n != n[-1] for n in names], axis=0))[-1] + 1) if any(
                    (n != n[-1]).any() for n in names) else 0
                if open_at:
                    yield answer(whole.slice(0, open_at).to_batches())
                    held = whole.slice(open_at).to_batches()
        if held:
            yield answer(held)

    dealt = spread.repartition("choice", "key", "tree").sortWithinPartitions("choice", "key", "tree", "fingerprint")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _named(rows: DataFrame, first: Column, radius: int, blocks: int | None, tree_size: int) -> DataFrame:
    """fingerprint, first (an aggregate of its rows), component (smallest fingerprint linked; null without links)."""
    vertices = checkpointed(rows.groupBy("fingerprint").agg(first.alias("first")))
    grouped = checkpointed(components(links(vertices.select("fingerprint"), radius, blocks, tree_size)))
    return vertices.join(grouped, vertices["fingerprint"] == grouped["vertex"], "left").select(
        "fingerprint", "first", "component")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                              radius: int = 4, blocks: int | None = None, tree_size: int = TREE_SIZE) -> DataFrame:
    """id_col, fingerprint (16 hex digits), component_id (smallest id linked, directly or not, itself included).

    A null or blank text has fingerprint 0 and is linked like any other. Null ids lose against any other id; a
    component of null ids only is null. Every row of the input gives one row, repeated rows included; an empty
    table gives none. Other columns are not read.
    """
    runs = shuffle_partitions(docs.sparkSession)
    rows = checkpointed(fingerprints(docs, id_col, text_col, width).withColumn(
        "_run", F.pmod(F.xxhash64(id_col), F.lit(runs)).cast("int")))
    named = _named(rows, F.min(id_col), radius, blocks, tree_size).withColumnRenamed("first", "first_id")
    lowest = checkpointed(named.where("component is not null").groupBy(F.col("component").alias("of"))
                          .agg(F.min("first_id").alias("lowest_id")))
    # A component may hold very many fingerprints: its one row is broadcast or salted.
    answer = attach(named, lowest, "component", "of", "fingerprint").select(
        "fingerprint", F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("lowest_id")).alias("component_id"))
    # Very many rows may share a fingerprint: its answer goes to each run of rows that has it, and there to the rows.
    by_run = rows.select("fingerprint", "_run").distinct().join(answer, "fingerprint")
    return rows.join(by_run, ["fingerprint", "_run"]).select(
        id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                         radius: int = 4, blocks: int | None = None, tree_size: int = TREE_SIZE) -> DataFrame:
    """One row of each component, with its own columns only.

    It is the row of the smallest id, null ids last; of several texts of that id in the component, the one of the
    smallest SHA-256. Rows are chosen by id and text, so unlike texts of one id, or of null ids, stay for themselves.
    """
    own = unused_prefix(docs)
    short = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = checkpointed(fingerprints(short, "id", width=width, digests=True))
    named = _named(rows, F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest")), radius, blocks, tree_size)
    # A component's name is one of its fingerprints, so a fingerprint without links can stand for itself.
    stay = (named.groupBy(F.coalesce("component", "fingerprint")).agg(F.min("first").alias("first"))
            .select(F.col("first.id").alias(f"{own}id"), F.col("first.digest").alias(f"{own}digest")))
    marked = docs.withColumn(f"{own}text", F.unhex(F.sha2(whole_text(text_col), 256)))
    joined = marked.join(stay, F.col(id_col).eqNullSafe(F.col(f"{own}id"))
                         & (F.col(f"{own}text") == F.col(f"{own}digest")), "left_semi")
    # The join has dealt rows by id and digest already: this needs no further exchange.
    kind = docs.schema[id_col].dataType
    nth = F.row_number().over(Window.partitionBy(F.coalesce(F.col(id_col), F.lit(0).cast(kind)), F.col(id_col).isNull(),
                                                 f"{own}text").orderBy(f"{own}text"))
    return joined.withColumn(f"{own}nth", nth).where(F.col(f"{own}nth") == 1).select(*docs.columns)
