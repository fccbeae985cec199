"""Exact k-means steps that read only the rows whose nearest centre is in doubt.

The rows are cut once into cells by a k-d tree (fitted on a bounded sample taken by hash, then applied to every row
with one array expression). Per group and cell Spark stores the count, the sum, the mean, the scatter about the mean
and the bounding box, and writes the rows once, sorted by cell, into the shared folder.

In a step, a cell is settled for a model when its whole box lies on one centre's side of every bisector: for each
other centre the box corner farthest towards it is still nearer to the chosen centre, by a relative margin that
rounding cannot cross. A settled cell adds its count, sum and cost (scatter + count * squared distance of its mean)
to its centre without reading a row. Only rows of cells in doubt for some model are read, and the cell filter is
pushed into the parquet scan; a step where every cell is settled runs no job. Each row in doubt is labelled as in a
plain step, so centres, sizes and costs equal those of plain Lloyd steps up to the order of summation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the sample that places the tree's cuts (taken by smallest hash of the features, so the same at any
#: number of partitions); the sample bounds what the driver holds, the cells cover every row.
SAMPLE_ROWS = 16_384
#: Sample rows per leaf aimed at, and the deepest tree: at most 2**MAX_DEPTH cells.
LEAF_ROWS = 4
MAX_DEPTH = 12
#: A box corner must be nearer to the chosen centre by this share of the two squared distances.
MARGIN = 1e-9


@dataclass
class Cells:
    """Rows stored by cell and per group the statistics of its cells."""

    rows: DataFrame
    depth: int
    stats: dict[str, dict[str, np.ndarray]]
    total: dict[str, int]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where the master is local and it is unset."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shoplens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimension and threshold of every inner node (heap order from 1) of a complete tree of the sample."""
    dims, cuts = np.zeros(1 << depth, np.int32), np.full(1 << depth, np.inf)
    parts = {1: sample}
    for node in range(1, 1 << depth):
        own = parts.pop(node)
        if len(own) >= 2:
            spread = own.max(axis=0) - own.min(axis=0)
            dim = int(np.argmax(spread))
            cut = float(np.median(own[:, dim]))
            if spread[dim] > 0 and cut >= own[:, dim].max():  # keep both sides non-empty where values differ
                cut = float(np.sort(np.unique(own[:, dim]))[-2])
            dims[node], cuts[node] = dim, cut
            right = own[:, dim] > cut
        else:
            right = np.zeros(len(own), bool)
        parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return dims, cuts


def build(rows: DataFrame, width: int) -> Cells:
    """rows: _groups (array of group names) and x0..x{width-1}. Two passes for the statistics, one write."""
    xs = [F.col(f"x{i}") for i in range(width)]
    sample = np.array([[r[f"x{i}"] for i in range(width)] for r in
                       rows.select(*xs).orderBy(F.xxhash64(*xs)).limit(SAMPLE_ROWS).collect()], float).reshape(-1, width)
    depth = int(min(MAX_DEPTH, max(0, np.floor(np.log2(max(len(sample), 1) / LEAF_ROWS)))))
    dims, cuts = _tree(np.nan_to_num(sample), depth)
    point = F.array(*xs)
    dim_at, cut_at = F.lit(dims[1:].tolist()), F.lit(cuts[1:].tolist())
    node = F.aggregate(F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>"), F.lit(1),
                       lambda acc, _: 2 * acc + F.when(
                           F.element_at(point, F.element_at(dim_at, acc) + 1) > F.element_at(cut_at, acc), 1).otherwise(0))
    spark = rows.sparkSession
    where = shared_folder(spark, "lloyd-cells")
    (rows.withColumn("_cell", (node - (1 << depth)).cast("int")).repartitionByRange("_cell").sortWithinPartitions("_cell")
     .write.parquet(where))
    stored = spark.read.parquet(where)
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where))
    member = stored.select(F.explode("_groups").alias("_group"), "_cell", *xs)
    first = member.groupBy("_group", "_cell").agg(
        F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)],
        *[F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)], *[F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)])
    means = first.select("_group", "_cell", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(width)])
    scatter = member.join(F.broadcast(means), ["_group", "_cell"]).groupBy("_group", "_cell").agg(
        F.sum(sum((F.col(f"x{i}") - F.col(f"m{i}")) ** 2 for i in range(width))).alias("w"))
    found = first.join(means, ["_group", "_cell"]).join(scatter, ["_group", "_cell"]).collect()
    stats: dict[str, dict[str, list]] = {}
    for r in found:
        own = stats.setdefault(r["_group"], {k: [] for k in ("cell", "n", "sum", "mean", "w", "lo", "hi")})
        own["cell"].append(r["_cell"])
        own["n"].append(r["n"])
        own["w"].append(r["w"])
        for name, prefix in (("sum", "s"), ("mean", "m"), ("lo", "lo"), ("hi", "hi")):
            own[name].append([r[f"{prefix}{i}"] for i in range(width)])
    arrays = {g: {k: np.array(v, float if k not in ("cell", "n") else np.int64).reshape(len(v), -1) if k in
                  ("sum", "mean", "lo", "hi") else np.array(v, float if k == "w" else np.int64) for k, v in own.items()}
              for g, own in stats.items()}
    return Cells(stored, depth, arrays, {g: int(a["n"].sum()) for g, a in arrays.items()})


def settle(stats: Mapping[str, np.ndarray], centers: np.ndarray) -> np.ndarray:
    """Per cell the index of the centre that all of its box is nearest to, -1 where that is in doubt."""
    lo, hi = stats["lo"], stats["hi"]
    mid = (lo + hi) / 2
    chosen = ((mid[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    at = centers[chosen]
    corner = np.where(centers[None] > at[:, None, :], hi[:, None, :], lo[:, None, :])
    other = ((corner - centers[None]) ** 2).sum(axis=2)
    own = ((corner - at[:, None, :]) ** 2).sum(axis=2)
    clear = (other - own) > MARGIN * (other + own)
    clear[np.arange(len(chosen)), chosen] = True
    return np.where(clear.all(axis=1), chosen, -1)


def step(cells: Cells, width: int, models: Mapping[str, tuple[str, dict[int, tuple[float, ...]]]]
         ) -> tuple[dict[str, tuple[dict[int, np.ndarray], float]], dict[str, float]]:
    """Per model and cluster: count, cost and sums (as one array), and the share of the group's rows read."""
    totals: dict[str, dict[int, np.ndarray]] = {}
    doubt: dict[str, tuple[str, list[int], np.ndarray, np.ndarray]] = {}
    read: dict[str, float] = {}
    wanted: set[int] = set()
    for name, (group, centers) in models.items():
        stats = cells.stats.get(group)
        if stats is None:
            continue
        ids = sorted(centers)
        at = np.array([centers[c] for c in ids], float).reshape(len(ids), width)
        label = settle(stats, at)
        own: dict[int, np.ndarray] = {}
        done = label >= 0
        for j in np.unique(label[done]):
            mine = label == j
            n = stats["n"][mine]
            cost = stats["w"][mine].sum() + (n * ((stats["mean"][mine] - at[j]) ** 2).sum(axis=1)).sum()
            own[ids[j]] = np.concatenate([[n.sum(), cost], stats["sum"][mine].sum(axis=0)])
        totals[name] = own
        open_cells = stats["cell"][~done]
        read[name] = float(stats["n"][~done].sum() / max(stats["n"].sum(), 1))
        if len(open_cells):
            mask = np.zeros(1 << cells.depth, bool)
            mask[open_cells] = True
            doubt[name] = (group, ids, at, mask)
            wanted |= set(open_cells.tolist())
    if doubt:
        for r in _read(cells, width, doubt, sorted(wanted)):
            values = np.array([r[f"v{i}"] for i in range(width + 2)])
            own = totals[r["model"]]
            own[r["cluster"]] = own[r["cluster"]] + values if r["cluster"] in own else values
    return {name: (own, 0.0) for name, own in totals.items()}, read


def _read(cells: Cells, width: int, doubt: Mapping[str, tuple], wanted: list[int]) -> list:
    by_group: dict[str, list] = {}
    for name, (group, ids, centers, mask) in doubt.items():
        by_group.setdefault(group, []).append((name, ids, centers, mask))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            points = np.column_stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(width)])
            cell = batch.column("_cell").to_numpy(zero_copy_only=False)
            lists = batch.column("_groups")
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            for number, group in enumerate(coded.dictionary.to_pylist()):
                if group not in by_group:
                    continue
                members = row[code == number]
                for name, ids, centers, mask in by_group[group]:
                    own = points[members[mask[cell[members]]]]
                    if not len(own):
                        continue
                    distance = np.zeros((len(own), len(centers)))
                    for d in range(width):
                        distance += (own[:, d, None] - centers[None, :, d]) ** 2
                    label = distance.argmin(axis=1)
                    found = [np.bincount(label, minlength=len(ids)), np.bincount(label, distance.min(axis=1), len(ids))]
                    found += [np.bincount(label, own[:, d], len(ids)) for d in range(width)]
                    for j, values in enumerate(np.array(found).T):
                        if values[0]:
                            held = (name, ids[j])
                            sums[held] = sums[held] + values if held in sums else values
        table = np.array(list(sums.values())).reshape(len(sums), width + 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m for m, _ in sums], pa.string()), pa.array([c for _, c in sums], pa.int32()),
             *[pa.array(table[:, i]) for i in range(width + 2)]],
            names=["model", "cluster", *[f"v{i}" for i in range(width + 2)]])

    schema = ", ".join(["model string", "cluster int", *[f"v{i} double" for i in range(width + 2)]])
    # each task sends one row per model and cluster it saw; no shuffle stage for a handful of numbers
    summed: dict[tuple[str, int], np.ndarray] = {}
    for r in cells.rows.where(F.col("_cell").isin(wanted)).mapInArrow(run, schema).collect():
        values = np.array([r[f"v{i}"] for i in range(width + 2)])
        held = (r["model"], r["cluster"])
        summed[held] = summed[held] + values if held in summed else values
    return [{"model": m, "cluster": c, **{f"v{i}": v[i] for i in range(width + 2)}} for (m, c), v in summed.items()]
