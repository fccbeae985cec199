"""k-means steps of many models at once.

Restarts, numbers of clusters, samples and periods are models over one table of rows. The rows are packed once into
matrices of some thousand rows, kept in executor storage. One step of all models is one job over these: each task labels
a matrix under every model by matrix products and sums the rows of each cluster; a few numbers per model and cluster
come to the driver. A model takes part until its centres stand still.

Starts do not depend on how rows are dealt out: the j-th start of a restart is the row with the smallest hash of key,
restart and j. So a fit gives the same centres, up to the last digits of sums, for any number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.functions.frames import col
from shoplens.operators import lloyd_cells

#: Movement of every coordinate of a model's centres below which the model is finished.
STANDSTILL = 1e-9
#: Steps after which a model is finished in any case.
MOST_STEPS = 300
#: Starts that take their digits from one hash.
_PER_HASH = 10
#: Rows of a packed matrix (1.6 MB with 20 columns) and bytes of the matrices of one task.
BLOCK_ROWS = 10_000
TASK_BYTES = 1 << 25
#: Two centres whose distances, taken by products, differ by less than this share of the squared lengths are compared
#: again by differences: a thousand times the rounding of the products.
DOUBT = 1e-12


@dataclass(frozen=True)
class Outcome:
    """Centres by cluster id with their numbers of rows; cost: sum of squared distances to the nearest centre."""

    centers: dict[int, tuple[float, ...]]
    sizes: dict[int, int]
    cost: float
    steps: int
    #: Per step, the share of the group's rows that had to be read (the rest was settled by cells).
    read: tuple[float, ...] = ()


def _digest(key: str, restart: int, part: int) -> Column:
    return F.md5(F.concat(col(key).cast("string"), F.lit(f"-{restart}-{part}")))


def _least_member() -> Callable:
    """Function made here, so that it travels to tasks by value."""

    def first(head: np.ndarray, place: np.ndarray, points: np.ndarray, members: np.ndarray) -> int:
        """Of the members, the row with the least place (head: its first eight characters), then the least point."""
        own = head[members]
        tied = members[own == own.min()]
        if len(tied) > 1:
            tied = tied[place[tied] == np.sort(place[tied])[0]]
            tied = tied[np.lexsort(points[tied].T[::-1])]
        return int(tied[0])

    return first


def _membership_reader() -> Callable:
    """Function made here, so that it travels to tasks by value."""

    def memberships(lists: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Group names, row numbers sorted by group, and where each group's row numbers begin and end."""
        row = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        row, code = row[code >= 0], code[code >= 0]
        order = np.argsort(code, kind="stable")
        names = coded.dictionary.to_pylist()
        return names, row[order], np.searchsorted(code[order], np.arange(len(names) + 1))

    return memberships


def starting_rows(df: DataFrame, columns: Sequence[str], k: int, restarts: int, key: str, groups: Column,
                  seed: int = 0) -> dict[str, list[list[tuple[float, ...]]]]:
    """Per group and restart the k rows to start from.

    groups: array of names of the groups that a row belongs to. Every batch keeps one candidate per start and group, the
    least of them counts, so k times restarts rows per group come to the driver.
    """
    width, parts = len(columns), -(-k // _PER_HASH)
    memberships, first = _membership_reader(), _least_member()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, members, bounds = memberships(batch.column(0))
            points = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)])
            found: dict[str, list] = {"group": [], "start": [], "place": [], "at": []}
            for r in range(restarts):
                for part in range(parts):
                    # a missing key has the empty digest, which is less than any other
                    digest = np.array(batch.column(1 + width + r * parts + part).fill_null("").to_pylist(), dtype="S32")
                    digits = digest.view("S1").reshape(-1, 32)
                    for j in range(part * _PER_HASH, min(k, (part + 1) * _PER_HASH)):
                        at = 3 * (j % _PER_HASH)
                        place = np.concatenate([digits[:, at:at + 3], digits], axis=1)
                        head = place[:, :8].copy().view(">u8")[:, 0].astype(np.uint64)
                        place = place.view("S35")[:, 0]
                        for g, name in enumerate(names):
                            if bounds[g] < bounds[g + 1]:
                                best = first(head, place, points, members[bounds[g]:bounds[g + 1]])
                                found["group"].append(name)
                                found["start"].append(r * k + j)
                                found["place"].append(place[best].decode())
                                found["at"].append(points[best].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found["group"], pa.string()), pa.array(found["start"], pa.int32()),
                 pa.array(found["place"], pa.string()), pa.array(found["at"], pa.list_(pa.float64()))], names=list(found))

    digests = [_digest(key, seed + r, part).alias(f"d{r}_{part}") for r in range(restarts) for part in range(parts)]
    rows = df.select(groups.cast("array<string>").alias("_groups"),
                     *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *digests)
    best = rows.mapInArrow(run, "group string, start int, place string, at array<double>").groupBy("group", "start").agg(
        F.min(F.struct("place", "at")).alias("first"))
    out: dict[str, list[list[tuple[float, ...]]]] = {}
    for row in sorted(best.collect(), key=lambda r: (r["group"], r["start"])):
        own = out.setdefault(row["group"], [[] for _ in range(restarts)])
        own[row["start"] // k].append(tuple(row["first"]["at"]))
    return out


BLOCK_SCHEMA = "names array<string>, bounds array<int>, members binary, points binary"


def _pack(width: int):
    """Rows (_groups, x0..) as matrices of at most BLOCK_ROWS rows, with the row numbers of each group."""
    memberships = _membership_reader()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                share = batch.slice(begin, BLOCK_ROWS)
                names, members, bounds = memberships(share.column(0))
                points = np.column_stack([share.column(i + 1).to_numpy(zero_copy_only=False) for i in range(width)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names], pa.list_(pa.string())), pa.array([bounds.tolist()], pa.list_(pa.int32())),
                     pa.array([members.astype(np.int32).tobytes()], pa.binary()),
                     pa.array([np.ascontiguousarray(points, dtype=np.float64).tobytes()], pa.binary())],
                    names=["names", "bounds", "members", "points"])
    return run


def _nearest_finder() -> Callable:
    """Function made here, so that it travels to tasks by value."""

    def nearest(points: np.ndarray, lengths: np.ndarray, centers: np.ndarray) -> np.ndarray:
        """Centres by rows: 1 where the centre is the row's nearest, of equally near ones the first; else 0.

        Distances are taken by a matrix product. Rows for which several centres are near the least by less than rounding
        can explain (or whose numbers are not finite) are decided by sums of squared differences.
        """
        own = (centers ** 2).sum(axis=1)
        distance = centers @ points.T
        distance *= -2
        distance += own[:, None]
        limit = distance.min(axis=0) + DOUBT * (lengths + own.max())
        hot = distance <= limit
        unsure = np.nonzero(hot.sum(axis=0) != 1)[0]
        if len(unsure):
            again = np.zeros((len(unsure), len(centers)))
            for d in range(points.shape[1]):
                again += (points[unsure, d, None] - centers[None, :, d]) ** 2
            hot[:, unsure] = False
            hot[again.argmin(axis=1), unsure] = True
        return hot.astype(np.float64)

    return nearest


def _step(blocks: DataFrame, width: int, models: Mapping[str, tuple[str, dict[int, tuple[float, ...]]]],
          with_cost: bool = True) -> dict[str, Outcome]:
    """One step of all models over packed rows; without with_cost all costs are 0."""
    if not models:
        return {}
    by_group: dict[str, list] = {}
    places: dict[str, tuple[int, list[int]]] = {}
    used, nearest = 0, _nearest_finder()
    for name, (group, centers) in models.items():
        ids = sorted(centers)
        by_group.setdefault(group, []).append((used, np.array([centers[c] for c in ids], float).reshape(len(ids), width)))
        places[name] = (used, ids)
        used += len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((used, width + 2))
        with np.errstate(invalid="ignore", over="ignore"):
            for batch in batches:
                for i in range(batch.num_rows):
                    all_points = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64).reshape(-1, width)
                    bounds = batch.column(1)[i].as_py()
                    for g, group in enumerate(batch.column(0)[i].as_py()):
                        if group not in by_group or bounds[g] == bounds[g + 1]:
                            continue
                        members = np.frombuffer(batch.column(2)[i].as_buffer(), np.int32)
                        points = all_points[members[bounds[g]:bounds[g + 1]]]
                        lengths = (points ** 2).sum(axis=1)
                        finite = bool(np.isfinite(lengths).all())
                        for at, centers in by_group[group]:
                            hot = nearest(points, lengths, centers)
                            own = sums[at:at + len(centers)]
                            own[:, 0] += hot.sum(axis=1)
                            if finite:
                                own[:, 2:] += hot @ points
                            if with_cost or not finite:
                                label = hot.argmax(axis=0)
                                cost = ((points - centers[label]) ** 2).sum(axis=1)
                                own[:, 1] += np.bincount(label, cost, len(centers))
                                if not finite:  # a product would carry such numbers into the other clusters
                                    for d in range(width):
                                        own[:, d + 2] += np.bincount(label, points[:, d], len(centers))
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((used, width + 2))
    for r in blocks.mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(r["sums"], np.float64).reshape(used, width + 2)
    out: dict[str, Outcome] = {}
    for name, (at, ids) in places.items():
        own = {c: total[at + j] for j, c in enumerate(ids) if total[at + j, 0] > 0}
        if own:
            out[name] = Outcome({c: tuple((v[2:] / v[0]).tolist()) for c, v in own.items()},
                                {c: int(v[0]) for c, v in own.items()}, float(sum(v[1] for v in own.values())), 0)
    return out


def _cell_step(cells, width: int, models) -> tuple[dict[str, Outcome], dict[str, float]]:
    found, read = lloyd_cells.step(cells, width, models)
    out: dict[str, Outcome] = {}
    for name, (clusters, _) in found.items():
        ids = sorted(c for c, v in clusters.items() if v[0] > 0)
        if ids:
            out[name] = Outcome({c: tuple(float(x) for x in clusters[c][2:] / clusters[c][0]) for c in ids},
                                {c: int(clusters[c][0]) for c in ids}, float(sum(clusters[c][1] for c in ids)), 0)
    return out, read


def converge(df: DataFrame, columns: Sequence[str], models: Mapping[str, tuple[str, Mapping[int, Sequence[float]]]],
             groups: Column, most_steps: int = MOST_STEPS, standstill: float = STANDSTILL, cells: bool = False
             ) -> dict[str, Outcome]:
    """Every model (name: group and start centres by id) stepped until its centres stand still.

    Of equally near centres the lowest id gets the row; a cluster without rows is dropped; models whose group has no
    rows are missing from the result. By default every step reads all rows, packed once. With cells rows are read only
    where a cell's nearest centre is in doubt (lloyd_cells), which pays for few columns and clusters far apart; `read` of
    each outcome gives the share of rows read per step.
    """
    width = len(columns)
    rows = df.select(groups.cast("array<string>").alias("_groups"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    current = {name: (group, {c: tuple(map(float, at)) for c, at in centers.items()}) for name, (group, centers) in models.items()}
    if cells:
        built = lloyd_cells.build(rows, width)
        return _until_still(current, lambda models: _cell_step(built, width, models), most_steps, standstill)[0]
    blocks = _blocks(rows, width, rows.count())
    try:
        def step(models):
            return _step(blocks, width, models, with_cost=False), {name: 1.0 for name in models}

        done, last = _until_still(current, step, most_steps, standstill)
        # the last step of every model again, now with its cost
        costs = _step(blocks, width, last)
        return {name: replace(outcome, cost=costs[name].cost) for name, outcome in done.items()}
    finally:
        blocks.unpersist()


def _blocks(rows: DataFrame, width: int, n: int) -> DataFrame:
    """The rows packed by _pack, kept in executor storage (lost blocks are packed again), dealt evenly to bounded tasks."""
    blocks = rows.mapInArrow(_pack(width), BLOCK_SCHEMA)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if n > 4 * cores * BLOCK_ROWS:
        blocks = blocks.repartition(cores * -(-8 * n * width // (cores * TASK_BYTES)))
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _until_still(current: dict, step: Callable, most_steps: int, standstill: float) -> tuple[dict[str, Outcome], dict]:
    """Outcome of every model's last step, and the models as they went into it."""
    done: dict[str, Outcome] = {}
    last: dict[str, tuple[str, dict]] = {}
    shares: dict[str, list[float]] = {}
    for number in range(1, most_steps + 1):
        found, read = step(current)
        moving = {}
        for name, outcome in found.items():
            group, before = current[name]
            shares.setdefault(name, []).append(read.get(name, 1.0))
            done[name] = Outcome(outcome.centers, outcome.sizes, outcome.cost, number, tuple(shares[name]))
            last[name] = current[name]
            moved = max(abs(a - b) for c, at in outcome.centers.items() for a, b in zip(at, before[c]))
            if moved > standstill:
                moving[name] = (group, outcome.centers)
        if not moving:
            break
        current = moving
    return done, last


def best_of(outcomes: Sequence[Outcome]) -> Outcome:
    """The lowest cost; the first of those that differ by rounding only."""
    lowest = min(o.cost for o in outcomes)
    return next(o for o in outcomes if o.cost <= lowest * (1 + 1e-9) + 1e-12)
