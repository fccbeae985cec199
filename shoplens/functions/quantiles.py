"""Exact quantiles (linear interpolation) that never gather a group in one task.

One way at every size: a wanted rank is found by counting. The value range of a group is cut into bins, a combined
aggregate counts the rows per bin with their smallest and largest value, and the bin that holds the rank is cut again,
until it holds one distinct value. All ranks of all groups are looked for in the same jobs; every round divides a range
by the number of bins, so a few rounds suffice for any number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.frames import col, melt, small_table

#: Bins that a range is cut into.
BINS = 4096

_ARROW = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Quantiles of several columns: keys, ``feature``, ``n`` and ``quantiles`` (array)."""
    return grouped_quantiles(melt(df, columns, keys), [*keys, "feature"], probs)


def grouped_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of ``value`` per key: the keys, ``n`` and ``quantiles`` in the order of ``probs``.

    Keys must be few (features, clusters, methods), as a row per key and quantile comes to the driver. ``value``
    must not be NULL.
    """
    keys = list(keys)
    ranges = _ranges(long, keys)
    positions = {key: [float(p) * (n - 1) for p in probs] for key, (n, _, _) in ranges.items()}
    found = _at_positions(long, keys, ranges, positions)
    rows = [{**dict(zip(keys, key)), "n": ranges[key][0], "quantiles": values} for key, values in found.items()]
    kinds = _key_kinds(long, keys)
    return small_table(long.sparkSession, rows, pa.schema(
        [*[(k, kinds[k]) for k in keys], ("n", pa.int64()), ("quantiles", pa.list_(pa.float64()))]))


def quantiles_at(df: DataFrame, positions: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Values at fractional ranks (0-based) that differ by column, as plain numbers.

    Rank 2.5 is halfway between the third and the fourth smallest value.
    """
    long = melt(df, list(positions))
    ranges = _ranges(long, ["feature"])
    wanted = {(c,): [min(float(p), ranges[c,][0] - 1) for p in ps] for c, ps in positions.items() if (c,) in ranges}
    found = _at_positions(long, ["feature"], ranges, wanted)
    return {c: found.get((c,), [None] * len(ps)) for c, ps in positions.items()}


def quantiles_by_feature(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles as plain numbers, for expressions that are built on the driver."""
    return {r["feature"]: list(r["quantiles"]) for r in quantile_table(df, columns, probs).collect()}


def _key_kinds(long: DataFrame, keys: Sequence[str]) -> dict[str, pa.DataType]:
    return {f.name: _ARROW[type(f.dataType)] for f in long.schema.fields if f.name in keys}


def _ranges(long: DataFrame, keys: list[str]) -> dict[tuple, tuple[int, float, float]]:
    rows = long.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()
    return {tuple(r[k] for k in keys): (r["n"], float(r["lo"]), float(r["hi"])) for r in rows if r["n"]}


def _at_positions(long: DataFrame, keys: list[str], ranges: Mapping[tuple, tuple[int, float, float]],
                  positions: Mapping[tuple, Sequence[float]]) -> dict[tuple, list[float]]:
    """Values at the given fractional ranks of each key."""
    ranks = {(key, r) for key, wanted in positions.items() for p in wanted
             for r in (math.floor(p), min(math.floor(p) + 1, ranges[key][0] - 1))}
    value = _at_ranks(long, keys, {(key, r): (*ranges[key][1:], 0) for key, r in ranks})
    out = {}
    for key, wanted in positions.items():
        out[key] = []
        for p in wanted:
            rank = math.floor(p)
            low, high = value[key, rank], value[key, min(rank + 1, ranges[key][0] - 1)]
            out[key].append(low + (p - rank) * (high - low))
    return out


def _at_ranks(long: DataFrame, keys: list[str], states: dict[tuple, tuple[float, float, int]]) -> dict[tuple, float]:
    """The value of each (key, rank). states: range in which it lies and rows below the range."""
    kinds = _key_kinds(long, keys)
    schema = pa.schema([*[(k, kinds[k]) for k in keys], ("rank", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()),
                        ("below", pa.int64())])
    found = {}
    while states:
        found |= {state: lo for state, (lo, hi, _) in states.items() if lo == hi}
        states = {state: rest for state, rest in states.items() if state not in found}
        if not states:
            break
        rows = [{**dict(zip(keys, key)), "rank": rank, "lo": lo, "hi": hi, "below": below}
                for (key, rank), (lo, hi, below) in states.items()]
        # Large numbers are halved before they are subtracted, so that no range of doubles overflows.
        half = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1, 0.5).otherwise(1.0)
        share = (F.col("value") * half - F.col("lo") * half) / (F.col("hi") * half - F.col("lo") * half)
        counted = (
            long.join(small_table(long.sparkSession, rows, schema), keys)
            .where(F.col("value").between(F.col("lo"), F.col("hi")))
            .groupBy(*keys, "rank", "below", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        )
        upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin"))
        held = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        states = {(tuple(r[k] for k in keys), r["rank"]): (float(r["lo"]), float(r["hi"]), r["upto"] - r["n"])
                  for r in held.collect()}
    return found
