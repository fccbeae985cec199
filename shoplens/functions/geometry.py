"""Distances to a fixed, small set of centres as plain column arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def squared_distance(point: Sequence[str], center: Sequence[float | str]) -> str:
    """SQL text of the squared distance from named columns to numbers or other named columns.

    Text, because a Column per operation costs a call to the JVM each; there are hundreds of them.
    """
    terms = []
    for name, value in zip(point, center):
        other = f"`{value}`" if isinstance(value, str) else f"({value!r}D)"
        terms.append(f"(`{name}` - {other}) * (`{name}` - {other})")
    return " + ".join(terms)


def nearest(distances: Mapping[int, str], present: Mapping[int, str] | None = None) -> Column:
    """Struct ``(distance, cluster)`` of the smallest distance; the lowest id wins a tie.

    ``present`` names per id a column that is NULL where the row has no such centre.
    """
    options = [f"named_struct('distance', {d}, 'cluster', {c})" for c, d in sorted(distances.items())]
    if present is not None:
        options = [f"if(`{present[c]}` IS NOT NULL, {option}, NULL)" for c, option in zip(sorted(distances), options)]
    return F.expr(options[0] if len(options) == 1 else f"least({', '.join(options)})")


def labels_under(models: Sequence[Mapping[int, Sequence[float]]], point: Sequence[Column]) -> Column:
    """Array with the nearest centre's id under each of many models.

    One column expression per model is beyond the size Spark compiles when there are many, so the
    distances of an Arrow batch to all centres are taken at once.
    """
    ids = [np.array(sorted(m)) for m in models]
    matrices = [np.array([m[c] for c in sorted(m)], dtype=float) for m in models]

    @F.pandas_udf("array<int>")
    def label(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        found = np.empty((len(rows), len(matrices)), dtype=np.int32)
        for j, (names, centers) in enumerate(zip(ids, matrices)):
            distance = np.zeros((len(rows), len(centers)))
            for d in range(rows.shape[1]):
                distance += (rows[:, d, None] - centers[None, :, d]) ** 2
            found[:, j] = names[distance.argmin(axis=1)]
        return pd.Series(list(found))

    return label(*point)
