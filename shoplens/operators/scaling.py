"""Reversible feature scaling: impute, one-hot, log and robust scale, time parts.

``fit`` learns a few numbers per column on the driver. ``transform`` and ``inverse_transform`` are
plain projections with those numbers as literals, so they stay in the scan's stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.frames import col, require_columns
from shoplens.functions.quantiles import quantiles_by_feature

COUNT_DISTINCT_SHARE = 0.1


@dataclass(frozen=True)
class Roles:
    """Which columns are treated how."""

    categorical: tuple[str, ...] = ()
    count: tuple[str, ...] = ()
    timestamp: tuple[str, ...] = ()
    numerical: tuple[str, ...] = ()

    def items(self) -> list[tuple[str, str]]:
        return [(c, role) for role in ("categorical", "count", "timestamp", "numerical") for c in getattr(self, role)]


def detect_roles(df: DataFrame, categorical: Sequence[str] | None = None, count: Sequence[str] | None = None,
                 timestamp: str | None = None, keys: Sequence[str] = ("customer_id",)) -> Roles:
    """Roles not given are found: text is categorical; whole, never negative or missing columns with
    few different values are counts; the rest is numerical."""
    names = [c for c in df.columns if c not in keys]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    require_columns(df, [*(categorical or ()), *(count or ()), *([timestamp] if timestamp else ())])
    if categorical is None:
        categorical = [c for c in names if isinstance(kinds[c], T.StringType)]
    if count is None:
        whole = [c for c in names if isinstance(kinds[c], T.IntegralType)]
        count = _count_like(df, whole) if whole else []
    taken = {*categorical, *count, timestamp}
    numerical = [c for c in names if c not in taken]
    unusable = [c for c in numerical if not isinstance(kinds[c], T.NumericType)]
    if unusable:
        raise ValueError(f"not numeric and without a role: {', '.join(unusable)}")
    return Roles(tuple(categorical), tuple(count), (timestamp,) if timestamp else (), tuple(numerical))


def _count_like(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Whole, never negative or missing columns in which fewer than a tenth of the values differ.

    A sketch of a few percent error decides; exact counts are taken only of the columns near the limit.
    """
    facts = df.agg(F.count("*").alias("n"), *[e for i, c in enumerate(columns) for e in (
        F.count(col(c)).alias(f"n_{i}"), F.min(col(c)).alias(f"least_{i}"),
        F.approx_count_distinct(col(c), 0.02).alias(f"different_{i}"))]).first()
    n, limit = facts["n"], facts["n"] * COUNT_DISTINCT_SHARE
    whole = [(c, facts[f"different_{i}"]) for i, c in enumerate(columns)
             if n and facts[f"n_{i}"] == n and facts[f"least_{i}"] >= 0]
    near = {c for c, about in whole if 0.8 * limit <= about <= 1.25 * limit}
    few = {c for c, about in whole if c not in near and about < limit}
    few |= {c for c in near if df.select(col(c)).distinct().count() < limit}
    return [c for c in columns if c in few]


def category_name(column: str, value) -> str:
    """Name of a one-hot column; numeric categories read as floats (``flag_1.0``)."""
    return f"{column}_{float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value}"


def learn_mode(df: DataFrame, column: str):
    """The most frequent value (the smallest on a tie), however many there are."""
    counted = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))
    best = counted.agg(F.min(F.struct((-F.col("n")).alias("minus_n"), "value")).alias("best")).first()["best"]
    if best is None:
        raise ValueError(f"column {column!r} has no value to learn from")
    return best["value"]


def learn_categories(df: DataFrame, column: str, most: int | None = None) -> list:
    """Sorted categories of a column. ``most``: a column with more is refused, as each becomes an output column."""
    values = df.where(col(column).isNotNull()).select(col(column).alias("value")).distinct()
    rows = (values if most is None else values.limit(most + 1)).collect()
    if most is not None and len(rows) > most:
        raise ValueError(f"column {column!r} has more than {most} categories")
    if not rows:
        raise ValueError(f"column {column!r} has no value to learn from")
    return sorted(r["value"] for r in rows)


def one_hot(column: Column, categories: Sequence) -> list[Column]:
    """0/1 column per category; a value that is none of them gives zeros everywhere."""
    return [F.when(column == F.lit(v), 1.0).otherwise(0.0) for v in categories]


def time_parts(moment: Column) -> dict[str, Column]:
    """Day of week (Monday 0), month and quarter."""
    return {"day_of_week": F.weekday(moment), "month": F.month(moment), "quarter": F.quarter(moment)}


@dataclass(frozen=True)
class FeatureScaler:
    """Learned parameters of one feature table."""

    roles: Roles
    fills: Mapping[str, object] = field(default_factory=dict)
    centers: Mapping[str, float] = field(default_factory=dict)
    scales: Mapping[str, float] = field(default_factory=dict)
    categories: Mapping[str, tuple] = field(default_factory=dict)

    def output_columns(self) -> list[str]:
        """Names of the transformed columns: categorical, count, timestamp, numerical."""
        names = [category_name(c, v) for c in self.roles.categorical for v in self.categories[c]]
        names += self.roles.count
        names += [f"{c}_{part}" for c in self.roles.timestamp for part in ("day_of_week", "month", "quarter")]
        return [*names, *self.roles.numerical]

    def output_counts(self) -> dict[str, int]:
        """Number of transformed columns per role."""
        return {"categorical": sum(len(self.categories[c]) for c in self.roles.categorical),
                "count": len(self.roles.count), "timestamp": 3 * len(self.roles.timestamp),
                "numerical": len(self.roles.numerical)}

    def imputed(self, column: str) -> Column:
        return F.coalesce(col(column), F.lit(self.fills[column]))

    def _scaled(self, value: Column, column: str) -> Column:
        return (value - self.centers[column]) / self.scales[column]

    def transform(self, df: DataFrame, keep: Sequence[str] = ("customer_id",)) -> DataFrame:
        """Scaled features of any frame with the learned columns; other columns are dropped."""
        r = self.roles
        require_columns(df, [*keep, *r.categorical, *r.count, *r.timestamp, *r.numerical])
        out = [hot.alias(category_name(c, v)) for c in r.categorical
               for v, hot in zip(self.categories[c], one_hot(self.imputed(c), self.categories[c]))]
        out += [self._scaled(F.log1p(self.imputed(c)), c).alias(c) for c in r.count]
        out += [part.cast("double").alias(f"{c}_{name}") for c in r.timestamp
                for name, part in time_parts(col(c)).items()]
        out += [self._scaled(self.imputed(c), c).alias(c) for c in r.numerical]
        return df.select(*[col(k) for k in keep], *out)

    def inverse_columns(self, available: Sequence[str]) -> dict[str, Column]:
        """Expression per numerical and count column that undoes the scaling."""
        def unscaled(c):
            return col(c) * self.scales[c] + self.centers[c]
        original = {c: unscaled(c) for c in self.roles.numerical if c in available}
        original.update({c: F.bround(F.expm1(unscaled(c))).cast("bigint")
                         for c in self.roles.count if c in available})
        return original

    def inverse_transform(self, df: DataFrame, keep: Sequence[str] = ("customer_id",)) -> DataFrame:
        """Original scale of numerical and count columns; counts are rounded half to even."""
        original = self.inverse_columns(df.columns)
        return df.select(*[col(k) for k in keep], *[e.alias(c) for c, e in original.items()])


def fit_scaler(df: DataFrame, categorical: Sequence[str] | None = None, count: Sequence[str] | None = None,
               timestamp: str | None = None, keys: Sequence[str] = ("customer_id",),
               most_categories: int | None = None) -> FeatureScaler:
    """Learn fill values, categories, centres and spreads. ``most_categories``: see ``learn_categories``."""
    roles = detect_roles(df, categorical, count, timestamp, keys)
    measured = [*roles.count, *roles.numerical]
    fills, categories = {}, {}
    for c in roles.categorical:
        categories[c], fills[c] = tuple(learn_categories(df, c, most_categories)), learn_mode(df, c)
    medians = quantiles_by_feature(df, measured, [0.5]) if measured else {}
    empty = [c for c in measured if c not in medians]
    if empty:
        raise ValueError(f"no value to learn from in: {', '.join(empty)}")
    fills.update({c: medians[c][0] for c in measured})
    filled = df.select([
        F.log1p(F.coalesce(col(c), F.lit(fills[c]))).alias(c) if c in roles.count
        else F.coalesce(col(c), F.lit(fills[c])).alias(c) for c in measured])
    quartiles = quantiles_by_feature(filled, measured, [0.25, 0.5, 0.75]) if measured else {}
    centers = {c: q[1] for c, q in quartiles.items()}
    # A column without spread keeps its unit.
    scales = {c: (q[2] - q[0]) or 1.0 for c, q in quartiles.items()}
    return FeatureScaler(roles, fills, centers, scales, categories)


class GenericScaler:
    """Stateful front of ``FeatureScaler``: fit once, then transform and invert other frames."""

    def __init__(self):
        self.model: FeatureScaler | None = None

    def fit_transform(self, df: DataFrame, **options) -> DataFrame:
        self.model = fit_scaler(df, **options)
        return self.model.transform(df, options.get("keys", ("customer_id",)))

    def _fitted(self) -> FeatureScaler:
        if self.model is None:
            raise ValueError("scaler is not fitted; call fit_transform first")
        return self.model

    def transform(self, df: DataFrame, keep: Sequence[str] = ("customer_id",)) -> DataFrame:
        return self._fitted().transform(df, keep)

    def inverse_transform(self, df: DataFrame, keep: Sequence[str] = ("customer_id",)) -> DataFrame:
        return self._fitted().inverse_transform(df, keep)
