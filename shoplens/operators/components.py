"""Principal components of the scaled features: projection, explained variance and loadings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.frames import col, small_table
from shoplens.functions.geometry import total

MOST_COMPONENTS = 10


@dataclass(frozen=True)
class Components:
    """Means, loadings (one row per feature) and variance shares of fitted components."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]
    variance_ratios: tuple[float, ...]

    @property
    def names(self) -> list[str]:
        return [f"pc{j + 1}" for j in range(len(self.variance_ratios))]

    def project(self, df: DataFrame, keep: Sequence[str] = ("customer_id",), n: int | None = None) -> DataFrame:
        """Centred projection on the first ``n`` components; sums of column products, no UDF."""
        scores = [
            total([(col(c) - m) * row[j] for c, m, row in zip(self.columns, self.means, self.loadings)]).alias(name)
            for j, name in enumerate(self.names[:n])]
        return df.select(*[col(k) for k in keep], *scores)

    def explained_variance(self, spark: SparkSession) -> DataFrame:
        """Variance share of each component and of all up to it."""
        rows, reached = [], 0.0
        for j, ratio in enumerate(self.variance_ratios):
            reached += ratio
            rows.append({"component": j + 1, "explained_variance": ratio, "cumulative_variance": reached})
        schema = pa.schema([("component", pa.int32()), ("explained_variance", pa.float64()),
                            ("cumulative_variance", pa.float64())])
        return small_table(spark, rows, schema)

    def _loading_table(self, spark: SparkSession, n: int, absolute: bool = False) -> DataFrame:
        names = self.names[:n]
        rows = [{"feature": c, **{name: abs(v) if absolute else v for name, v in zip(names, row)}}
                for c, row in zip(self.columns, self.loadings)]
        return small_table(spark, rows, pa.schema([("feature", pa.string()), *[(n_, pa.float64()) for n_ in names]]))

    def top_loadings(self, spark: SparkSession, n_features: int = 20) -> DataFrame:
        """Features with the longest loading vectors on the first two components."""
        second = "pc2" if len(self.names) > 1 else "pc1"
        magnitude = F.sqrt(F.col("pc1") ** 2 + F.col(second) ** 2) if second == "pc2" else F.abs("pc1")
        return (
            self._loading_table(spark, 2).withColumn("magnitude", magnitude)
            .orderBy(F.desc("magnitude"), "feature").limit(n_features)
        )

    def feature_importance(self, spark: SparkSession, n_components: int = 3) -> DataFrame:
        """Absolute loadings on the first components, the largest row sum first."""
        table = self._loading_table(spark, n_components, absolute=True)
        size = total([F.col(name) for name in table.columns[1:]])
        return table.withColumn("total_loading", size).orderBy(F.desc("total_loading"), "feature")


def fit_components(df: DataFrame, columns: Sequence[str], n_components: int = MOST_COMPONENTS) -> Components:
    """Fit components of the centred, not standardised columns.

    ``ml.PCA`` does not centre what it projects, so the means are kept and subtracted; signs are
    fixed by making the largest loading of each component positive.
    """
    columns = list(columns)
    row = df.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    means = tuple(row)
    if any(m is None for m in means):
        raise ValueError("no rows to fit components on")
    centred = df.select(array_to_vector(F.array(*[col(c) - m for c, m in zip(columns, means)])).alias("vector"))
    model = PCA(k=min(n_components, len(columns)), inputCol="vector", outputCol="scores").fit(centred)
    matrix = model.pc.toArray().copy()
    for j in range(matrix.shape[1]):
        # Equal loadings may differ by rounding: the first of the largest decides.
        if matrix[abs(matrix[:, j]).round(9).argmax(), j] < 0:
            matrix[:, j] *= -1
    return Components(tuple(columns), means, tuple(tuple(map(float, r)) for r in matrix),
                      tuple(map(float, model.explainedVariance.toArray())))
