"""Shared intermediate results of one session and one data folder.

Many queries start from the customer features or from the scaled features. Each is computed once,
kept in the result store and read back, instead of scanning the fact tables for every query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.functions.frames import spread_out
from shoplens.operators import features as feat
from shoplens.operators import outliers, segments
from shoplens.operators.clustering import (
    Centers, GroupedCenters, KMeansFit, fit_kmeans, grouped_lloyd, grouped_starts, lloyd, start_cuts)
from shoplens.operators.components import Components, fit_components
from shoplens.operators.lloyd_steps import MOST_STEPS, converge
from shoplens.operators.stability import PeriodData, bootstrap_samples, period_data, sample_cuts, sample_names
from shoplens.operators.scaling import FeatureScaler, fit_scaler
from shoplens.sources.catalog import scan
from shoplens.sources.marketplace import Marketplace, load_marketplace
from shoplens.sources.store import ResultStore

CLUSTERS = 4
START_COLUMN = "monetary"


class Workspace:
    """Tables, features and fitted parameters, each made on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.segment_config = segments.DEFAULT_CONFIG

    def table(self, name: str) -> DataFrame:
        return scan(self.spark, self.folder, name)

    def stored(self, key: str, build, **parameters) -> DataFrame:
        """Result kept under the key, for this data folder and these parameters."""
        return self.store.fetch(key, build, folder=self.folder, **parameters)

    @cached_property
    def store(self) -> ResultStore:
        return ResultStore(self.spark)

    @cached_property
    def market(self) -> Marketplace:
        return load_marketplace(self.spark, self.folder)

    @cached_property
    def features(self) -> DataFrame:
        m = self.market
        return self.stored("features", lambda: feat.customer_features(
            m.customers, m.orders, m.items, m.products, m.reviews))

    @cached_property
    def limits(self) -> dict:
        """Limits of the three-deviations rule per feature."""
        return outliers.outlier_limits(self.features, feat.FEATURE_COLUMNS, [outliers.Z3])[outliers.Z3]

    @cached_property
    def hybrid(self) -> DataFrame:
        return feat.hybrid_features(self.features, outliers.cleaned_columns(self.limits))

    @cached_property
    def scaler(self) -> FeatureScaler:
        return fit_scaler(self.hybrid.drop("order_purchase_timestamp"), feat.FLAG_COLUMNS, feat.COUNT_COLUMNS)

    @cached_property
    def scaled(self) -> DataFrame:
        """Scaled features with their key: every fit and profile reads this table again."""
        return self.stored("scaled", lambda: self.scaler.transform(spread_out(self.hybrid)))

    @property
    def scaled_columns(self) -> list[str]:
        return self.scaler.output_columns()

    @cached_property
    def components(self) -> Components:
        return fit_components(self.scaled, self.scaled_columns)

    @cached_property
    def component_scores(self) -> DataFrame:
        return self.stored("components", lambda: self.components.project(self.scaled))

    @cached_property
    def centers(self) -> Centers:
        """Fixed-start centres that every checkable segment table uses."""
        return lloyd(self.scaled, self.scaled_columns, CLUSTERS, START_COLUMN)

    @cached_property
    def fitted(self) -> KMeansFit:
        """The best of several hashed starts on all scaled features."""
        return fit_kmeans(self.scaled, self.scaled_columns, CLUSTERS)

    @property
    def fitted_labels(self) -> DataFrame:
        return self.fitted.centers.assign(self.scaled).drop("squared_distance")

    @cached_property
    def fitted_profile(self) -> DataFrame:
        return segments.profile_table(self.fitted_labels, self.scaled_columns, self.scaler)

    @cached_property
    def dashboard(self) -> dict[str, DataFrame]:
        return segments.segment_dashboard(self.fitted_labels, self.scaled_columns, self.scaler, self.segment_config, self.hybrid)

    @property
    def labelled(self) -> DataFrame:
        return self.centers.assign(self.scaled).drop("squared_distance")

    @cached_property
    def profile(self) -> DataFrame:
        return segments.profile_table(self.labelled, self.scaled_columns, self.scaler)

    @cached_property
    def order_dates(self) -> DataFrame:
        """Every order date of every customer, so that periods share customers."""
        return self.market.orders.select("customer_id", "order_purchase_timestamp")

    @cached_property
    def last_dates(self) -> DataFrame:
        return feat.with_last_purchase(self.hybrid, self.market.orders).select(
            "customer_id", "order_purchase_timestamp")

    def periods(self, dates: str, period: str, minimum: int) -> PeriodData:
        """Features per period, stored before they are counted: every step reads them from this table.

        dates: ``order_dates`` or ``last_dates``.
        """
        return period_data(self.scaled, getattr(self, dates), self.scaled_columns, period, minimum,
                           keep=lambda name, build: self.stored(name, build, dates=dates))

    @cached_property
    def yearly(self) -> PeriodData:
        return self.periods("order_dates", "year", 5 * CLUSTERS)

    @cached_property
    def quarterly(self) -> PeriodData:
        return self.periods("last_dates", "quarter", 10)

    def period_centers(self, data: PeriodData) -> GroupedCenters:
        kept = data.rows.where(F.col("period").isin(data.kept))
        cuts = start_cuts(kept, CLUSTERS, START_COLUMN, "period")
        return grouped_lloyd(kept, self.scaled_columns, cuts, START_COLUMN, "period")

    @cached_property
    def sample_centers(self) -> list[Centers]:
        """Fixed-start centres of each repeated sample; a step reads each row once for all its samples."""
        columns = self.scaled_columns
        cuts = sample_cuts(self.scaled)
        rows = bootstrap_samples(self.scaled, keep=columns, cuts=cuts).withColumn("iteration", F.col("iteration").cast("string"))
        starts = grouped_starts(rows, columns, start_cuts(rows, CLUSTERS, START_COLUMN, "iteration"), START_COLUMN, "iteration")
        found = converge(self.scaled, columns, {g: (g, at) for g, at in starts.items()},
                         sample_names(cuts, len(cuts.keys)), MOST_STEPS - 1)
        return [Centers(tuple(columns), found[g].centers) for g in sorted(starts, key=int)]


_open: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    """The workspace of this session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Workspace(spark, folder)
    return _open[key]


def close_workspaces() -> None:
    """Drop stored results, so that the next query starts from the tables."""
    for space in _open.values():
        if "store" in space.__dict__:
            space.store.clear()
    _open.clear()
