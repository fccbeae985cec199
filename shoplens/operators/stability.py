"""How stable a segmentation is: repeated samples, calendar periods, agreement of labelings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.dates import period_label, period_start, require_period
from shoplens.functions.frames import col, require_columns, small_table
from shoplens.functions.geometry import labels_under
from shoplens.operators.clustering import RESTARTS, SEED, Centers, GroupedCenters, fit_groups, hashed_order

LEAST_COMMON = 10
DATE_COLUMN = "order_purchase_timestamp"


# --- agreement of two labelings ------------------------------------------------------------------


def _pairs_in(count: Column) -> Column:
    n = count.cast("double")
    return n * (n - 1) / 2


def ari_table(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adjusted Rand index per key from contingency cells ``(keys, a, b, n)``.

    The cells are at most a few per key, so the sums run on a tiny table.
    """
    keys = list(keys)
    rows = cells.groupBy(*keys, "a").agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(_pairs_in(F.col("m"))).alias("in_a"))
    columns = cells.groupBy(*keys, "b").agg(F.sum("n").alias("m")).groupBy(*keys).agg(F.sum(_pairs_in(F.col("m"))).alias("in_b"))
    both = cells.groupBy(*keys).agg(F.sum("n").alias("n_common"), F.sum(_pairs_in(F.col("n"))).alias("together"))
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), _pairs_in(F.col("n_common")))
    most = (F.col("in_a") + F.col("in_b")) / 2
    # Two labelings that both say nothing, or both separate everything, agree fully.
    ari = F.coalesce(F.try_divide(F.col("together") - expected, most - expected), F.lit(1.0))
    return both.join(rows, keys).join(columns, keys).select(*keys, "n_common", ari.alias("ari"))


def adjusted_rand_index(labelled: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two label columns as one row (``n_common``, ``ari``)."""
    cells = labelled.groupBy(col(a).alias("a"), col(b).alias("b")).agg(F.count("*").alias("n"))
    return ari_table(cells.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")


def pair_cells(labelled: DataFrame, n_labelings: int) -> DataFrame:
    """Contingency cells (i, j, a, b, n) of every two labelings in the array column ``labels`` (NULL: not labelled).

    The labels of a batch, written as 0/1 columns per labeling and cluster, are multiplied with themselves: the product
    holds all cells of all pairs. Only these, summed per task, are shuffled; no row is multiplied.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((n_labelings, 0, n_labelings, 0))
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            labels = np.nan_to_num(flat, nan=-1).astype(int).reshape(-1, n_labelings)
            k = max(labels.max(initial=-1) + 1, held.shape[1])
            hot = (labels[:, :, None] == np.arange(k)).reshape(len(labels), n_labelings * k).astype(float)
            grow = ((0, 0), (0, k - held.shape[1])) * 2
            held = np.pad(held, grow) + (hot.T @ hot).reshape(n_labelings, k, n_labelings, k)
        i, a, j, b = np.nonzero(held)
        upper = i < j
        i, a, j, b = i[upper], a[upper], j[upper], b[upper]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(x, pa.int32()) for x in (i, j, a, b)], pa.array(held[i, a, j, b].astype(np.int64))],
            names=["i", "j", "a", "b", "n"])

    return labelled.select("labels").mapInArrow(run, "i int, j int, a int, b int, n bigint").groupBy("i", "j", "a", "b").agg(
        F.sum("n").alias("n"))


def pairwise_ari(labelled: DataFrame, n_labelings: int, least_common: int = LEAST_COMMON) -> DataFrame:
    """Agreement of every two labelings in the array column ``labels`` (NULL: not labelled)."""
    return ari_table(pair_cells(labelled, n_labelings), ["i", "j"]).where(F.col("n_common") >= least_common)


def ari_summary(scores: DataFrame) -> DataFrame:
    """Number, mean and population deviation of agreement scores."""
    return scores.agg(F.count("ari").alias("n_pairs"), F.avg("ari").alias("mean_ari"),
                      F.stddev_pop("ari").alias("std_ari"))


# --- repeated samples ----------------------------------------------------------------------------


#: Bins of the digest space (its first four hex digits) that locate each sample's cut in the first pass.
DIGEST_BINS_HEX = 4


def _digest(key: str, iteration: Column) -> Column:
    return F.md5(F.concat(col(key).cast("string"), F.lit("-"), iteration.cast("string")))


@dataclass(frozen=True)
class SampleCuts:
    """Per sample the (digest, key) of its last member: a row belongs to sample i when its (digest, key) is not above.

    A sample holds exactly int(fraction * n) of the n rows with a key, those first by md5 of "key-i", ties by key.
    Rows without a key belong to no sample; rows that repeat a key share its membership.
    """

    key: str
    digests: tuple[str | None, ...]
    keys: tuple

    def member(self, iteration: Column | int) -> Column:
        number = iteration if isinstance(iteration, Column) else F.lit(iteration)
        digest = _digest(self.key, number)
        if isinstance(iteration, Column):
            cut = F.element_at(F.array(*[F.lit(d) for d in self.digests]).cast("array<string>"), number + 1)
            last = F.element_at(F.array(*[F.lit(k) for k in self.keys]), number + 1)
        else:
            cut, last = F.lit(self.digests[iteration]), F.lit(self.keys[iteration])
        inside = (digest < cut) | ((digest == cut) & (col(self.key) <= last))
        return F.coalesce(inside, F.lit(False))


def sample_cuts(df: DataFrame, key: str = "customer_id", n_iterations: int = 20, fraction: float = 0.8) -> SampleCuts:
    """The cuts of n_iterations samples of exact size, for all samples in two passes and without sorting all rows.

    Pass one counts rows per sample and bin of the digest space and finds, by a running sum over the bins (at most
    16**DIGEST_BINS_HEX rows per sample), the bin that holds each sample's last member. Pass two orders only the rows
    of those bins, one bin per sample, and takes the member at the remaining rank.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must lie in (0, 1]")
    n = df.where(col(key).isNotNull()).count()
    size = int(fraction * n)
    if size == 0:
        return SampleCuts(key, (None,) * n_iterations, (None,) * n_iterations)
    rows = (df.where(col(key).isNotNull())
            .select(col(key).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(n_iterations - 1))).alias("_i"))
            .withColumn("_d", F.md5(F.concat(F.col("_key").cast("string"), F.lit("-"), F.col("_i").cast("string"))))
            .withColumn("_bin", F.substring("_d", 1, DIGEST_BINS_HEX)))
    bins = rows.groupBy("_i", "_bin").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("_i").orderBy("_bin")
    found = (bins.withColumn("_upto", F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0)))
             .where((F.col("_upto") >= size) & (F.col("_upto") - F.col("_n") < size))
             .select("_i", "_bin", (F.lit(size) - (F.col("_upto") - F.col("_n"))).alias("_rank")))
    within = Window.partitionBy("_i").orderBy("_d", "_key")
    last = (rows.join(F.broadcast(found), ["_i", "_bin"]).withColumn("_at", F.row_number().over(within))
            .where(F.col("_at") == F.col("_rank")).select("_i", "_d", "_key").collect())
    at = {r["_i"]: (r["_d"], r["_key"]) for r in last}
    return SampleCuts(key, tuple(at[i][0] for i in range(n_iterations)), tuple(at[i][1] for i in range(n_iterations)))


def bootstrap_samples(df: DataFrame, key: str = "customer_id", n_iterations: int = 20,
                      fraction: float = 0.8, keep: Sequence[str] = (), cuts: SampleCuts | None = None) -> DataFrame:
    """Members of each repeated sample without replacement: ``(iteration, key, kept columns)``; see SampleCuts."""
    cuts = cuts or sample_cuts(df, key, n_iterations, fraction)
    every = F.sequence(F.lit(0), F.lit(n_iterations - 1))
    return df.select(F.explode(every).alias("iteration"), col(key), *[col(c) for c in keep]).where(
        cuts.member(F.col("iteration")))


def labelled_samples(df: DataFrame, fits: Sequence[Centers], key: str, fraction: float,
                     cuts: SampleCuts | None = None) -> DataFrame:
    """Key and its label under each sample's centres, NULL where the row is not in that sample."""
    cuts = cuts or sample_cuts(df, key, len(fits), fraction)
    found = labels_under([c.by_cluster for c in fits], [col(c) for c in fits[0].columns])
    member = F.array(*[cuts.member(i) for i in range(len(fits))])
    labels = F.zip_with("_found", "_member", lambda label, inside: F.when(inside, label))
    return df.select(col(key), found.alias("_found"), member.alias("_member")).select(key, labels.alias("labels"))


def sample_names(cuts: SampleCuts, n_iterations: int) -> Column:
    """Array of the numbers, as text, of the samples a row belongs to."""
    every = F.sequence(F.lit(0), F.lit(n_iterations - 1))
    return F.transform(F.filter(every, lambda i: cuts.member(i)), lambda i: i.cast("string"))


def bootstrap_stability(df: DataFrame, columns: Sequence[str], k: int = 4, n_iterations: int = 20,
                        fraction: float = 0.8, key: str = "customer_id", seed: int = SEED,
                        restarts: int = RESTARTS) -> DataFrame:
    """Cluster every sample and compare all pairs of samples on the rows they share."""
    cuts = sample_cuts(df, key, n_iterations, fraction)
    fits = fit_groups(df, columns, [k], sample_names(cuts, n_iterations), key, seed, restarts)
    centers = [fits[str(i), k].centers for i in range(n_iterations)]
    return pairwise_ari(labelled_samples(df, centers, key, fraction, cuts), n_iterations)


# --- calendar periods ----------------------------------------------------------------------------


def period_buckets(df: DataFrame, period: str, date_column: str = DATE_COLUMN) -> DataFrame:
    """Add the label ``period`` and its first day ``period_start``."""
    require_period(period)
    require_columns(df, [date_column])
    moment = col(date_column)
    return df.withColumn("period", period_label(moment, period)).withColumn("period_start", period_start(moment, period))


def least_customers(k: int, minimum: int | None) -> int:
    return 5 * k if minimum is None else minimum


def period_customers(dated: DataFrame, period: str, key: str = "customer_id",
                     date_column: str = DATE_COLUMN) -> DataFrame:
    """Each customer once per period in which the customer has a row."""
    return (period_buckets(dated, period, date_column).where(F.col("period").isNotNull())
            .select("period", col(key)).distinct())


def period_customer_counts(dated: DataFrame, period: str, minimum: int, key: str = "customer_id",
                           date_column: str = DATE_COLUMN) -> DataFrame:
    """Distinct customers per period and whether there are enough to cluster them."""
    return (
        period_customers(dated, period, key, date_column)
        .groupBy("period").agg(F.count("*").alias("n_customers"))
        .withColumn("is_clustered", F.col("n_customers") >= minimum)
    )


#: Stores a table under a name, such as ``ResultStore.fetch``.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


@dataclass
class PeriodData:
    """Features of each period's customers, the customer counts and the periods to cluster."""

    rows: DataFrame
    counts: DataFrame
    sizes: dict[str, int]
    kept: list[str]


def period_data(features: DataFrame, dated: DataFrame, columns: Sequence[str], period: str, minimum: int,
                key: str = "customer_id", date_column: str = DATE_COLUMN, keep: Keep | None = None) -> PeriodData:
    """Attach features to the customers of each period; customers without features are left out.

    The table is made once, before it is counted: kept by ``keep``, or else persisted.
    """
    require_columns(dated, [key, date_column])
    members = period_customers(dated, period, key, date_column)
    counts = period_customer_counts(dated, period, minimum, key, date_column)
    joined = members.join(features.select(col(key), *[col(c) for c in columns]), key)
    rows = keep(f"{period} rows", lambda: joined) if keep else joined.persist(StorageLevel.MEMORY_AND_DISK)
    with_features = {r["period"]: r["n"] for r in rows.groupBy("period").agg(F.count("*").alias("n")).collect()}
    sizes = {r["period"]: r["n_customers"] for r in counts.collect()}
    kept = sorted(p for p, n in sizes.items() if n >= minimum and with_features.get(p, 0) >= minimum)
    return PeriodData(rows, counts, sizes, kept)


def fit_periods(data: PeriodData, columns: Sequence[str], k: int, seed: int = SEED, restarts: int = RESTARTS,
                key: str = "customer_id") -> GroupedCenters:
    """One k-means model per kept period; every step of all periods and restarts is one pass over the table."""
    rows = data.rows.where(F.col("period").isin(data.kept))
    fits = fit_groups(rows, columns, [k], F.array("period"), key, seed, restarts)
    return GroupedCenters(columns, {p: fits[p, k].centers for p in data.kept}, "period")


def _consecutive(labels: DataFrame, kept: Sequence[str], key: str) -> DataFrame:
    """Customers present in a period and in the next kept one, with both labels.

    The join is on customer and period position, so no pair of unrelated periods is formed.
    """
    schema = pa.schema([("period", pa.string()), ("position", pa.int32())])
    order = small_table(labels.sparkSession, [{"period": p, "position": i} for i, p in enumerate(kept)], schema)
    placed = labels.join(order, "period")
    first = placed.select(col(key), "position", F.col("period").alias("from_period"), F.col("cluster").alias("a"))
    second = placed.select(col(key), (F.col("position") - 1).alias("position"),
                           F.col("period").alias("to_period"), F.col("cluster").alias("b"))
    return first.join(second, [key, "position"])


def transition_cells(labels: DataFrame, kept: Sequence[str], key: str = "customer_id") -> DataFrame:
    """Customers per pair of consecutive periods and pair of clusters."""
    return _consecutive(labels, kept, key).groupBy("from_period", "to_period", "a", "b").agg(F.count("*").alias("n"))


def consecutive_ari(cells: DataFrame, minimum: int) -> DataFrame:
    return ari_table(cells, ["from_period", "to_period"]).where(F.col("n_common") >= minimum)


def migration_matrices(cells: DataFrame, k: int, least_common: int = LEAST_COMMON) -> DataFrame:
    """Row percentages of moves between clusters of consecutive periods, all k × k cells.

    A cluster nobody came from has a row of zeros.
    """
    periods = ["from_period", "to_period"]
    # Everything below runs on at most k² cells per pair of periods.
    totals = cells.groupBy(*periods).agg(F.sum("n").alias("n_common")).where(F.col("n_common") >= least_common)
    ids = F.sequence(F.lit(0), F.lit(k - 1))
    grid = totals.select(*periods, F.explode(ids).alias("a")).select("*", F.explode(ids).alias("b"))
    from_totals = cells.groupBy(*periods, "a").agg(F.sum("n").alias("n_from"))
    share = F.coalesce(F.try_divide(F.col("n") * 100.0, F.col("n_from")), F.lit(0.0))
    return (
        grid.join(cells, [*periods, "a", "b"], "left").join(from_totals, [*periods, "a"], "left")
        .select(*periods, F.col("a").alias("from_cluster"), F.col("b").alias("to_cluster"),
                F.coalesce("n", F.lit(0).cast("bigint")).alias("n_customers"), share.alias("percentage"))
    )


@dataclass
class StabilityResult:
    """Scores per pair of periods, customer counts and, where they apply, migration or an error."""

    counts: DataFrame
    scores: DataFrame | None = None
    migration: DataFrame | None = None
    largest_period: str | None = None
    error: str | None = None

    def summary(self) -> DataFrame | None:
        return None if self.scores is None else ari_summary(self.scores)


def temporal_stability(features: DataFrame, dated: DataFrame | None, columns: Sequence[str], k: int = 4,
                       period: str = "quarter", minimum: int | None = None, key: str = "customer_id",
                       seed: int = SEED, restarts: int = RESTARTS, keep: Keep | None = None) -> StabilityResult:
    """Cluster every period on its own and compare consecutive periods on shared customers.

    The period rows are kept by ``keep``, or else persisted.
    """
    if dated is None:
        raise ValueError("a frame with dates is needed for stability over time")
    require_period(period)
    minimum = least_customers(k, minimum)
    data = period_data(features, dated, columns, period, minimum, key, keep=keep)
    if not data.kept:
        return StabilityResult(data.counts, error="No periods had sufficient customers for modeling")
    labels = fit_periods(data, columns, k, seed, restarts, key).assign(data.rows, ["period", key])
    cells = transition_cells(labels, data.kept, key)
    return StabilityResult(data.counts, consecutive_ari(cells, minimum), migration_matrices(cells, k))


def evaluation_rows(data: PeriodData, columns: Sequence[str], size: int | None = None,
                    key: str = "customer_id") -> tuple[str, DataFrame]:
    """Largest kept period (the earliest on a tie) and its customers; a fixed random sample of them if size is given."""
    largest = min(data.kept, key=lambda p: (-data.sizes[p], p))
    rows = data.rows.where(F.col("period") == largest)
    if size is not None:
        rows = rows.orderBy(hashed_order(key, "eval"), key).limit(size)
    return largest, rows.select(col(key), *[col(c) for c in columns])


def cross_period_scores(sample: DataFrame, models: Mapping[str, Centers], key: str = "customer_id") -> DataFrame:
    """Agreement of every two periods' models on one evaluation sample."""
    periods = sorted(models)
    labels = labels_under([models[p].by_cluster for p in periods], [col(c) for c in models[periods[0]].columns])
    names = F.array(*[F.lit(p) for p in periods])
    return pairwise_ari(sample.select(col(key), labels.alias("labels")), len(periods), 0).select(
        names[F.col("i")].alias("period_a"), names[F.col("j")].alias("period_b"), "n_common", "ari")


def cross_period_stability(features: DataFrame, dated: DataFrame | None, columns: Sequence[str], k: int = 4,
                           period: str = "year", sample_size: int | None = None, minimum: int | None = None,
                           key: str = "customer_id", seed: int = SEED, restarts: int = RESTARTS,
                           keep: Keep | None = None) -> StabilityResult:
    """A model per period; all label the same customers, so periods need not share any.

    All customers of the largest period are labelled, or a fixed random sample if sample_size is given.
    """
    if dated is None:
        raise ValueError("a frame with dates is needed for stability over time")
    require_period(period)
    data = period_data(features, dated, columns, period, least_customers(k, minimum), key, keep=keep)
    if not data.kept:
        return StabilityResult(data.counts, error="No periods had sufficient customers for modeling")
    models = fit_periods(data, columns, k, seed, restarts, key).by_group
    largest, sample = evaluation_rows(data, columns, sample_size, key)
    return StabilityResult(data.counts, cross_period_scores(sample, models, key), largest_period=largest)
