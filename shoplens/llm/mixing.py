"""Mixing sources to target weights by Pareto order sampling.

A source's target, in words, divided by its size says how often each of its documents is expected. The
whole part is certain: that many copies of every document. The rest is a probability f, and the extra
copies are a fixed-size sample drawn in order: each document gets a uniform number u, fixed by its id,
and the rank [u / (1 - u)] / [w f / (1 - f)] (w: the document's own weight on its odds, 1 by default).
The documents of smallest rank are taken until the missing words are reached as nearly as whole
documents allow.

A source may hold most of the corpus, so its ranks are never sorted in one task: ranks are counted into
bins, the bin in which the missing words are reached is found from the counts, and only its documents are
looked at more closely (twice). What is ordered at last is about a millionth of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.shared import WORD, attach, checkpointed, uniform, unused_prefix, whole_text

#: Bins per level, a power of two; there are two levels.
BINS = 1024


def words_in(text_col: str = "text") -> Column:
    """Number of words between white space; 0 for null."""
    return F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target from rows (source, size).

    Sources in order of code points, null last, weigh by the repeating list. Together the targets are `share`
    of all words. No target exceeds `most` times its source's size: what is above is shared out again by weight
    among the others, until none is above. That fixpoint is found in one pass: with sources ordered by
    most * size / weight, the sources before some place are capped and all after it get the same words per weight.
    The list of sources is configuration: it is small enough to be ordered in one task.
    """
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    capped = (listed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
              .withColumn("cap", F.col("source_size") * F.lit(float(most)))
              .withColumn("level", F.col("cap") / F.col("weight")))
    steps = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = steps.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rate = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rated = (capped.withColumn("nth", F.row_number().over(steps))
             .withColumn("rate", rate / F.sum("weight").over(steps.rowsBetween(0, Window.unboundedFollowing))))
    first = F.min_by(F.when(F.col("level") >= F.col("rate"), F.col("rate")),
                     F.when(F.col("level") >= F.col("rate"), F.col("nth"))).over(whole)
    return (rated.withColumn("first", first)
            .select("source", "source_size", "weight",
                    F.coalesce(F.least("cap", F.col("weight") * F.col("first")), F.col("cap")).alias("target")))


def _edge(rows: DataFrame, bin_col: str) -> DataFrame:
    """Per source the first bin (edge) that goes beyond the missing words, and the words before it."""
    totals = rows.groupBy("source", bin_col).agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(bin_col))
    return (totals.withColumn("upto", upto).where("upto > missing").groupBy(F.col("source").alias("edge_source"))
            .agg(F.min(bin_col).alias(f"edge_{bin_col}"),
                 F.min_by(F.col("upto") - F.col("words"), bin_col).alias("before")))


def _same_source(other: str) -> Column:
    return F.col("source").eqNullSafe(F.col(other))


def _position(u: Column, part: Column, weight: Column) -> Column:
    """Pareto rank mapped to (0, 1) without changing the order."""
    rank = F.try_divide(u / (1 - u), weight * (part / (1 - part)))
    return rank / (1 + rank)


def source_plan(rows: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: its targets, the certain copies (whole) and where the order sample ends.

    rows: source, size, u, odds. A document belongs to the sample if its position is in a bin before edge_bin, or
    in it and not above last_position.
    """
    targets = checkpointed(
        source_targets(rows, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("part", F.when(F.col("source_size") > 0, F.col("missing") / F.col("source_size")).otherwise(0.0)))
    wanted = targets.where("part > 0").select(F.col("source").alias("of"), "missing", "part")
    placed = (attach(rows, wanted, "source", "of", "u").where("part is not null").select(
        "source", "size", "missing", _position(F.col("u"), F.col("part"), F.col("odds")).alias("position"))
        .withColumn("fine", F.floor(F.col("position") * (BINS * BINS)))
        .withColumn("coarse", F.floor(F.col("fine") / BINS)))
    first = _edge(placed, "coarse")
    first = checkpointed(first)
    inside = (attach(placed, first, "source", "edge_source", "position").where("coarse = edge_coarse")
              .withColumn("missing", F.col("missing") - F.col("before"))
              .select("source", "size", "missing", "position", "fine"))
    second = _edge(inside, "fine")
    last = inside.join(second, _same_source("edge_source") & (F.col("fine") == F.col("edge_fine")))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("position"))
    alike = F.sum("size").over(Window.partitionBy("source", "position"))
    ends = (last.withColumn("taken", upto - alike / 2 <= F.col("missing") - F.col("before"))
            .groupBy(F.col("source").alias("edge_source"))
            .agg(F.first("edge_fine").alias("edge_bin"),
                 F.max(F.when(F.col("taken"), F.col("position"))).alias("last_position")))
    return (targets.join(ends, _same_source("edge_source"), "left")
            .select(F.col("source").alias("of"), "source_size", "weight", "target", "whole", "part", "edge_bin",
                    "last_position"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, odds_col: str | None = None,
        seed: int = 42) -> DataFrame:
    """The documents with size, source_size, target, copies and taken (words of all copies).

    Columns of these names are replaced. odds_col: positive weights on the documents' inclusion odds. Sizes are
    words between white space. A null source is a source of its own, after all others; a null text has size 0; a
    null id has a fixed random number. Rows that repeat an id have equal ranks and share one fate, so they may
    miss the target by their joint size. A source without words gets its certain copies only: none. An empty
    table stays empty. most must be a whole number, so that no document is taken more often than that.
    """
    names = ["size", "source_size", "target", "copies", "taken"]
    plain = docs.drop(*names)
    own = unused_prefix(plain)
    u, odds = F.col(f"{own}u"), F.col(f"{own}odds")
    drawn = (plain.withColumn(f"{own}size", words_in(text_col)).withColumn(f"{own}u", uniform(F.lit(seed), F.col(id_col)))
             .withColumn(f"{own}odds", F.col(odds_col).cast("double") if odds_col else F.lit(1.0)))
    rows = checkpointed(drawn.select(F.col(source_col).alias("source"), F.col(f"{own}size").alias("size"), u.alias("u"),
                                     odds.alias("odds")))
    found = checkpointed(source_plan(rows, weights, share, most))
    plan = found.select(*[F.col(c).alias(f"{own}{c}") for c in found.columns])
    part, edge = F.col(f"{own}part"), F.col(f"{own}edge_bin")
    position = _position(u, part, odds)
    fine = F.floor(position * (BINS * BINS))
    sampled = (part > 0) & (edge.isNull() | (fine < edge) | (
        (fine == edge) & (position <= F.coalesce(F.col(f"{own}last_position"), F.lit(-1.0)))))
    copies = (F.col(f"{own}whole") + F.when(sampled, 1).otherwise(0)).cast("int")
    mixed = attach(drawn, plan, source_col, f"{own}of", f"{own}u").withColumn(f"{own}copies", copies)
    return mixed.select(*plain.columns, F.col(f"{own}size").alias("size"), F.col(f"{own}source_size").alias("source_size"),
                        F.col(f"{own}target").alias("target"), F.col(f"{own}copies").alias("copies"),
                        (F.col(f"{own}copies") * F.col(f"{own}size")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             odds_col: str | None = None, **settings) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, with the columns of docs only."""
    needed = dict.fromkeys(c for c in (id_col, source_col, text_col, odds_col) if c)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"),
                        *[F.col(f"`{c}`").alias(f"in_{c}") for c in needed])
    mixed = mix(whole, f"in_{id_col}", f"in_{source_col}", f"in_{text_col}",
                odds_col=f"in_{odds_col}" if odds_col else None, **settings)
    return (mixed.where("copies > 0")
            .select("_own", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_nth")).select("_own.*"))
