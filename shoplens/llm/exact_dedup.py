"""Exact duplicates by a tree of digest runs.

Every (document, text) pair becomes one short row: id, digests, a run number. A run is a share of the
documents. In binomial rounds, groups of `fan_in` runs are exchanged and grouped by hash into
one run each (Spark removes a sort below such an aggregate), until a single run is left; a digest that many documents share shrinks to one row per run
before it ever meets the same digest of other runs, so no task receives a large group of copies. On
every level the row keeps the identifier that wins so far and the number of rows behind it. Two rows
meet only if SHA-256, a second independent 64-bit hash and the length in bytes agree, which verifies
the identity again in each round without moving texts. The way back runs down the same tree: the
winner of a digest is handed to each run that holds it, and from there to the run's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.shared import checkpointed, shuffle_partitions, unused_prefix, whole_text

#: What must agree for two texts to be equal.
KEY = ["_digest", "_second", "_bytes"]


def _runs(df: DataFrame, fan_in: int) -> tuple[int, int]:
    """Number of runs (a power of fan_in, at least the number of shuffle partitions) and of merge rounds."""
    rounds, runs = 1, fan_in
    while runs < shuffle_partitions(df.sparkSession):
        rounds, runs = rounds + 1, runs * fan_in
    return runs, rounds


def _merged(runs: DataFrame, run: Column, winner) -> DataFrame:
    """One row per run and text, grouped by hash."""
    return (runs.withColumn("_run", run).repartition("_run", *KEY).sortWithinPartitions("_run", *KEY)
            .groupBy("_run", *KEY).agg(winner("_best").alias("_best"), F.sum("_rows").alias("_rows")))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Short rows: one per distinct pair of id and text, with the number of rows that repeat it."""
    text = whole_text(text_col)
    return (docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("_digest"),
                        F.xxhash64(text).alias("_second"), F.octet_length(text).alias("_bytes"))
            .groupBy("_id", *KEY).agg(F.count("*").alias("_rows")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                     fan_in: int = 8) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    keep: 'smallest' or 'largest', which id of equal texts stays. A null text equals the empty text. A null
    id loses against any other id; a group of null ids only is represented by null. Rows that repeat both
    id and text are one document: they give one row and count in group_size. An id with several texts gives
    one row per text. An empty table gives no row. Other columns are not read.
    """
    winner = {"smallest": F.min, "largest": F.max}[keep]
    count, rounds = _runs(docs, fan_in)
    rows = checkpointed(digest_rows(docs, id_col, text_col)
                        .withColumn("_run", F.pmod(F.xxhash64("_id"), F.lit(count)).cast("int")))
    first = (rows.groupBy("_run", *KEY).agg(winner("_id").alias("_best"), F.sum("_rows").alias("_rows")))
    merged = first
    for step in range(1, rounds + 1):
        merged = _merged(merged, F.floor(F.col("_run") / fan_in).cast("int"), winner)
    top = merged.select(*KEY, F.col("_best").alias("keep_id"), F.col("_rows").alias("group_size"))
    down = first.select("_run", *KEY).join(top, KEY)
    return (rows.join(down, ["_run", *KEY])
            .select(F.col("_id").alias(id_col), "keep_id", "group_size",
                    F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("_digest")).alias("text_sha256")))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                    fan_in: int = 8) -> DataFrame:
    """The documents that stay, with their own columns only; one row where rows repeat id and text."""
    own = unused_prefix(docs)
    stay = (duplicate_groups(docs, id_col, text_col, keep, fan_in).where("kept")
            .select(F.col(id_col).alias(f"{own}id"), F.unhex("text_sha256").alias(f"{own}digest")))
    marked = docs.withColumn(f"{own}text", F.unhex(F.sha2(whole_text(text_col), 256)))
    joined = marked.join(stay, F.col(id_col).eqNullSafe(F.col(f"{own}id"))
                         & (F.col(f"{own}text") == F.col(f"{own}digest")), "left_semi")
    # The join has dealt rows by id and digest already: this needs no further exchange.
    nth = F.row_number().over(Window.partitionBy(F.coalesce(F.col(id_col), F.lit(0)), F.col(id_col).isNull(),
                                                 f"{own}text").orderBy(f"{own}text"))
    return joined.withColumn(f"{own}nth", nth).where(F.col(f"{own}nth") == 1).select(*docs.columns)
