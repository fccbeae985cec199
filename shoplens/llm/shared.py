"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words: space and the control characters tab to carriage return.
BLANKS = " \t\n\x0b\f\r"
#: One word between such white space, for Java and for Python patterns alike.
WORD = "[^\\x20\\x09-\\x0D]+"
#: A run of such white space.
GAP = "[\\x20\\x09-\\x0D]+"


def _prepared(spark: SparkSession):
    """The context with its checkpoint folder: spark.checkpoint.dir, which all executors share.

    Only where that is unset and the master is local (tests, one machine) a temporary folder is taken; on a cluster
    a missing setting raises, since executors do not share machine-local folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="shoplens-")
        context.setCheckpointDir(shared)
    return context


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder of spark.checkpoint.dir, so that lost executors cost no recomputation.

    Only where the setting is absent and the master is local (tests, a single machine) a temporary folder is taken.
    """
    _prepared(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) fixed by the keys' text: 52 bits of their md5."""
    digits = F.substring(F.md5(F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def unused_prefix(df: DataFrame, start: str = "_own_") -> str:
    """A prefix that no column of df has, for columns that are added for a while."""
    while any(c.lower().startswith(start) for c in df.columns):
        start = "_" + start
    return start


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a small side, of a few short columns, that may be broadcast: some megabytes.
BROADCAST_ROWS = 50_000


def attach(rows: DataFrame, small: DataFrame, key: str, small_key: str, spread_by: str) -> DataFrame:
    """Left join of rows with a stored table of one row per key, null equal to null, safe against hot keys.

    The table is counted. Up to BROADCAST_ROWS it is broadcast; beyond, each of its rows is repeated once per salt and
    rows of a hot key are dealt out by salt, taken from the column spread_by.
    """
    same = F.col(key).eqNullSafe(F.col(small_key))
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), same, "left")
    salts, salt = shuffle_partitions(rows.sparkSession), unused_prefix(rows, "_salt_")
    salted = small.withColumn(f"{salt}of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (rows.withColumn(f"{salt}at", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
            .join(salted, same & (F.col(f"{salt}at") == F.col(f"{salt}of")), "left").drop(f"{salt}at", f"{salt}of"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one of spark.checkpoint.dir."""
    return f"{_prepared(spark).getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
