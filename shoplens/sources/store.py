"""Keyed store of results: made once, read by every later use.

With a shared folder (the cluster's ``spark.checkpoint.dir``, or one that is given) a result is a parquet table there, so
that lost executors do not lose it. Without one it is persisted in executor storage, and lost blocks are computed again.
Nothing is written to a folder of a single machine. Results are remembered by key either way and released by ``clear``.
"""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def result_name(key: str, **parameters) -> str:
    """Name of a result: a digest of its key and of everything that it depends on."""
    text = json.dumps([key, sorted((k, repr(v)) for k, v in parameters.items())])
    return hashlib.sha256(text.encode()).hexdigest()


class ResultStore:
    """Fetch and clear results by key and parameters. A failing write or read warns and is not fatal."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        base = folder or spark.conf.get("spark.checkpoint.dir", None)
        self.root = f"{base.rstrip('/')}/shoplens-{spark.sparkContext.applicationId}" if base else None
        self.frames: dict[str, DataFrame] = {}
        if self.root:
            fs, path = self._locate(self.root)
            fs.deleteOnExit(path)

    def path(self, key: str, **parameters) -> str:
        return f"{self.root}/{result_name(key, **parameters)}"

    def load(self, key: str, **parameters) -> DataFrame | None:
        """The stored result, or None. A write that did not finish is not taken for a result."""
        name = result_name(key, **parameters)
        if name in self.frames or self.root is None:
            return self.frames.get(name)
        where = self.path(key, **parameters)
        try:
            fs, marker = self._locate(where + "/_SUCCESS")
            if fs.exists(marker):
                self.frames[name] = self.spark.read.parquet(where)
        except Exception as error:
            warnings.warn(f"result {key!r} was not read: {error}", stacklevel=2)
        return self.frames.get(name)

    def fetch(self, key: str, build: Callable[[], DataFrame], **parameters) -> DataFrame:
        """Stored result for the key and the parameters it depends on; made and stored first if it is absent."""
        found = self.load(key, **parameters)
        if found is not None:
            return found
        df = build()
        if self.root is None:
            self.frames[result_name(key, **parameters)] = df.persist(StorageLevel.MEMORY_AND_DISK)
            return df
        try:
            df.write.mode("overwrite").parquet(self.path(key, **parameters))
        except Exception as error:
            warnings.warn(f"result {key!r} was not stored: {error}", stacklevel=2)
            return df
        found = self.load(key, **parameters)
        return df if found is None else found

    def clear(self) -> None:
        """Release every stored result."""
        for df in self.frames.values():
            df.unpersist()
        self.frames.clear()
        if self.root:
            fs, path = self._locate(self.root)
            fs.delete(path, True)

    def _locate(self, location: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(location)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path
