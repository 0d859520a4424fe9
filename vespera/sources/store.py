"""A collection's tables: appended Parquet batches of the write log, and snapshots of all documents.

    <root>/<name>/log/batch=<n>/       one write
    <root>/<name>/snapshot/upto=<n>/   the last entry of every id as of batch n, with typed attributes

Nothing else is stored: dimension, metric and attribute names are read from the rows. A batch or snapshot is there once
Spark has committed it (``_SUCCESS``); the newest committed snapshot and the batches after it are the collection. One
writer at a time is assumed; a batch number that is taken is an error.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from vespera.operators.fold import LOG_SCHEMA


class BadName(ValueError):
    """Not a collection name."""


class Unavailable(RuntimeError):
    """A collection whose files cannot be read whole; it is refused, never answered in part."""


def check_name(name: str) -> str:
    """A name is one path segment of plain characters."""
    if not re.fullmatch(r"[A-Za-z0-9._-]{1,128}", name) or not name.strip("."):
        raise BadName(f"not a collection name: {name!r}")
    return name


def work_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors share, below ``spark.checkpoint.dir``; removed at exit."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{named.rstrip('/')}/work-{uuid.uuid4().hex}" if named else "file://" + tempfile.mkdtemp(prefix="vespera-work-")
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then
        pass


class Store:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{check_name(name)}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, sub: str) -> list[int]:
        at = self._path(f"{self.path}/{sub}")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n.partition("=")[2]) for n in names if re.fullmatch(r"[a-z]+=[0-9]+", n))

    def _whole(self, folder: str) -> bool:
        return self.fs.exists(self._path(f"{self.path}/{folder}/_SUCCESS"))

    def batches(self) -> list[int]:
        return self._numbers("log")

    def snapshots(self) -> list[int]:
        return [n for n in self._numbers("snapshot") if self._whole(f"snapshot/upto={n}")]

    def exists(self) -> bool:
        return bool(self.batches() or self._numbers("snapshot"))

    def next_batch(self) -> int:
        return max([-1, *self.batches(), *self.snapshots()]) + 1

    def append(self, entries: DataFrame, number: int, partition_by: list[str], replace: bool = False) -> None:
        entries.write.mode("overwrite" if replace else "error").partitionBy(*partition_by).parquet(f"{self.path}/log/batch={number}")

    def log(self, after: int = -1) -> DataFrame | None:
        """Entries of the batches after a number, or None; older batches are not read."""
        wanted = [n for n in self.batches() if n > after]
        if wanted != list(range(after + 1, after + 1 + len(wanted))):
            raise Unavailable(f"{self.path}: a batch of the log is missing")
        for n in wanted:
            if not self._whole(f"log/batch={n}"):
                raise Unavailable(f"{self.path}: batch {n} of the log is not complete")
        if not wanted:
            return None
        read = self.spark.read.schema(f"{LOG_SCHEMA}, metric string")
        parts = [read.parquet(f"{self.path}/log/batch={n}") for n in wanted]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def snapshot(self) -> tuple[int, DataFrame | None]:
        """The number of the newest whole snapshot, and its rows; (-1, None) without any."""
        there = self.snapshots()
        if not there:
            return -1, None
        return there[-1], self.spark.read.parquet(f"{self.path}/snapshot/upto={there[-1]}")

    def write_snapshot(self, rows: DataFrame, number: int, partition_by: list[str]) -> None:
        """Write a snapshot; once it is there, remove what it covers."""
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/snapshot/upto={number}")
        for n in self.batches():
            if n <= number:
                self.fs.delete(self._path(f"{self.path}/log/batch={n}"), True)
        for n in self._numbers("snapshot"):
            if n < number:
                self.fs.delete(self._path(f"{self.path}/snapshot/upto={n}"), True)

    def drop(self) -> None:
        self.fs.delete(self._path(self.path), True)
