"""Helpers shared by the corpus operators: intermediate tables and row keys."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only a local session that has none
    (as in tests) gets a temporary folder of its own; a cluster without one is an error.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="vespera-")
    return _FALLBACK[app]


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver exits."""
    path = f"{shared_dir(spark)}/vespera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_quiet_remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone by then, and the folder with it
        pass


class Kept:
    """A table written to the shared folder: it cuts the lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, partition_by: Iterable[str] = ()):
        self.spark = df.sparkSession
        self.path = new_dir(self.spark, name)
        writer = df.write.option("compression", "zstd")
        if partition_by := list(partition_by):
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def keep(df: DataFrame, name: str) -> DataFrame:
    return Kept(df, name).df


#: Keys that are broadcast (8 bytes each, and as much again for the table); more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """A written table of narrow keys, to be broadcast if there are few enough of them."""
    return F.broadcast(df) if df.count() <= limit else df


def text_key(text: Column) -> Column:
    """Two independent hashes of a text; with the row's id they name a row whose text is read twice."""
    return F.concat_ws("-", F.hex(F.xxhash64(text)), F.md5(text.cast("binary")))


def fit_name(df: DataFrame, name: str) -> str:
    """A column name that does not occur in df (extra columns may clash with ours)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name
