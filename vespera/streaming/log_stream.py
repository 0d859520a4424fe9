"""The write log as a stream: segments that arrive in a folder are applied to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vespera.collection import Collection
from vespera.functions.vectors import METRICS
from vespera.operators.fold import LOG_SCHEMA, fold, last_entries
from vespera.sources.ingest import BatchError, validate


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Log entries from Parquet files as they arrive."""
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_to(collection: Collection, entries: DataFrame, checkpoint: str, metric: str = METRICS[0]) -> StreamingQuery:
    """Fold each micro-batch to its last entry per id and append it in one commit, under the micro-batch's number.

    Entries keep their source's seq and ord, and the collection folds by those: segments may arrive in any order. A micro-batch
    that is repeated after a failure replaces its own commit, or is passed over once a snapshot covers it. The
    stream is the collection's only writer.
    """

    def one(batch: DataFrame, number: int) -> None:
        if number <= collection.store.snapshot()[0]:
            return
        last = last_entries(batch).persist()
        facts = collection.facts()
        if facts.metric not in (None, metric):
            raise BatchError(f"the collection's metric is {facts.metric}")
        validate(last.where("op = 'upsert'"), facts.dim or None, metric)
        collection.append(last, number, metric, replace=True)
        last.unpersist()

    return entries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, path: str) -> DataFrame:
    """The batch counterpart: the state after all segments of the folder."""
    return fold(spark.read.schema(LOG_SCHEMA).parquet(path))
