"""A collection of documents (id, vector, attributes): write, query, compact, stats, drop.

Writes append a batch to the log. ``compact`` writes a snapshot, sorted by id, with one typed cell for each attribute, the
vector's squared norm and its int8 codes. A query scans the snapshot, with the filter pushed into the Parquet scan,
leaves out the ids that the log's tail replaces, and adds the folded tail; the snapshot's vectors are never
shuffled. With ``shards`` rows are laid out by the hash of their id, and each shard gives its own nearest.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType
from pyspark.sql.types import BooleanType, DoubleType

from vespera.functions import vectors as V
from vespera.functions.sharding import shard
from vespera.operators import fold
from vespera.plans.filters import compile_cells, compile_tagged
from vespera.sources.ingest import BatchError, check_names, validate
from vespera.sources.store import Store

_CELL = StructType([StructField("b", BooleanType()), StructField("i", LongType()), StructField("f", DoubleType()), StructField("s", StringType())])
_ENTRY = StructType([StructField("ord", IntegerType()), StructField("op", StringType()), StructField("id", LongType()), StructField("vector", ArrayType(FloatType())), StructField("attrs", MapType(StringType(), _CELL))])
WRITE_KEYS = ("upsert_columns", "upsert_rows", "deletes", "delete_by_filter")


class NotFound(LookupError):
    """A query of a collection that nothing has been written to."""


def _cell(value: Any) -> tuple | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return value, None, None, None
    if isinstance(value, int):
        return (None, value, None, None) if -(1 << 63) <= value < 1 << 63 else (None, None, float(value), None)
    if isinstance(value, float):
        return None, None, value, None
    if isinstance(value, str):
        return None, None, None, value
    raise BatchError(f"an attribute is null, a boolean, a number or text, not {value!r}")


def _row(row: Mapping[str, Any]) -> tuple[int, list[float], dict[str, tuple | None]]:
    try:
        doc_id, vector = row["id"], row["vector"]
    except (KeyError, TypeError):
        raise BatchError("a row has an id and a vector") from None
    if isinstance(doc_id, bool) or not isinstance(doc_id, int) or not 0 <= doc_id < 1 << 63:
        raise BatchError(f"not a document id: {doc_id!r}")
    if not isinstance(vector, (list, tuple)) or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in vector):
        raise BatchError("a vector is a list of numbers")
    attrs = {k: _cell(v) for k, v in row.items() if k not in ("id", "vector")}
    check_names(list(attrs))
    return doc_id, [float(x) for x in vector], attrs


def rows_of(upsert_columns: Mapping[str, Sequence] | None, upsert_rows: Sequence[Mapping] | None) -> list[tuple]:
    """Both batch forms as rows; columns come first."""
    rows: list[Mapping] = []
    if upsert_columns is not None:
        if len({len(c) for c in upsert_columns.values()}) > 1 or not {"id", "vector"} <= set(upsert_columns):
            raise BatchError("columns need id and vector and must be of one length")
        rows += [dict(zip(upsert_columns, cells)) for cells in zip(*upsert_columns.values())]
    return [_row(r) for r in [*rows, *(upsert_rows or ())]]


CELL = "struct<b: boolean, i: bigint, f: double, s: string>"
#: Ids of the tail that a broadcast join may take (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


@dataclass
class Facts:
    """What the rows of a collection say of it."""

    dim: int = 0
    metric: str | None = None
    attrs: tuple[str, ...] = ()


def _measured(rows: DataFrame) -> DataFrame:
    """Rows with the columns that a search wants: squared norm, int8 codes and their scale."""
    v = F.col("vector")
    return rows.withColumns({"norm2": V.dot(v, v), "codes": V.int8_codes(v).cast("array<tinyint>"), "scale": V.int8_scale(v)})


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, shards: int = 1):
        self.spark, self.store, self.name, self.shards = spark, Store(spark, root, name), name, max(1, shards)

    def _laid_out(self, rows: DataFrame) -> tuple[DataFrame, list[str]]:
        """Rows by shard, the way they are written."""
        if self.shards == 1:
            return rows, []
        return rows.withColumn("shard", shard(self.name, F.col("id"), self.shards)), ["shard"]

    def facts(self) -> Facts:
        upto, snap = self.store.snapshot()
        tail = self.store.log(upto)
        out = Facts()
        if snap is not None:
            out.attrs = tuple(f.name for f in snap.schema["attributes"].dataType.fields if f.name != "$")
            if row := snap.where("op = 'upsert'").select(F.size("vector"), "metric").first():
                out.dim, out.metric = row
        if tail is not None:
            if not out.dim and (row := tail.where("op = 'upsert'").select(F.size("vector"), "metric").first()):
                out.dim, out.metric = row
            out.metric = out.metric or tail.agg(F.max("metric")).first()[0]
            keys = tail.select("seq", "ord", F.explode(F.map_keys("attrs")).alias("k")).groupBy("k").agg(F.min(F.struct("seq", "ord")).alias("at"))
            out.attrs = tuple(dict.fromkeys([*out.attrs, *(r["k"] for r in keys.orderBy("at", "k").collect())]))
        return out

    def _parts(self, names: Sequence[str]) -> list[DataFrame]:
        """The live documents: rows of the snapshot that still hold, and the tail's; one or both.

        Columns: id, op, seq, ord, vector, metric, attributes (a struct of cells), and what :func:`_measured` adds.
        """
        upto, snap = self.store.snapshot()
        log = self.store.log(upto)

        def shaped(rows: DataFrame, attributes: Column) -> DataFrame:
            return rows.withColumn("attributes", attributes).select("id", "op", "seq", "ord", "vector", "metric", "attributes", "norm2", "codes", "scale")

        empty = F.lit(True).alias("$")  # a struct has a field at least; no attribute is named like this
        tail = None
        if log is not None:
            last = fold.last_entries(log.select("id", "op", "seq", "ord", "vector", "metric", "attrs"))
            tail = shaped(_measured(last), F.struct(empty, *[F.element_at("attrs", n).alias(n) for n in names]))
        if snap is None:
            return [] if tail is None else [tail]
        have = {f.name for f in snap.schema["attributes"].dataType.fields}
        base = shaped(snap, F.struct(empty, *[(F.col("attributes")[n] if n in have else F.lit(None).cast(CELL)).alias(n) for n in names]))
        if tail is None:
            return [base]
        bounds = log.agg(F.min("seq").alias("first"), F.count("*").alias("n")).first()
        in_order = bounds["first"] is None or bounds["first"] > (snap.agg(F.max("seq")).first()[0] or -1)
        return list(fold.overlay(base, F.broadcast(tail) if bounds["n"] <= BROADCAST_IDS else tail, in_order))

    def documents(self) -> DataFrame:
        """(id, vector, attributes) of the live documents."""
        if not self.store.exists():
            raise NotFound(self.store.path)
        parts = [p.where("op = 'upsert'").select("id", "vector", "attributes") for p in self._parts(self.facts().attrs)]
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])

    def write(self, upsert_columns: Mapping[str, Sequence] | None = None, upsert_rows: Sequence[Mapping] | None = None, deletes: Sequence[int] | None = None, delete_by_filter: Any = None, distance_metric: str | None = None) -> int:
        """Apply one batch: deletes by filter (of the state before it), upserts, deletes. All or nothing."""
        if all(x is None for x in (upsert_columns, upsert_rows, deletes, delete_by_filter)):
            raise BatchError(f"a batch has at least one of {', '.join(WRITE_KEYS)}")
        rows = rows_of(upsert_columns, upsert_rows)
        for d in deletes or ():
            if isinstance(d, bool) or not isinstance(d, int) or d < 0:
                raise BatchError(f"not a document id: {d!r}")
        table = self.spark.createDataFrame([(i, "upsert", *r) for i, r in enumerate(rows)], _ENTRY)
        gone = self.spark.createDataFrame([(int(d),) for d in deletes], "id long") if deletes else None
        return self._apply(table, distance_metric, gone, delete_by_filter)

    def write_tables(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, delete_by_filter: Any = None, distance_metric: str | None = None) -> int:
        """The same for tables that do not fit the driver: upserts (id, vector, attrs) with distinct ids, and ids to delete."""
        rows = self.spark.createDataFrame([], _ENTRY)
        if upserts is not None:
            rows = upserts.select(F.lit(0).alias("ord"), F.lit("upsert").alias("op"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), "attrs")
            check_names([r["k"] for r in rows.select(F.explode(F.map_keys("attrs")).alias("k")).distinct().collect()])
        gone = None if deletes is None else deletes.select(F.col(deletes.columns[0]).cast("long").alias("id"))
        return self._apply(rows, distance_metric, gone, delete_by_filter)

    def _apply(self, upserts: DataFrame, metric: str | None, deletes: DataFrame | None, by_filter: Any) -> int:
        facts = self.facts()
        if metric is not None and metric not in V.METRICS:
            raise BatchError(f"unknown metric {metric!r}")
        if metric and facts.metric and metric != facts.metric:
            raise BatchError(f"the collection's metric is {facts.metric}")
        metric = facts.metric or metric or V.METRICS[0]
        validate(upserts, facts.dim or None, metric)
        parts = [upserts]
        if by_filter is not None:
            compile_tagged(by_filter, F.col("attrs"), F.col("id"))  # refuses a bad filter, whatever is stored
            if self.store.exists():
                parts.append(self._where(by_filter, facts).select(F.lit(-1).alias("ord"), F.lit("delete").alias("op"), "id"))
        if deletes is not None:
            parts.append(deletes.select(F.lit((1 << 31) - 1).alias("ord"), F.lit("delete").alias("op"), "id"))
        entries = self.spark.createDataFrame([], _ENTRY)
        for p in parts:
            entries = entries.unionByName(p, allowMissingColumns=True)
        number = self.store.next_batch()
        self.append(entries.withColumn("seq", F.lit(number).cast("long")), number, metric)
        return number

    def append(self, entries: DataFrame, number: int, metric: str, replace: bool = False) -> None:
        """Add a batch of log entries, whose seq and ord say when they count, in one commit."""
        rows, by = self._laid_out(entries.select("seq", "ord", "op", "id", "vector", "attrs").withColumn("metric", F.lit(metric)))
        self.store.append(rows, number, by, replace)

    def _where(self, filters: Any, facts: Facts) -> DataFrame:
        """(id, vector, norm2, codes, scale, attributes) of the live documents that pass a filter, filtered in the scans."""
        out = None
        for part in self._parts(facts.attrs):
            part = part.where("op = 'upsert'")
            if filters is not None:
                part = part.where(compile_cells(filters, F.col("attributes"), facts.attrs, F.col("id")))
            part = part.select("id", "vector", "norm2", "codes", "scale", "attributes")
            out = part if out is None else out.union(part)
        return out

    def query(self, vector: Sequence[float], top_k: int = 10, filters: Any = None, include_attributes: bool | Sequence[str] | None = None, ef: int | None = None, rerank: int | None = None) -> DataFrame:
        """(id, distance, attributes): the nearest live documents; attributes are cells by name.

        Exact, unless ``ef`` or ``rerank`` is given: then the best max(ef, k * rerank, 64) by int8 codes, read without the
        vectors, are ranked by exact distances.
        """
        if not self.store.exists():
            raise NotFound(self.store.path)
        facts, k = self.facts(), max(1, top_k)
        if facts.dim and len(vector) != facts.dim:
            raise BatchError(f"the query has {len(vector)} dimensions, the collection {facts.dim}")
        metric, q = facts.metric or V.METRICS[0], V.literal(vector)
        docs = self._where(filters, facts)
        if ef is not None or rerank is not None:
            rough = V.int8_distance(metric, F.col("codes"), F.col("scale"), F.col("norm2"), V.int8_codes(q), V.int8_scale(q), V.dot(q, q))
            pool = docs.select("id", rough.alias("rough")).orderBy("rough", "id").limit(max(ef or 0, k * max(rerank or 1, 1), 64))
            docs = docs.where(F.col("id").isin([r["id"] for r in pool.collect()]))  # as many ids as the pool has
        near = docs.select("id", V.distance_from(metric, F.col("vector"), F.col("norm2"), q).alias("distance"), "attributes")
        if self.shards > 1:
            own = Window.partitionBy(shard(self.name, F.col("id"), self.shards)).orderBy("distance", "id")
            near = near.withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= k).drop("_rn")
        near = near.orderBy("distance", "id").limit(k)
        if not include_attributes:
            return near.drop("attributes")
        names = [a for a in facts.attrs if include_attributes is True or a in include_attributes]
        return near.select("id", "distance", *[F.col("attributes")[n].alias(n) for n in names])

    def query_rows(self, *args: Any, **kwargs: Any) -> list[dict]:
        """A query's rows as plain records, null attributes left out."""
        out = []
        for r in self.query(*args, **kwargs).collect():
            rec = {"id": r["id"], "$distance": r["distance"]}
            for n in r.__fields__[2:]:
                value = next((x for x in r[n] or () if x is not None), None)
                if value is not None:
                    rec[n] = value
            out.append(rec)
        return out

    def stats(self) -> dict:
        facts = self.facts() if self.store.exists() else None
        if facts is None:
            raise NotFound(self.store.path)
        return {"namespace": self.name, "dim": facts.dim, "count": self._where(None, facts).count(), "metric": facts.metric or V.METRICS[0]}

    def compact(self) -> int:
        """Write a snapshot of the last entry of every id; returns the batch up to which it reaches."""
        if not self.store.exists():
            raise NotFound(self.store.path)
        number, upto = self.store.next_batch() - 1, self.store.snapshot()[0]
        if number > upto:
            parts = self._parts(self.facts().attrs)
            rows, by = self._laid_out(parts[0] if len(parts) == 1 else parts[0].union(parts[1]))
            self.store.write_snapshot(rows.repartitionByRange(*by, "id").sortWithinPartitions(*by, "id"), number, by)
        return number

    def drop(self) -> None:
        """Remove the collection and its files; a missing one is no error."""
        self.store.drop()
