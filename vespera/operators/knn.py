"""Nearest-neighbour operators: exact, filtered, batched, int8 with rerank, cell-pruned, sharded.

One order everywhere: distance ascending, then id ascending. Vectors that are null, of another length than the query, not
finite, or zero under cosine have no distance and are never returned. k is at least 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vespera.functions import vectors as V
from vespera.plans.filters import compile_filter
from vespera.sources.store import work_dir

#: Queries of one pass over the corpus, at most this many numbers (8 MB of doubles).
BLOCK_NUMBERS = 1_000_000
#: Distances (8 MB) and numbers of a batch's vectors (16 MB) that a worker holds at once.
STEP_NUMBERS, PART_NUMBERS = 1_000_000, 2_000_000
#: Numbers of the vectors whose exact distances are taken together.
EXACT_NUMBERS = 250_000


def _filtered(docs: DataFrame, filters: Any, id_col: str) -> DataFrame:
    return docs if filters is None else docs.where(compile_filter(filters, docs.schema, id_col))


def _included(docs: DataFrame, include: bool | Sequence[str] | None, id_col: str, vec_col: str) -> list[str]:
    """Attributes to return: none, all, or those of the list that exist; in the table's order."""
    own = [c for c in docs.columns if c not in (id_col, vec_col)]
    if include is True:
        return own
    return [c for c in own if c in (include or ())]


def top_k(docs: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine_distance", filters: Any = None, include: bool | Sequence[str] | None = None, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Exact k nearest rows to one query: the filter goes below the top-k, attributes travel with their row."""
    keep = _included(docs, include, id_col, vec_col)
    rows = _filtered(docs, filters, id_col).select(F.col(id_col).alias("id"), V.distance(metric, F.col(vec_col), V.literal(query)).alias("distance"), *keep)
    return rows.where(V.sound(F.col("distance"))).orderBy("distance", "id").limit(max(1, k))


def to_json(result: DataFrame) -> DataFrame:
    """Each row as a JSON object with ``$distance``; null attributes are left out."""
    attrs = [c for c in result.columns if c not in ("id", "distance")]
    return result.select("id", F.to_json(F.struct("id", F.col("distance").alias("$distance"), *attrs)).alias("json"))


def int8_top_k(docs: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine_distance", rerank: int = 4, exact: bool = True, filters: Any = None, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Candidates by int8 codes, then exact distances of the best max(k * rerank, 64); or codes alone."""
    vec, q, k = F.col(vec_col), V.literal(query), max(1, k)
    rows = _filtered(docs, filters, id_col)
    coded = rows.select(F.col(id_col).alias("id"), vec.alias("v"), V.int8_codes(vec).alias("c"), V.int8_scale(vec).alias("s"), V.dot(vec, vec).alias("n"))
    coded = coded.where((F.size("v") == len(query)) & (F.lit(metric != "cosine_distance") | (F.col("n") > 0)))
    rough = coded.withColumn("rough", V.int8_distance(metric, F.col("c"), F.col("s"), F.col("n"), V.int8_codes(q), V.int8_scale(q), V.dot(q, q))).where(V.sound(F.col("n")))
    if not exact:
        return rough.select("id", F.col("rough").alias("distance")).orderBy("distance", "id").limit(k)
    pool = rough.select("id", "v", "rough").orderBy("rough", "id").limit(max(k * max(rerank, 1), 64))
    return pool.select("id", V.distance(metric, F.col("v"), q).alias("distance")).orderBy("distance", "id").limit(k)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix) of the rows that hold dim finite numbers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    x = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    fine = np.isfinite(x).all(axis=1)
    return rows[fine], x[fine]


def _near(d: np.ndarray, k: int, slack: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k smallest of each row of d; ties, and what lies within the slack, stay in."""
    if d.shape[1] <= k:
        return np.divmod(np.arange(d.size), d.shape[1])
    edge = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    return np.nonzero(d <= edge + slack)


def _in_order(terms: np.ndarray) -> np.ndarray:
    """Row sums taken from left to right, as the column functions take them."""
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def _exact(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, to the last bit those of ``V.distance``."""
    if metric == "euclidean_squared":
        return _in_order((x - q) ** 2)
    ab = _in_order(x * q)
    if metric == "dot_product":
        return -ab
    return np.maximum(0.0, 1 - ab / (np.sqrt(_in_order(x * x)) * np.sqrt(_in_order(q * q))))


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    few = max(1, PART_NUMBERS // max(1, dim))
    for batch in batches:
        for i in range(0, batch.num_rows, few):
            yield batch.slice(i, few)


def _pairs_exact(metric: str, x: np.ndarray, row: np.ndarray, q: np.ndarray, ask: np.ndarray) -> np.ndarray:
    few = max(1, EXACT_NUMBERS // max(1, q.shape[1]))
    return np.concatenate([np.zeros(0), *[_exact(metric, x[row[j : j + few]], q[ask[j : j + few]]) for j in range(0, len(row), few)]])


def _candidates(batches: Iterator[pa.RecordBatch], q: np.ndarray, qids: np.ndarray, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """For each query the rows of a part of a batch that may be among its k nearest, by one matrix product, with exact distances."""
    norm_q = (q * q).sum(axis=1)
    for batch in _parts(batches, q.shape[1]):
        at, x = _matrix(batch.column(1), q.shape[1])
        norm = (x * x).sum(axis=1)
        if metric == "cosine_distance":
            at, x, norm = at[norm > 0], x[norm > 0], norm[norm > 0]
        if not len(at):
            continue
        step = max(1, STEP_NUMBERS // len(at))
        for i in range(0, len(q), step):
            d = q[i : i + step] @ x.T
            if metric == "cosine_distance":
                d /= -np.sqrt(norm)
            elif metric == "euclidean_squared":
                d *= -2
                d += norm
            else:
                np.negative(d, out=d)
            # Room for rounding: exact distances follow.
            most = max(d.max(), -d.min())
            ask, row = _near(d, k, 1e-9 * (most + np.sqrt(norm_q[i : i + step, None] + 1) * (1 + norm.max())))
            exact = _pairs_exact(metric, x, row, q, ask + i)
            yield pa.record_batch([pa.array(qids[ask + i]), batch.column(0).take(pa.array(at[row])), pa.array(exact)], ["qid", "id", "distance"])


def _rough(batches: Iterator[pa.RecordBatch], q: np.ndarray, q_scale: np.ndarray, q_norm: np.ndarray, q_full: np.ndarray, qids: np.ndarray, pool: int, metric: str) -> Iterator[pa.RecordBatch]:
    """For each query the rows (id, v, codes, scale, squared norm) of a part of a batch that may be among its best by codes, with exact distances."""
    for batch in _parts(batches, q.shape[1]):
        at, x = _matrix(batch.column(2), q.shape[1])
        if not len(at):
            continue
        full = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)
        scale, norm = (batch.column(c).to_numpy(zero_copy_only=False)[at] for c in (3, 4))
        step = max(1, STEP_NUMBERS // len(at))
        for i in range(0, len(q), step):
            d = q[i : i + step] @ x.T
            d *= scale
            d *= q_scale[i : i + step, None]
            if metric == "cosine_distance":
                d /= np.sqrt(norm * q_norm[i : i + step, None])
                np.maximum(0, np.subtract(1, d, out=d), out=d)
            elif metric == "euclidean_squared":
                d *= 2
                d = np.maximum(0, norm + q_norm[i : i + step, None] - d)
            else:
                np.negative(d, out=d)
            ask, row = _near(d, pool, 0.0)
            exact = _pairs_exact(metric, full, row, q_full, ask + i)
            yield pa.record_batch([pa.array(qids[ask + i]), batch.column(0).take(pa.array(at[row])), pa.array(d[ask, row]), pa.array(exact)], ["qid", "id", "rough", "distance"])


def _by_blocks(queries: DataFrame, numbers: int, one: Callable[[list], DataFrame]) -> DataFrame | None:
    """The results of bounded blocks of a query table, one after another.

    The driver holds one block at a time. A single block stays lazy; of several each one's result is
    written, so neither plans nor closures grow with the query table.
    """
    rows = queries.toLocalIterator()
    first = list(islice(rows, max(1, BLOCK_NUMBERS // numbers)))
    if not first:
        return None
    block = list(islice(rows, len(first)))
    if not block:
        return one(first)
    path = f"{work_dir(queries.sparkSession)}/blocks"
    one(first).write.parquet(path)
    while block:
        one(block).write.mode("append").parquet(path)
        block = list(islice(rows, len(first)))
    return queries.sparkSession.read.parquet(path)


def _usable(q: Column, dim: int, metric: str) -> Column:
    return (F.size(q) == dim) & (V.problem(q, metric).isNull())


def batch_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine_distance", filters: Any = None, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """k nearest rows for each row (qid, q) of a query table: (qid, rn, id, distance). Queries take part if they have the
    most common length and are sound.

    Blocks of the query set, of bounded size, meet every batch of the corpus in one matrix product; few rows per
    batch and query get exact distances there and go on, without their vectors, to a window whose limit Spark applies before
    the shuffle.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    k = max(1, k)
    rows = _filtered(docs, filters, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"))
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")).where("qid is not null and q is not null")
    if not (some := asked.groupBy(F.size("q").alias("dim")).count().orderBy(F.desc("count"), "dim").first()):
        return asked.limit(0).select("qid", F.lit(1).alias("rn"), F.col("qid").alias("id"), F.lit(0.0).alias("distance"))
    dim = some[0]
    asked = asked.where(_usable(F.col("q"), dim, metric))

    def one(block: list) -> DataFrame:
        q, qids = np.array([b["q"] for b in block]), np.array([b["qid"] for b in block], np.int64)
        found = rows.mapInArrow(lambda it: _candidates(it, q, qids, k, metric), "qid long, id long, distance double")
        best = Window.partitionBy("qid").orderBy("distance", "id")
        return found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).select("qid", "rn", "id", "distance")

    found = _by_blocks(asked, dim, one)
    return found if found is not None else batch_top_k(docs, queries.limit(0), k, metric)


def int8_batch_top_k(docs: DataFrame, queries: DataFrame, pools: Sequence[int], k: int = 10, metric: str = "cosine_distance", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """For several pool sizes and a query table: (pool, qid, rn, id, distance), the k nearest of the best ``pool`` by int8 codes."""
    k, most = max(1, k), max(pools)

    def coded(df: DataFrame, key: str, vec: str) -> DataFrame:
        v = F.col(vec)
        return df.select(F.col(key).cast("long").alias(key), v.alias("v"), V.int8_codes(v).cast("array<double>").alias("c"), V.int8_scale(v).alias("s"), V.dot(v, v).alias("n")).where(V.problem(v, metric).isNull())

    rows = coded(docs, id_col, vec_col).select(F.col(id_col).alias("id"), F.col("v").cast("array<float>").alias("v"), "c", "s", "n")
    asked = coded(queries, "qid", "q")
    dim = (asked.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first() or [1])[0]
    asked = asked.where(F.size("v") == dim)

    def one(block: list) -> DataFrame:
        q, s, n, v = (np.array([b[c] for b in block], np.float64) for c in "csnv")
        qids = np.array([b["qid"] for b in block], np.int64)
        found = rows.mapInArrow(lambda it: _rough(it, q, s, n, v, qids, most, metric), "qid long, id long, rough double, distance double")
        place = Window.partitionBy("qid").orderBy("rough", "id")
        pool = found.withColumn("at", F.row_number().over(place)).where(F.col("at") <= most)
        each = pool.withColumn("pool", F.explode(F.array(*map(F.lit, pools)))).where("at <= pool")
        best = Window.partitionBy("pool", "qid").orderBy("distance", "id")
        return each.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).select("pool", "qid", "rn", "id", "distance")

    found = _by_blocks(asked, dim, one)
    return found if found is not None else docs.sparkSession.createDataFrame([], "pool int, qid long, rn int, id long, distance double")


def scan_limit(rows: int, ef: int) -> int:
    """With at most this many matching rows a scan is cheaper than an index walk."""
    return max(2048, int((rows * 32 * max(ef, 16)) ** 0.5))


def fit_cells(docs: DataFrame, cells: int, sample_rows: int = 100_000, seed: int = 7, vec_col: str = "vector") -> np.ndarray:
    """Centres of k-means cells, fitted by Spark ML on a bounded sample."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    # Few more rows than wanted meet in the last task: those whose hash is low enough, unless too few are.
    hashed, total = F.xxhash64(vec_col), docs.count()
    low = docs.where(hashed < int(-(2**63) + 2**64 * 1.2 * sample_rows / total)) if total > 1.5 * sample_rows else docs
    if low is not docs and low.limit(sample_rows).count() < sample_rows:
        low = docs
    sample = low.orderBy(hashed).limit(sample_rows).select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    return np.stack(KMeans(k=cells, seed=seed, maxIter=10).fit(sample).clusterCenters())


def cell_of(vec: Column, centres: np.ndarray) -> Column:
    """The nearest centre's number."""
    gaps = [F.struct(V.l2_squared(vec, V.literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres.tolist())]
    return F.array_min(F.array(*gaps))["i"]


def assign_cells(docs: DataFrame, centres: np.ndarray, vec_col: str = "vector") -> DataFrame:
    """Rows with their cell, by one matrix product per batch; -1 for vectors that have none."""
    at = docs.columns.index(vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = (centres**2).sum(axis=1)
        for batch in batches:
            rows, x = _matrix(batch.column(at), centres.shape[1])
            cell = np.full(batch.num_rows, -1)
            cell[rows] = np.argmin(norm - 2 * x @ centres.T, axis=1)
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "cell"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, cell int")


def write_cells(celled: DataFrame, path: str) -> DataFrame:
    """The rows written by cell: a probe of some cells reads their folders alone. Each task writes its own rows, so none holds a cell."""
    celled.write.partitionBy("cell").parquet(path)
    return celled.sparkSession.read.parquet(path)


def probe_top_k(celled: DataFrame, centres: np.ndarray, query: Sequence[float], nprobe: int, k: int = 10, metric: str = "cosine_distance", filters: Any = None, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Exact top-k within the nprobe cells whose centres are closest to the query."""
    near = np.argsort(((centres - np.asarray(query)) ** 2).sum(axis=1), kind="stable")[:nprobe].tolist()
    return top_k(celled.where(F.col("cell").isin(near)), query, k, metric, filters, None, id_col, vec_col)


def merge_shards(partial: DataFrame, k: int = 10) -> DataFrame:
    """Shards' results (id, distance) merged: nearest first, the first of each id, k in all."""
    return partial.groupBy("id").agg(F.min("distance").alias("distance")).orderBy("distance", "id").limit(max(1, k))


def sharded_top_k(docs: DataFrame, query: Sequence[float], k: int = 10, metric: str = "cosine_distance", shard_col: str = "shard", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Each shard's own k nearest, then the merge."""
    rows = docs.select(shard_col, F.col(id_col).alias("id"), V.distance(metric, F.col(vec_col), V.literal(query)).alias("distance")).where(V.sound(F.col("distance")))
    own = Window.partitionBy(shard_col).orderBy("distance", "id")
    return merge_shards(rows.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= max(1, k)), k)
