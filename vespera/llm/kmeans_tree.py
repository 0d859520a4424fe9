"""Nearest neighbours with a hierarchical k-means tree, searched best bin first.

Index. The tree is fitted on a bounded sample (at most ``sample_rows`` vectors, those whose id hashes
lowest): k-means with ``branching`` centres splits a node until it has at most ``leaf_rows``
sample vectors. Every vector of the table is then sent down the tree to its leaf by the
executors; the tree itself is small and of a size that the sample bounds.

Search. A query walks the tree with a priority queue of branches, the closest centre first, and visits leaves
in that order. How many leaves are visited is calibrated: for ``calibration_queries`` vectors of the sample
exact neighbours within the sample are known, and the visits are widened until the neighbours
found reach ``target_recall``. A query goes on beyond that number until its leaves hold k + 1 keys. Query visits and vectors
meet in one shuffle by leaf, where exact double-precision distances are taken; each query keeps its best k per leaf, then overall.

Skew. Equal vectors are one key of the index with the k + 1 smallest ids: no further copy can be among
k neighbours, because ties go to the smaller id. Groups of leaves with more than ``group_rows`` keys, or with more
queries than that, are dealt over several tasks, part by part. Equal query vectors are searched once.

Defined results: vectors that are null, zero, of another length than the most common one, or that hold null
or non-finite components take no part; so do null ids. Of repeated rows with one id and vector one counts. With fewer
candidates than k, all are returned; an empty table or no query gives an empty result. Vectors may be of any length; other
columns than id and vector are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vespera.llm.common import Kept, keep

BLOCK = 1 << 22
#: Queries that a task walks through the tree, and tasks at most.
QUERIES, MAX_TASKS = 64, 20_000
#: Leaves that share a task; neighbours in the tree have neighbouring numbers.
LEAVES = 16


@dataclass
class Tree:
    """Centres of all nodes; ``kids[i]`` are the children of node i, leaves have none."""

    centre: np.ndarray
    kids: list[np.ndarray]
    leaf: np.ndarray  # the leaf's number, or -1

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by descending to the closest child."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not len(self.kids[node]):
                out[rows] = self.leaf[node]
                continue
            near = _closest(x[rows], self.centre[self.kids[node]])
            todo += [(int(kid), rows[near == k]) for k, kid in enumerate(self.kids[node])]
        return out

    def walk(self, q: np.ndarray, visits: int, held: np.ndarray | None = None, want: int = 0) -> list[int]:
        """The first ``visits`` leaves, best bin first, and more until those (with ``held`` keys each) hold ``want``."""
        out: list[int] = []
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue and (len(out) < visits or want > 0):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                want -= int(held[out[-1]]) if held is not None else 0
                continue
            kids = self.kids[node]
            gap = ((self.centre[kids] - q) ** 2).sum(axis=1)
            for d, kid in zip(gap.tolist(), kids.tolist()):
                heapq.heappush(queue, (d, kid))
        return out


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    step = max(1, BLOCK // max(1, len(centres)))
    norm = (centres**2).sum(axis=1)
    for i in range(0, len(x), step):
        out[i : i + step] = np.argmin(norm - 2 * x[i : i + step] @ centres.T, axis=1)
    return out


def fit_tree(x: np.ndarray, branching: int = 8, leaf_rows: int = 24, rounds: int = 8, seed: int = 5) -> Tree:
    """Split the sample by k-means until nodes are small; nodes of equal vectors are not split."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] if x.ndim == 2 else 0
    centre, kids, leaf = [x.mean(axis=0) if len(x) else np.zeros(dim)], [np.zeros(0, np.int64)], [-1]
    todo, leaves = [(0, x)], 0
    while todo:
        node, rows = todo.pop()
        parts: list[np.ndarray] = []
        if len(rows) > leaf_rows:
            c = rows[rng.choice(len(rows), min(branching, len(rows)), replace=False)]
            for _ in range(rounds):
                near = _closest(rows, c)
                c = np.stack([rows[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            near = _closest(rows, c)
            parts = [rows[near == k] for k in range(len(c)) if (near == k).any()]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        kids[node] = np.arange(len(centre), len(centre) + len(parts))
        for part in parts:
            todo.append((len(centre), part))
            centre.append(part.mean(axis=0))
            kids.append(np.zeros(0, np.int64))
            leaf.append(-1)
    return Tree(np.stack(centre), kids, np.array(leaf, np.int32))


def calibrate(tree: Tree, x: np.ndarray, k: int, target: float, queries: int = 200, seed: int = 6) -> int:
    """The least number of leaves to visit that finds the target share of exact neighbours within the sample."""
    if len(x) < 2:
        return tree.leaves
    home = tree.assign(x)
    rows = np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False)
    depth = np.zeros(tree.leaves + 1)
    total = 0
    for r in rows:
        d = ((x - x[r]) ** 2).sum(axis=1)
        d[r] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1)[: min(k, len(x) - 1)]
        place = np.empty(tree.leaves, np.int64)
        order = tree.walk(x[r], tree.leaves)
        place[order] = np.arange(len(order))
        np.add.at(depth, place[home[near]] + 1, 1)
        total += len(near)
    return int(np.searchsorted(np.cumsum(depth) / total, target)) or 1


def _clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.where(fine & F.exists("v", lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _assign(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = _matrix(batch.column(0))
        leaf = tree.assign(v) if len(v) else np.zeros(0, np.int32)
        yield pa.record_batch([pa.array(leaf), *batch.columns], ["leaf", *batch.schema.names])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _visit(batches: Iterator[pa.RecordBatch], tree: Tree, visits: int, held: np.ndarray, want: int) -> Iterator[pa.RecordBatch]:
    """A row for each query and group of neighbouring leaves that it visits, with those leaves."""
    kind = pa.list_(pa.int32())
    for batch in batches:
        v, ids = _matrix(batch.column(0)), batch.column(1).to_pylist()
        for i in range(0, len(ids), 64):
            rows: list[tuple[int, int, list[int]]] = []
            for j, q in enumerate(v[i : i + 64]):
                groups: dict[int, list[int]] = {}
                for leaf in tree.walk(q, visits, held, want):
                    groups.setdefault(leaf // LEAVES, []).append(leaf)
                rows += [(i + j, g, leaves) for g, leaves in groups.items()]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.record_batch([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], kind), batch.column(0).take(take), batch.column(1).take(take)], ["bin", "leaves", "v", "qid"])


def _meet(k: int):
    """Best k + 1 of one part of a group of leaves for each query that visits some of them."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(left) and len(right):
            x, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
            ids, qids, leaf = left["ids"].to_numpy(), right["qid"].to_numpy(), left["leaf"].to_numpy() % LEAVES
            norm = (x**2).sum(axis=1)
            open_ = np.zeros((len(q), LEAVES), bool)
            for i, leaves in enumerate(right["leaves"]):
                open_[i, np.asarray(leaves) % LEAVES] = True
            step = max(1, BLOCK // len(x))
            for i in range(0, len(q), step):
                rough = norm - 2 * q[i : i + step] @ x.T
                for j, row in enumerate(rough, i):
                    near = np.flatnonzero(open_[j, leaf])
                    if len(near) > k + 1:  # a first cut, with room for rounding; exact distances follow
                        edge = np.partition(row[near], k)[k]
                        near = near[row[near] <= edge + 1e-9 * (abs(edge) + norm.max() + 1)]
                    d2 = ((x[near] - q[j]) ** 2).sum(axis=1)
                    best = sorted((d, int(v)) for d, n in zip(d2.tolist(), near) for v in ids[n])[: k + 1]
                    found += [(int(qids[j]), v, d) for d, v in best]
        return pd.DataFrame(found, columns=["qid", "vec_id", "d2"]).astype({"qid": "int64", "vec_id": "int64", "d2": "float64"})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = 20_000, branching: int = 8, leaf_rows: int = 24, target_recall: float = 0.97, group_rows: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors but itself, by Euclidean distance.

    ``queries`` has the same columns as ``vectors``; a query's own id is never its neighbour.
    """
    clean = _clean(vectors, id_col, vec_col)
    # Equal vectors become one key with their k + 1 smallest ids.
    order = Window.partitionBy("v").orderBy("vec_id")
    first = clean.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    keys = Kept(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-keys").df
    sample = keys.select("v", F.xxhash64("ids").alias("h")).orderBy("h", "v").limit(sample_rows).toArrow()["v"].combine_chunks()
    x = _matrix(sample)
    tree = fit_tree(x, branching, leaf_rows)
    visits = calibrate(tree, x, k, target_recall)
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * sample_rows centres
    kind = "v array<double>"
    assigned = keys.mapInArrow(lambda it: _assign(it, shared.value), f"leaf int, {kind}, ids array<long>")
    indexed = keep(assigned.withColumn("bin", F.floor(F.col("leaf") / LEAVES).cast("int")), "ann-index")
    held = np.zeros(tree.leaves, np.int64)
    for row in indexed.groupBy("leaf").count().collect():  # as many as the tree has leaves
        held[row["leaf"]] = row["count"]
    # Equal query vectors are searched once, under the least of their ids.
    asked = keep(_clean(queries, id_col, vec_col).distinct(), "ann-queries")
    once = keep(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "ann-once")
    dealt = once.repartition(min(MAX_TASKS, 1 + once.count() // QUERIES))
    visiting = keep(dealt.mapInArrow(lambda it: _visit(it, shared.value, visits, held, k + 1), f"bin int, leaves array<int>, {kind}, qid long"), "ann-visits")

    def sized(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("bin").agg(F.ceil(F.count("*") / group_rows).cast("int").alias(name)).where(F.col(name) > 1)

    # At most rows / group_rows groups of leaves are split, on either side: keys over a, queries over b.
    split = keep(sized(indexed, "a").join(sized(visiting, "b"), "bin", "full"), "ann-split")
    left, right = (rows.withColumn("part", F.array(F.lit(0), F.lit(0))) for rows in (indexed, visiting))
    if split.take(1):

        def parts(rows: DataFrame, own: str, other: str, flip: bool) -> DataFrame:
            """Each row goes to one part of its own side and meets all parts of the other."""
            mine = F.pmod(F.xxhash64("v"), F.coalesce(own, F.lit(1))).cast("int")
            rows = rows.join(split, "bin", "left").withColumn("theirs", F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)))
            pair = [F.col("theirs"), mine] if flip else [mine, F.col("theirs")]
            return rows.withColumn("part", F.array(*pair)).drop("a", "b", "theirs")

        left, right = parts(indexed, "a", "b", False), parts(visiting, "b", "a", True)
    met = left.groupBy("bin", "part").cogroup(right.groupBy("bin", "part")).applyInPandas(_meet(k), "qid long, vec_id long, d2 double")
    # k + 1 candidates for each distinct query vector, then each query drops itself.
    near = Window.partitionBy("qid").orderBy("d2", "vec_id")
    found = met.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1)
    alike = asked.join(once.select("v", "qid"), "v").select("qid", F.col("vec_id").alias("query_id"))
    each = alike.join(found.select("qid", "vec_id", "d2"), "qid").where("vec_id <> query_id")
    own = Window.partitionBy("query_id").orderBy("d2", "vec_id")
    out = each.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d2").alias("score"))
