"""kNN, evaluation, sharding, ingest and generators against plain Python."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vespera.functions import vectors as V
from vespera.functions.sharding import canonical_id, key_of, shard, shard_for
from vespera.operators import evaluate, knn
from vespera.sources import generate, ingest

RNG = np.random.default_rng(9)


def frame(spark, x, **cols):
    rows = [(i, v.tolist(), *(c[i] for c in cols.values())) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vector array<float>" + "".join(f", {n} long" for n in cols))


def distances(metric, x, q):
    x, q = x.astype(np.float32).astype(float), np.asarray(q, np.float64)
    if metric == "cosine_distance":
        return np.maximum(0, 1 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)))
    return ((x - q) ** 2).sum(axis=1) if metric == "euclidean_squared" else -x @ q


@pytest.mark.parametrize("metric", V.METRICS)
def test_exact_batch_and_int8_agree_with_brute_force(spark, metric):
    x = RNG.normal(size=(1500, 32)) * RNG.uniform(0.2, 3, (1500, 1))
    docs = frame(spark, x, bucket=[i % 50 for i in range(1500)]).repartition(5).cache()
    q = x[:12].astype(np.float32).astype(float)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, q array<double>")
    got = {}
    for r in knn.batch_top_k(docs, asked, 10, metric).collect():
        got.setdefault(r.qid, {})[r.rn] = (r.id, r.distance)
    hits = 0
    for i, v in enumerate(q):
        d = distances(metric, x, v)
        want = np.lexsort((np.arange(len(d)), d))[:10]
        assert [got[i][n + 1][0] for n in range(10)] == want.tolist()
        assert np.allclose([got[i][n + 1][1] for n in range(10)], d[want])
        if i < 3:
            assert [r.id for r in knn.top_k(docs, v.tolist(), 10, metric).collect()] == want.tolist()
            hits += len({r.id for r in knn.int8_top_k(docs, v.tolist(), 10, metric).collect()} & set(want.tolist()))
    assert hits >= 29
    some = knn.batch_top_k(docs, asked, 10, metric, ["bucket", "Eq", 7])
    assert some.count() == 120 and {r.id % 50 for r in some.select("id").collect()} == {7}
    assert knn.batch_top_k(docs, asked.limit(0), 10, metric).count() == 0
    assert knn.top_k(docs, q[0].tolist(), 10, metric, ["bucket", "Eq", 99]).count() == 0


@pytest.mark.parametrize("metric", V.METRICS)
def test_vectors_without_a_distance_are_never_near(spark, metric):
    odd = [None, [], [1.0], [1.0, None], [1.0, float("nan")], [float("inf"), 0.0], [0.0, 0.0], [1.0, 0.1], [1.0, 0.0, 0.0]]
    docs = spark.createDataFrame(list(enumerate(odd)), "id long, vector array<float>")
    want = {7} if metric == "cosine_distance" else {6, 7}
    assert {r.id for r in knn.top_k(docs, [1.0, 0.0], 9, metric).collect()} == want
    assert {r.id for r in knn.int8_top_k(docs, [1.0, 0.0], 9, metric).collect()} == want
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, float("nan")]), (3, None), (4, [2.0, 0.5])], "qid long, q array<double>").coalesce(1)
    got = knn.batch_top_k(docs, asked, 9, metric).collect()
    assert {(r.qid, r.id) for r in got} == {(q, i) for q in (1, 4) for i in want}
    near = knn.int8_batch_top_k(docs, asked, [4, 8], 9, metric).collect()
    assert {(r.pool, r.qid, r.id) for r in near} == {(p, q, i) for p in (4, 8) for q in (1, 4) for i in want}
    sharded = docs.withColumn("shard", F.col("id") % 2)
    assert {r.id for r in knn.sharded_top_k(sharded, [1.0, 0.0], 9, metric).collect()} == want
    cells = {r.id: r.cell for r in knn.assign_cells(docs, np.eye(2)).collect()}
    assert cells[7] == 0 and [cells[i] for i in (0, 1, 2, 3, 4, 5, 8)] == [-1] * 7


def test_blocks_of_queries_and_small_k(spark, monkeypatch):
    x = RNG.normal(size=(300, 8))
    docs = frame(spark, x).cache()
    asked = docs.select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    whole = sorted(map(tuple, knn.batch_top_k(docs, asked, 3).collect()))
    monkeypatch.setattr(knn, "BLOCK_NUMBERS", 8 * 64)
    assert sorted(map(tuple, knn.batch_top_k(docs, asked, 3).collect())) == whole and len(whole) == 900
    assert {r.rn for r in knn.batch_top_k(docs, asked, 0).collect()} == {1}
    partial = docs.select("id", F.lit(0.5).alias("distance"))
    assert knn.merge_shards(partial, 0).count() == 1 and knn.int8_top_k(docs, x[0].tolist(), 0).count() == 1


def test_probing_reads_only_its_cells(spark, tmp_path):
    docs = frame(spark, RNG.normal(size=(400, 8)))
    centres = knn.fit_cells(docs, 6)
    celled = knn.write_cells(knn.assign_cells(docs, centres), f"file://{tmp_path}/cells")
    probe = knn.probe_top_k(celled, centres, [1.0] * 8, 2)
    plan = probe._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert probe.count() == 10


def test_batch_ties_go_to_the_smaller_id(spark):
    docs = frame(spark, np.array([[1.0, 0.0]] * 40 + [[0.0, 1.0]]))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, q array<double>")
    assert [r.id for r in knn.batch_top_k(docs, asked, 3).orderBy("rn").collect()] == [0, 1, 2]


def test_cells_reach_the_floor(spark):
    docs = generate.clustered(spark, 600, 16, clusters=8).cache()
    centres = knn.fit_cells(docs, 8)
    celled = knn.assign_cells(docs, centres).cache()
    hits = 0
    for r in docs.where("id < 5").collect():
        want = {x.id for x in knn.top_k(docs, r.vector).collect()}
        hits += len(want & {x.id for x in knn.probe_top_k(celled, centres, r.vector, 3).collect()})
    assert hits >= 45
    at = celled.select((F.col("cell") == knn.cell_of(F.col("vector"), centres)).alias("same")).agg(F.min("same")).first()[0]
    assert at is True
    assert knn.scan_limit(20_000, 128) == 9050 and knn.scan_limit(10, 0) == 2048


def test_vector_functions(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, []), (5, [1e30, 1e30])], "id int, v array<double>")
    got = {r.id: r for r in rows.select("id", V.problem(F.col("v")).alias("p"), V.problem(F.col("v"), "dot_product").alias("d"), V.normalize(F.col("v")).alias("n"), V.int8_codes(F.col("v")).alias("c")).collect()}
    assert [got[i].p for i in range(6)] == [None, "zero", "not_finite", "not_finite", "empty", "overflow"]
    assert got[1].d is None and got[5].d is None
    assert got[0].n == [0.6, 0.8] and got[1].n == [0, 0] and got[0].c == [95, 127] and got[1].c == [0, 0]
    with pytest.raises(ValueError):
        V.distance("l7", F.col("v"), F.col("v"))


def test_shard_contract(spark):
    assert [shard_for("serve-bench", i, 4) for i in range(4)] == [3, 0, 1, 2]
    assert canonical_id(42) == canonical_id("42") == canonical_id(" 042") and canonical_id("0") == "0" and canonical_id("a0") == "a0"
    assert key_of("", 1) != key_of("1", "") and len({shard_for("serve-bench", i, 4) for i in range(64)}) == 4
    for bad in (-1, True, 1.5):
        with pytest.raises(ValueError):
            canonical_id(bad)
    ids = ["0", "1", "2", "3", "042", " 7 ", "name", "x" * 300, ""]
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [r.s for r in rows.coalesce(1).select(shard("serve-bench", F.col("id"), 4).alias("s")).collect()]
    assert got == [shard_for("serve-bench", i, 4) for i in ids]


def test_merge_and_sharded_search(spark):
    partial = spark.createDataFrame([(1, 0.2), (2, 0.4), (3, 0.1), (1, 0.9)], "id long, distance double")
    assert [r.id for r in knn.merge_shards(partial, 2).collect()] == [3, 1]
    docs = frame(spark, RNG.normal(size=(200, 8)), shard=[i % 3 for i in range(200)])
    q = [1.0] * 8
    assert knn.sharded_top_k(docs, q, 7).collect() == knn.top_k(docs, q, 7).collect()


def test_metrics_on_toy_rankings(spark):
    truth = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 20), (2, 2, 21)], "qid long, rn int, id long")
    got = spark.createDataFrame([(1, 1, 10), (1, 2, 99), (2, 1, 21), (2, 2, 98)], "qid long, rn int, id long")
    rel = spark.createDataFrame([(1, 99), (2, 77)], "qid long, id long")
    assert evaluate.recall_at_k(truth, got).first()[0] == 0.5
    assert evaluate.top1_agreement(truth, got).first()[0] == 0.5
    assert evaluate.hit_at_k(got, rel).first()[0] == 0.5
    assert evaluate.mrr_at_k(got, rel).first()[0] == 0.25
    assert abs(evaluate.ndcg_at_k(got, rel, 2).first()[0] - 0.5 / np.log2(3)) < 1e-12


@pytest.mark.parametrize("n", [1, 4, 7, 100])
def test_percentiles_on_both_forms(spark, n):
    xs = sorted(RNG.normal(size=n).tolist())
    rows = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    ps = [0.5, 0.95, 0.99]
    r = evaluate.percentile_floor(rows, F.col("x"), ps).first()
    assert [r[f"p{round(p * 100)}"] for p in ps] == [xs[min(n - 1, int(p * n))] for p in ps] and r.n == n
    r = evaluate.percentile_ceil(rows, F.col("x"), ps).first()
    assert [r[f"p{round(p * 100)}"] for p in ps] == [xs[-int(-p * n // 1) - 1] for p in ps]


def test_ingest_forms(spark):
    batch = spark.createDataFrame([([1, 2], [[1.0], [2.0]], ["a", None])], "id array<long>, vector array<array<float>>, kind array<string>")
    assert [tuple(r) for r in ingest.from_columns(batch, ["kind"]).collect()] == [(0, 1, [1.0], "a"), (1, 2, [2.0], None)]
    ragged = spark.createDataFrame([([1, 2], [[1.0]])], "id array<long>, vector array<array<float>>")
    with pytest.raises(ingest.BatchError):
        ingest.from_columns(ragged, [])
    cards = ingest.text_cards(spark.createDataFrame([("a" * 1100 + "b" * 5000 + "c" * 1100,), ("short",), ("",), (None,)], "text string"))
    assert [r.card for r in cards.collect()] == ["a" * 1100 + "\n...\n" + "c" * 1100, "short"]
    assert generate.embed_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).count() == 2


@pytest.mark.parametrize("metric", V.METRICS)
def test_a_worker_holds_little_of_a_batch_and_a_block(metric):
    """10,000 rows meet 3,000 queries: what is held stays far below their distances (240 MB), and no vectors are given out."""
    x, q = RNG.normal(size=(10_000, 16)), RNG.normal(size=(3_000, 16))
    vectors = pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))
    ids, one = pa.array(np.arange(10_000)), np.ones(3_000)
    codes = pa.record_batch([ids, vectors, pa.array(list(x)), pa.array(np.ones(10_000)), pa.array((x * x).sum(axis=1))], ["id", "v", "c", "s", "n"])
    runs = [lambda: knn._candidates(iter([codes.select([0, 1])]), q, np.arange(3_000), 5, metric), lambda: knn._rough(iter([codes]), q, one, (q * q).sum(axis=1), q, np.arange(3_000), 80, metric)]
    for run in runs:
        tracemalloc.start()
        sizes = [(b.num_rows, b.nbytes) for b in run()]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6 and sum(n for n, _ in sizes) >= 15_000 and max(b for _, b in sizes) < 2e6


def test_cells_are_fitted_on_the_lowest_hashes_and_written_by_many_tasks(spark, tmp_path):
    docs = frame(spark, RNG.normal(size=(400, 8))).repartition(4).cache()
    lowest = docs.orderBy(F.xxhash64("vector")).limit(100).cache()
    centres = knn.fit_cells(docs, 4, sample_rows=100)
    assert np.allclose(np.sort(centres, axis=0), np.sort(knn.fit_cells(lowest, 4), axis=0))
    same = docs.withColumn("vector", F.expr("transform(vector, x -> cast(1 as float))"))
    assert np.allclose(knn.fit_cells(same, 2, sample_rows=100), 1)
    one = docs.withColumn("cell", F.lit(0))
    assert knn.write_cells(one, f"file://{tmp_path}/one").count() == 400
    assert len(list((tmp_path / "one" / "cell=0").glob("*.parquet"))) > 1
