"""Filters, writes, snapshots, shards and streams against plain-Python models."""

import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.collection import CELL, Collection, NotFound
from vespera.operators.fold import LOG_SCHEMA, fold
from vespera.plans.filters import FilterError, compile_cells, compile_filter, compile_tagged
from vespera.sources.ingest import BatchError, file_cards, log_segment, questions_of
from vespera.sources.store import BadName, Unavailable, check_name

# A small language model of filters: values are None, bool, int, float or str.


def kind(v):
    return "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text"


def equal(a, b):
    return kind(a) == kind(b) and (a is None or a == b)


def holds(expr, row):
    if expr[0] == "And" and len(expr) == 2:
        return all(holds(e, row) for e in expr[1])
    if expr[0] == "Or" and len(expr) == 2:
        return any(holds(e, row) for e in expr[1])
    if expr[0] == "Not" and len(expr) == 2:
        return not holds(expr[1], row)
    name, op, value = expr
    cell = row.get(name)
    if op in ("Eq", "NotEq"):
        return equal(cell, value) == (op == "Eq")
    if op in ("In", "NotIn"):
        return any(equal(cell, v) for v in value) == (op == "In")
    if kind(cell) != kind(value) or kind(cell) not in ("number", "text"):
        return False
    a, b = (cell.encode(), value.encode()) if kind(cell) == "text" else (cell, value)
    return {"Lt": a < b, "Lte": a <= b, "Gt": a > b, "Gte": a >= b}[op]


VALUES = [None, True, False, 0, 3, 7, 7.0, 2.5, -1, "", "amber", "Birch", "zinc", "ä", 1 << 62]
NAMES = ["id", "tint", "mass", "mixed", "absent"]


def some_filter(rnd, depth=3):
    if depth and rnd.random() < 0.5:
        head = rnd.choice(["And", "Or", "Not"])
        return [head, some_filter(rnd, depth - 1)] if head == "Not" else [head, [some_filter(rnd, depth - 1) for _ in range(rnd.randrange(4))]]
    op = rnd.choice(["Eq", "NotEq", "Lt", "Lte", "Gt", "Gte", "In", "NotIn"])
    return [rnd.choice(NAMES), op, [rnd.choice(VALUES) for _ in range(rnd.randrange(4))] if op.endswith("In") else rnd.choice(VALUES)]


def cell(v):
    return None if v is None else (v if isinstance(v, bool) else None, v if kind(v) == "number" and isinstance(v, int) else None, v if isinstance(v, float) else None, v if isinstance(v, str) else None)


def test_random_filters_equal_the_model(spark):
    rnd = random.Random(12)
    rows = [{"id": i, "tint": rnd.choice(["amber", "Birch", "zinc", "ä", "", None]), "mass": rnd.choice([None, 0.0, 2.5, 7.0, -1.0]), "mixed": rnd.choice(VALUES)} for i in range(60)]
    typed = spark.createDataFrame([(r["id"], r["tint"], r["mass"]) for r in rows], "id long, tint string, mass double").coalesce(1)
    tagged = spark.createDataFrame([(r["id"], {n: cell(r[n]) for n in ("tint", "mass", "mixed")}) for r in rows], f"id long, attrs map<string, {CELL}>").coalesce(1)
    tagged = tagged.withColumn("cells", F.struct(*[F.element_at("attrs", n).alias(n) for n in ("tint", "mass", "mixed")])).cache()
    exprs = [some_filter(rnd) for _ in range(60)]
    on_map = tagged.select("id", *[compile_tagged(e, F.col("attrs"), F.col("id")).alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
    on_cells = tagged.select("id", *[compile_cells(e, F.col("cells"), ["tint", "mass", "mixed"], F.col("id")).alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
    on_types = typed.select("id", *[compile_filter(e, typed.schema).alias(f"c{i}") for i, e in enumerate(exprs)]).collect()
    for got, names in ((on_map, NAMES), (on_cells, NAMES), (on_types, NAMES[:3])):
        for r in got:
            row = {n: v for n, v in rows[r.id].items() if n in names}
            for i, e in enumerate(exprs):
                assert r[f"c{i}"] == holds(e, row), (e, row)


@pytest.mark.parametrize("expr", [None, 5, [], ["tint"], ["tint", "Near", 1], ["Or", 3], ["mass", "NotIn", 7], ["tint", "Eq", {}], ["Not", [["tint", "Eq", 1]]], {"a": 1}])
def test_what_is_no_filter_is_refused(spark, expr):
    with pytest.raises(FilterError):
        compile_cells(expr, F.col("cells"), [], F.col("id"))


def test_filters_reach_the_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(label,3)" in plan(docs.where(compile_filter(["label", "Eq", 3], docs.schema, "vec_id")))
    c = Collection(spark, f"file://{tmp_path}", "pushed")
    c.write(upsert_rows=[{"id": i, "vector": [1.0, i], "tint": "amber"} for i in range(4)])
    c.compact()
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    found = c.query([1, 0], filters=["tint", "Eq", "amber"])
    assert "EqualTo(attributes.tint.s,amber)" in plan(found) and "Exchange" not in plan(found) and found.count() == 4
    c.write(deletes=[2])
    left = plan(c.query([1, 0], filters=["tint", "Eq", "amber"]))
    assert "BroadcastHashJoin" in left and "SortMergeJoin" not in left


class Model:
    """A collection as a dict."""

    def __init__(self):
        self.docs = {}

    def write(self, rows=(), deletes=(), by_filter=None):
        before = dict(self.docs)
        for i, d in before.items():
            if by_filter is not None and holds(by_filter, {"id": i, **d[1]}):
                del self.docs[i]
        for r in rows:
            r = dict(r)
            self.docs[r.pop("id")] = (r.pop("vector"), r)
        for i in deletes:
            self.docs.pop(i, None)

    def nearest(self, q, k, expr=None):
        x = {i: np.asarray(v, np.float32).astype(float) for i, (v, a) in self.docs.items() if expr is None or holds(expr, {"id": i, **a})}
        d = {i: max(0.0, 1 - v @ q / (np.linalg.norm(v) * np.linalg.norm(q))) for i, v in x.items()}
        return sorted(d, key=lambda i: (d[i], i))[:k]


@pytest.mark.parametrize("shards", [1, 3])
def test_random_batches_equal_the_model(spark, tmp_path, shards):
    rnd = random.Random(shards)
    c, model = Collection(spark, f"file://{tmp_path}", "walk", shards), Model()
    point = lambda: [rnd.gauss(0, 1) for _ in range(3)]
    for step in range(5):
        rows = [{"id": rnd.randrange(40), "vector": point(), **{n: rnd.choice(VALUES) for n in ("tint", "mixed") if rnd.random() < 0.7}} for _ in range(12)]
        gone, expr = [rnd.randrange(40) for _ in range(3)], some_filter(rnd, 1) if step % 2 else None
        c.write(upsert_rows=rows, deletes=gone, delete_by_filter=expr)
        model.write(rows, gone, expr)
        if step == 2:
            c.compact()
        q, where = point(), some_filter(rnd, 2)
        got = c.query_rows(q, 6, where, include_attributes=True)
        assert [r["id"] for r in got] == model.nearest(np.array(q), 6, where)
        for r in got:
            assert {k: v for k, v in r.items() if k not in ("id", "$distance")} == {k: v for k, v in model.docs[r["id"]][1].items() if v is not None}
    assert [r["id"] for r in c.query_rows(q, 6, ef=64)] == model.nearest(np.array(q), 6)
    assert c.stats() == {"namespace": "walk", "dim": 3, "count": len(model.docs), "metric": "cosine_distance"}
    c.compact()
    assert {r.id for r in c.documents().collect()} == set(model.docs) and c.store.batches() == []
    if shards > 1:
        assert c.store.snapshot()[1].select("shard").distinct().count() == shards


def test_refused_batches_change_nothing(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}", "firm")
    for call in (c.stats, c.compact, lambda: c.query([1.0])):
        with pytest.raises(NotFound):
            call()
    c.write(upsert_columns={"id": [5, 6], "vector": [[3.0, 4.0], [0.0, -2.0]], "tint": ["zinc", None]}, distance_metric="euclidean_squared")
    bad = [
        {},
        {"upsert_rows": [{"id": 7, "vector": [1.0, 1.0]}], "distance_metric": "cosine_distance"},
        {"upsert_rows": [{"id": 7, "vector": [1.0, 1.0]}], "distance_metric": "manhattan"},
        {"upsert_rows": [{"id": 7, "vector": [1.0]}]},
        {"upsert_rows": [{"id": 7, "vector": [1.0, float("inf")]}]},
        {"upsert_rows": [{"id": True, "vector": [1.0, 1.0]}]},
        {"upsert_rows": [{"id": -7, "vector": [1.0, 1.0]}]},
        {"upsert_rows": [{"vector": [1.0, 1.0]}]},
        {"upsert_rows": [{"id": 7, "vector": [1.0, 1.0], "parts": {"a": 1}}]},
        {"upsert_rows": [{"id": 7, "vector": [1.0, 1.0], "$rank": 1}]},
        {"upsert_columns": {"id": [7, 8], "vector": [[1.0, 1.0]]}},
        {"deletes": [-1]},
        {"delete_by_filter": ["tint", "Near", "zinc"]},
    ]
    for batch in bad:
        with pytest.raises((BatchError, FilterError)):
            c.write(**batch)
    for q, f in (([1.0], None), ([1.0, 1.0], ["tint"])):
        with pytest.raises((BatchError, FilterError)):
            c.query(q, filters=f)
    assert c.query_rows([0.0, 0.0], include_attributes=["tint", "other"]) == [{"id": 6, "$distance": 4.0}, {"id": 5, "$distance": 25.0, "tint": "zinc"}]
    assert c.query([0.0, 0.0], top_k=0).count() == 1
    c.drop()
    c.drop()
    assert not c.store.exists()


def test_whole_or_refused(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}", "safe")
    for i in range(3):
        c.write(upsert_rows=[{"id": 20 + i, "vector": [1.0, float(i)]}])
    log = f"{tmp_path}/safe/log"
    shutil.move(f"{log}/batch=1", f"{tmp_path}/aside")
    with pytest.raises(Unavailable):
        c.documents()
    shutil.move(f"{tmp_path}/aside", f"{log}/batch=1")
    os.remove(f"{log}/batch=2/_SUCCESS")
    with pytest.raises(Unavailable):
        c.query([1.0, 0.0])
    open(f"{log}/batch=2/_SUCCESS", "w").close()
    # A reader that has only the files knows all there is to know; an unfinished snapshot does not count.
    other = Collection(spark, f"file://{tmp_path}", "safe")
    assert (other.facts().dim, other.facts().metric, other.stats()["count"]) == (2, "cosine_distance", 3)
    os.makedirs(f"{tmp_path}/safe/snapshot/upto=2")
    assert c.store.snapshot()[1] is None and c.stats()["count"] == 3
    assert c.compact() == 2 and c.store.batches() == [] and c.stats()["count"] == 3


@pytest.mark.parametrize("name", ["", ".", "..", "a/b", "ü", "n" * 129, "two words", "line\n"])
def test_names(name):
    with pytest.raises(BadName):
        check_name(name)
    assert check_name("Node-7_b.v2") and check_name("n" * 128)


def test_json_segments(spark):
    bodies = [(4, '{"docs":[[1,[2,0],{"tint":"say \\"hi\\"\\n","n":3,"f":2.5,"on":false,"digits":"12"}],[2,[0,1]]]}'), (9, '{"docs":[[2,null],[3,[1,1],{"n":null}]]}')]
    live = {r.id: r for r in fold(log_segment(spark.createDataFrame(bodies, "seq long, body string"))).collect()}
    assert set(live) == {1, 3} and live[1].vector == [2.0, 0.0]
    cells = {k: tuple(v) for k, v in live[1].attrs.items()}
    assert cells == {"tint": (None, None, None, 'say "hi"\n'), "n": (None, 3, None, None), "f": (None, None, 2.5, None), "on": (False, None, None, None), "digits": (None, None, None, "12")}


def test_segments_in_any_order_equal_the_batch_fold(spark, tmp_path):
    from vespera.streaming.log_stream import apply_to, folded, stream_log

    segments = {1: [(1, 0, "upsert", 10, [1.0, 0.0], None), (1, 1, "upsert", 11, [0.0, 2.0], None)], 2: [(2, 0, "delete", 10, None, None), (2, 1, "upsert", 12, [1.0, 1.0], None)], 3: [(3, 0, "upsert", 11, [5.0, 5.0], None)]}
    c = Collection(spark, f"file://{tmp_path}/out", "streamed")
    for seq in (3, 2, 1):  # the oldest arrives last
        spark.createDataFrame(segments[seq], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        apply_to(c, stream_log(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/ck").awaitTermination(120)
        if seq == 2:
            c.compact()
    want = {(r.id, *r.vector) for r in folded(spark, f"file://{tmp_path}/in").collect()}
    assert {(r.id, *r.vector) for r in c.documents().collect()} == want == {(11, 5.0, 5.0), (12, 1.0, 1.0)}
    # A repeated micro-batch replaces its own commit.
    rows = c.store.log(1).drop("metric")
    c.append(spark.createDataFrame(rows.collect(), rows.schema), 2, "cosine_distance", replace=True)
    assert {(r.id, *r.vector) for r in c.documents().collect()} == want


def test_file_cards_and_nested_questions(spark, tmp_path):
    for name, data in {"a.txt": b"short", "b.md": b"x" * 3000, "deep/c.py": "é".encode(), "empty": b"", "bin": b"a\0b", "big": b"y" * 131_073, ".env.local": b"K=1", "keys/id_rsa": b"k", "t.pem": b"p", ".aws/config": b"c", "bad.txt": b"ok\xff"}.items():
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path.split(str(tmp_path))[1]: r.card for r in file_cards(spark, f"file://{tmp_path}").collect()}
    assert got == {"/a.txt": "short", "/b.md": "x" * 1100 + "\n...\n" + "x" * 1100, "/deep/c.py": "é", "/bad.txt": "ok�"}
    body = '{"data":[{"title":"t","paragraphs":[{"context":"c one","qas":[{"question":"q1"},{"question":"q2"}]},{"context":"c two","qas":[]}]},{"paragraphs":[{"context":"c one","qas":[{"question":"q3"}]}]}]}'
    contexts, questions = questions_of(spark.createDataFrame([(body,)], "value string"))
    text = {r.ctx: r.text for r in contexts.collect()}
    assert sorted(text.values()) == ["c one", "c two"] and sorted((r.question, text[r.gold]) for r in questions.collect()) == [("q1", "c one"), ("q2", "c one"), ("q3", "c one")]
