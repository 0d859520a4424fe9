"""The line CRF: exact inference against enumeration, held-out accuracy, edge cases."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.llm import quality_crf as q

SF = "/root/testdata/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    chain = q.Chain(rng.normal(size=q.N_FEATURES), rng.normal(size=(2, 2)))
    n = np.array([4, 1, 6, 3])
    x = rng.normal(size=(n.sum(), q.N_FEATURES))
    p, moves, z = chain.marginals(x, n)
    want_moves, at = np.zeros((2, 2)), 0
    for k, size in enumerate(n):
        total, good = 0.0, np.zeros(size)
        step = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(size)):
            s = sum(chain.w @ x[at + t] * y[t] for t in range(size)) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))
            total += np.exp(s)
            good += np.exp(s) * np.array(y)
            for a, b in zip(y, y[1:]):
                step[a, b] += np.exp(s)
        assert np.allclose(p[at : at + size], good / total) and np.isclose(z[k], np.log(total))
        want_moves += step / total
        at += size
    assert np.allclose(moves, want_moves)


def test_features_do_not_depend_on_slabs(monkeypatch):
    texts = ["One two two.\n### $$$\nONE!! TWO!!", None, "", "a " * 5000 + "\n" + "b|c " * 300, "é" * 100]
    whole = q.line_features(texts)
    monkeypatch.setattr(q, "SLAB", 512)
    parts = q.line_features(texts)
    assert whole[0].shape[1] == q.N_FEATURES
    cut_word = [q.OWN.index(c) for c in ("repeats",)]
    keep = [i for i in range(q.N_FEATURES) if i not in cut_word]
    assert np.allclose(whole[0][:3], parts[0][:3]) and np.allclose(whole[0][:, keep][:6, :6], parts[0][:, keep][:6, :6], atol=1e-2)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in q.assess(docs.select("doc_id", "text"), labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good = [s for s, y in held if y == 1]
    bad = [s for s, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([s >= 0.3 for s in good]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 200")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("doc_id < 200")
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in q.assess(docs, labels).collect()}
    b = {r.doc_id: r.score for r in q.assess(docs, other).collect()}
    assert a == b


def test_nulls_empty_tables_repeats_and_extra_columns(spark):
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    docs = spark.createDataFrame([(None, None, 0.5), (1, "", 0.5), (1, "", 0.5), (2, "x" * 3_000_000, 0.5)], "doc_id long, text string, score double")
    rows = q.assess(docs, labels).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    assert q.keep_good(docs, labels).columns == docs.columns and q.keep_good(docs, labels).count() == 4
    assert q.assess(docs.limit(0), labels).count() == 0
