"""Exact dedup against plain grouping, colliding hashes, the directory, and components."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vespera.llm import exact_dedup
from vespera.llm.components import connected_components
from vespera.llm.exact_dedup import Directory, _own, build_directory, deduplicate, duplicate_groups


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def sample():
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice("ab \n\té") for _ in range(rnd.randrange(9)))) for i in range(400)]
    rows += [(1000 + i, "hot text") for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n\x0b\x0c\r"), (2003, "x" * 200_000), (2004, "x" * 100_000 + " " + "x" * 100_000), (2005, "a b"), (2006, "a\xa0b"), (None, "hot  text"), (2007, "a\x1cb")]
    return rows


@pytest.mark.parametrize("poor_hash", [False, True])
def test_groups_equal_plain_grouping(spark, poor_hash):
    rows = sample()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    options = {"hash_of": lambda b: len(b) % 3} if poor_hash else {"bucket_capacity": 20}
    got = duplicate_groups(docs, **options).collect()
    want = brute(rows)
    text = {i: t for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        keep_id, size = want[norm(text[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (keep_id, size, r.doc_id == keep_id)
        assert r.text_sha256 == hashlib.sha256(norm(text[r.doc_id]).encode()).hexdigest()
    kept = deduplicate(docs, **options)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _ in want.values())


def test_chains_compare_bytes(spark):
    """With one hash for all texts the bytes alone tell them apart."""
    rows = [(1, "a"), (2, "a "), (3, "b"), (4, "c"), (5, " c"), (6, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in duplicate_groups(docs, hash_of=lambda b: 0).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1), 4: (5, 2), 5: (5, 2), 6: (6, 1)}


def owned(rows):
    kinds = [("h", pa.int64()), ("body", pa.binary()), ("sha", pa.binary()), ("size", pa.int64()), ("keep_id", pa.string()), ("keep_uid", pa.int64())]
    return [r for b in _own(iter([pa.RecordBatch.from_pylist([dict(zip([k for k, _ in kinds], r)) for r in rows[i : i + 2]], pa.schema(kinds)) for i in range(0, len(rows), 2)])) for r in b.to_pylist()]


def test_owners_walk_chains(monkeypatch):
    sha = lambda b: hashlib.sha256(b).digest()
    rows = [(1, None, sha(b"a"), 2, "k", 5), (1, None, sha(b"b"), 1, None, 6), (1, b"b", None, None, None, None), (1, b"a", None, None, None, None), (1, b"b", None, None, None, None), (2, None, sha(b"c"), 3, "m", 7), (2, b"c", None, None, None, None)]
    got = {(r["h"], r["sha"]): (r["group_size"], r["keep_id"], r["keep_uid"]) for r in owned(rows)}
    assert got == {(1, sha(b"a")): (2, "k", 5), (1, sha(b"b")): (1, None, 6), (2, sha(b"c")): (3, "m", 7)}
    with pytest.raises(ValueError, match="without a text"):
        owned(rows[:3])
    monkeypatch.setattr(hashlib, "sha256", lambda b: hashlib.md5(b""))
    with pytest.raises(ValueError, match="one SHA-256"):
        owned([(1, b"a", None, None, None, None), (1, b"b", None, None, None, None)])


@pytest.mark.parametrize("broadcast", [0, 1_000_000])
def test_keys_are_joined_by_a_shuffle_once_they_are_many(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", broadcast)
    rows = sample()
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, x string")
    got = {r.doc_id: r.keep_id for r in duplicate_groups(docs, bucket_capacity=50).collect()}
    want = brute(rows)
    assert got == {i: want[norm(t)][0] for i, t in rows}
    kept = deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)


def test_rows_that_tie_wholly_leave_one(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = duplicate_groups(docs).collect()
    assert sum(r.kept for r in got) == 3 and len(got) == 5
    assert sorted(map(str, deduplicate(docs).collect())) == sorted(map(str, docs.distinct().collect()))
    assert duplicate_groups(docs.limit(0)).count() == 0 and deduplicate(docs.limit(0)).count() == 0


def test_directory_doubles_where_buckets_are_overfull(spark):
    keys = spark.range(3000).select(F.when(F.col("id") < 2000, F.shiftrightunsigned(F.xxhash64("id"), 3)).otherwise(F.xxhash64("id")).alias("h"))
    directory = build_directory(keys, 100)
    sizes = {r["b"]: r["count"] for r in directory.place(keys).groupBy(F.col("bucket").alias("b")).count().collect()}
    assert max(sizes.values()) <= 100 and len({d for d, _ in directory.leaves}) > 1
    assert sum(2.0**-d for d, _ in directory.leaves) == 1 and sum(sizes.values()) == 3000
    assert Directory(((0, 0),)).place(keys).select("bucket").distinct().collect()[0][0] == 0
    close = spark.range(500).select(F.col("id").alias("h"))  # only the last bits differ
    deep = build_directory(close, 100)
    assert max(d for d, _ in deep.leaves) > 55
    sizes = [r["count"] for r in deep.place(close).groupBy("bucket").count().collect()]
    assert max(sizes) <= 100 and sum(sizes) == 500


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (202, 202), (300, None)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
