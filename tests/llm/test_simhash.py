"""SimHash fingerprints and the trie self-join against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vespera.llm import simhash


def slow_fingerprint(text, width=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    for ch in "\t\n\x0b\x0c\r":
        words = words.replace(ch, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, budget=4):
    """rows: (id, fingerprint); the least id reachable from each row."""
    name = {i: i for i, _ in rows}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and (a ^ b).bit_count() <= budget:
                x, y = sorted((find(i), find(j)))
                name[y] = x
    return {i: find(i) for i, _ in rows}


def test_trie_links_span_the_components_of_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 150, dtype=np.int64).astype(np.uint64)
    keys = [base]
    for _ in range(5):
        near = base.copy()
        for _ in range(4):
            near ^= np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
        keys.append(near)
    keys = np.unique(np.concatenate(keys))
    links = simhash.trie_links(keys)
    assert all((int(keys[a]) ^ int(keys[b])).bit_count() <= 4 for a, b in links)
    rows = [(i, int(k)) for i, k in enumerate(keys)]
    name = {i: i for i in range(len(keys))}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        name[y] = x
    assert {i: find(i) for i in name} == slow_components(rows)


@pytest.mark.parametrize("keys,blocks,bits", [(10**6, 1, 12), (10**9, 2, 20), (10**12, 3, 27), (5 * 10**13, 4, 32)])
def test_covers_grow_with_the_keys_and_lose_no_pair(keys, blocks, bits):
    choices = simhash.cover(keys, 4, 20_000)
    assert all(len(top) == blocks and sum(w for _, w in top) >= bits and sorted(top + rest)[0][0] == 0 and sum(w for _, w in top + rest) == 64 for top, rest in choices)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.int64).astype(np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    agree = np.zeros(500, bool)
    for top, rest in choices:
        depth = np.uint64(64 - sum(w for _, w in top))
        agree |= simhash._turn(a, top + rest) >> depth == simhash._turn(b, top + rest) >> depth
    assert agree.all()


@pytest.mark.parametrize("group_rows,keys", [(20_000, None), (3, None), (20_000, 10**10)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, group_rows, keys):
    if keys:
        whole = simhash.cover
        monkeypatch.setattr(simhash, "cover", lambda n, budget, rows: whole(keys, budget, rows))
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "One", "one two THREE", "x" * 30_000, "é ß Ä"] + ["one two three four five"] * 3
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(150)]
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            near[rnd.randrange(150)] = "changed"
            texts.append("\n".join(near))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs, group_rows=group_rows).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: p for i, (p, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == slow_components(list(prints.items()))
    kept = simhash.deduplicate(docs, group_rows=group_rows)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}


def test_empty_table_nulls_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (9, "p q r s t u")], "doc_id long, text string")
    got = sorted((r.doc_id is not None and r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 3), (3, 3), (3, 3), (9, 9)]
    none = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert simhash.near_duplicates(none).first().component_id is None
    assert simhash.deduplicate(none).count() == 1


def test_hot_star_of_near_copies_keeps_few_links(spark):
    keys = spark.createDataFrame([(1 << b,) for b in range(60)], "fp long")
    links = simhash.trie_self_join(keys, group_rows=10).distinct()
    assert 59 <= links.count() < 60 * 59 // 2
