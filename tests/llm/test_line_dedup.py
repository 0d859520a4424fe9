"""Line chunks: shift resistance, whole passages against plain Python, defined cases."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from vespera.llm.line_dedup import boundaries, chunks, deduplicate_lines, digests

LONG = "one two three four five six seven eight nine ten"


def keys(lines):
    return {k for *_, k in chunks(*digests("\n".join(lines).encode(), 10, xxhash.xxh3_128_digest))}


@settings(max_examples=300, deadline=None)
@given(st.integers(5, 12), st.integers(0, 6), st.integers(0, 6), st.randoms(use_true_random=False))
def test_five_short_lines_hold_a_chunk_wherever_they_stand(n, before, after, rnd):
    line = lambda: f"l{rnd.randrange(10**9)}"
    passage = [line() for _ in range(n)]
    one = keys([line() for _ in range(before)] + passage)
    two = keys([line() for _ in range(3)] + passage + [line() for _ in range(after)])
    assert one & two


def test_boundaries_inside_a_passage_resist_shifts():
    rnd = np.random.default_rng(1)
    passage, short = rnd.integers(0, 2**63, 60, np.uint64), lambda x: np.ones(len(x), bool)
    inside = {e for e in boundaries(passage, short(passage)).tolist() if 1 < e < 57}
    for extra in (1, 2, 7):
        longer = np.concatenate([rnd.integers(0, 2**63, extra, np.uint64), passage, rnd.integers(0, 2**63, 3, np.uint64)])
        assert inside <= {e - extra for e in boundaries(longer, short(longer)).tolist()}
    assert len(inside) > 20 and len(boundaries(passage[:2], short(passage[:2]))) == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 12])
def test_passages_inside_unrelated_lines_go_whole(spark, n):
    """Plain Python knows what was planted: later copies go, the first stays, nothing else changes."""
    rnd = random.Random(n)
    line = lambda words: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(words))
    rows, want = [], {}
    for i in range(0, 60, 2):
        sizes = [rnd.choice([3, 12]) for _ in range(n)]
        if n < 5:
            sizes[rnd.randrange(n)] = 12  # fewer than five lines need a long one
        passage = [line(s) for s in sizes]
        a, b, c, d = ([line(rnd.choice([3, 12])) for _ in range(5)] for _ in range(4))
        rows += [(i, "\n".join(a + passage + b)), (i + 1, "\n".join(c + passage + d))]
        want |= {i: rows[-2][1], i + 1: "\n".join(c + d)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in deduplicate_lines(docs).collect()} == want


def test_parts_of_a_long_passage(spark):
    """Every document holds a stretch of one passage, none the whole of it: each line stays once at least, copies go."""
    rnd = random.Random(8)
    passage = [f"short line {k}" if k % 4 else f"{LONG} {k}" for k in range(40)]
    rows = []
    for i in range(40):
        a = rnd.randrange(30)
        rows.append((i, "\n".join([f"own {i} a", *passage[a : a + rnd.randrange(6, 11)], f"own {i} b"])))
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_lines int")
    out = deduplicate_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "_n_lines", "n_removed"]
    got = {r.doc_id: r.text.split("\n") for r in out.collect()}
    left = [x for lines in got.values() for x in lines if x in passage]
    seen = {x for _, t in rows for x in t.split("\n") if x in passage}
    assert set(left) == seen and all(f"own {i} {s}" in got[i] for i in got for s in "ab")
    before = sum(x in passage for _, t in rows for x in t.split("\n"))
    assert got[0] == dict(rows)[0].split("\n") and len(left) < before / 2


def test_defined_cases(spark):
    rows = [(1, f"a\n\n{LONG}\n\nb"), (1, f"a\n\n{LONG}\n\nb"), (2, f"c\n\n{LONG}\n \nd"), (3, "\n\n\n"), (4, "\n\n\n"), (5, f"{LONG}!\nx"), (6, None), (7, ""), (8, "\n".join(["ä"] * 20_000)), (9, "word " * 60_000 + "\nend"), (10, "word " * 60_000 + "\nend!"), (None, f"{LONG}!\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in deduplicate_lines(docs, counts=None).collect()), key=str)
    changed = {2: "c\n\nd", 6: "", 8: "\n".join("ä" * 7), 10: "end!", None: "y"}
    assert got == sorted(((i, changed.get(i, t)) for i, t in rows), key=str)
    assert deduplicate_lines(docs.limit(0)).count() == 0


def test_keys_of_different_bytes_remove_nothing(spark):
    rows = [(1, f"{LONG} a\nx"), (2, f"{LONG} b\nx"), (3, "other words here, ten or more of them in one line, all alone"), (4, "other words here, ten or more of them in one line, all alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = deduplicate_lines(docs, counts=None, digest=lambda b: b[:30].ljust(16)[:16] if len(b) > 40 else xxhash.xxh3_128_digest(b))
    assert sorted((r.doc_id, r.text) for r in weak.collect()) == [*rows[:3], (4, "")]
