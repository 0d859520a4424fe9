"""Pfair mixing: releases and deadlines met, deviation under a block, all documents mixed once."""

import random

import pytest

from vespera.llm.mixing import interleave, mix, schedule, shares


def slow_schedule(share, period):
    given = [0] * len(share)
    out = []
    for t in range(period):
        _, i = min((-(-(g + 1) * period // s), i) for i, (g, s) in enumerate(zip(given, share)) if g * period // s <= t)
        out.append((i, given[i], t))
        given[i] += 1
    return out


@pytest.mark.parametrize("share", [[500, 250, 125, 60, 30, 20, 10, 5], [1000], [1] * 7 + [993], [333, 333, 334]])
def test_schedule_is_earliest_deadline_first_within_a_block(spark, share):
    table = spark.createDataFrame([(i, s) for i, s in enumerate(share)], "rank int, share int")
    got = sorted(((r["rank"], r.turn, r.slot) for r in schedule(table, 1000).collect()), key=lambda x: x[2])
    assert got == slow_schedule(share, 1000)
    given = [0] * len(share)
    for rank, turn, slot in got:
        assert turn * 1000 // share[rank] <= slot < -(-(turn + 1) * 1000 // share[rank])
        given[rank] += 1
        assert all(abs(g - (slot + 1) * s / 1000) < 1 for g, s in zip(given, share))


def test_shares_sum_to_the_period(spark):
    sizes = spark.createDataFrame([(None, 10), ("", 5), ("a", 10**9), ("b", 1)], "source string, size long")
    for weights in (None, {"a": 0.1, "b": 0.7}):
        rows = shares(sizes, weights, 0.5, 1000).collect()
        assert sum(r.share for r in rows) == 1000 and min(r.share for r in rows) >= 1
        assert [r.source for r in sorted(rows, key=lambda r: r["rank"])] == [None, "", "a", "b"]


def test_mix_deviates_by_less_than_a_block_and_keeps_all(spark):
    rnd = random.Random(4)
    rows = [(i, "hot" if i % 3 else rnd.choice("abc"), "x" * rnd.randrange(200)) for i in range(3000)]
    rows += [(None, None, None), (5, "a", "again"), (6, "", "y" * 50_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, slot int")
    weights = {"hot": 0.4, "a": 0.3, "b": 0.2, "c": 0.1}
    got = sorted(mix(docs, weights, block_chars=1000, period=100, range_chars=20_000).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    assert sorted((str(r.doc_id), str(r.source)) for r in got) == sorted((str(i), str(s)) for i, s, _ in rows)
    assert [r.slot for r in got] == sorted(r.slot for r in got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    # Blocks given by each slot, while every source still has some.
    share = {r.source: r.weight for r in got}
    last = {s: max(r.slot for r in got if r.source == s) for s in share}
    for t in range(0, min(last[s] for s in ("hot", "a", "b", "c")) + 1):
        for s in ("hot", "a", "b", "c"):
            given = len({r.block for r in got if r.source == s and r.slot <= t})
            top = max([r.block for r in got if r.source == s and r.slot <= t], default=0)
            assert given <= top and abs(top - (t + 1) * share[s]) < 1 + (top - given)
    again = mix(docs, weights, block_chars=1000, period=100, range_chars=10**9)
    assert {(r.doc_id, r.source, r.position) for r in again.collect() if r.doc_id != 5} == {(r.doc_id, r.source, r.position) for r in got if r.doc_id != 5}


def test_interleave_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", 3), (1, "a", "x", 3), (None, None, None, None), (2, "b", "y", 4)], "doc_id long, source string, text string, position int")
    out = interleave(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert interleave(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    many = spark.createDataFrame([(i, f"s{i}", "x") for i in range(9)], "doc_id long, source string, text string")
    with pytest.raises(ValueError, match="too short"):
        mix(many, period=17)
    got = mix(many, period=18).collect()
    assert sorted(r.position for r in got) == list(range(9)) and {r.weight for r in got} == {2 / 18}


def test_rows_without_id_are_placed_by_their_texts(spark):
    docs = spark.createDataFrame([(None, "a", f"text {i}") for i in range(500)], "doc_id long, source string, text string")
    got = mix(docs, block_chars=500, range_chars=200).collect()
    assert sorted(r.position for r in got) == list(range(500)) and len({r.block for r in got}) > 5
