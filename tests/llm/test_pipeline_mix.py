"""The packed sequences follow the mix."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_every_stretch_of_sequences_holds_the_sources_at_their_weights(spark):
    rnd = random.Random(4)
    sizes, rows = {"a": 3200, "b": 800, "c": 200}, []
    for source, n in sizes.items():
        pool = ["".join(rnd.choices("aeiou" if source == "a" else "bcdfg" if source == "b" else "xyzwv", k=5)) for _ in range(50)]
        rows += [(len(rows) + i, " ".join(rnd.choices(pool, k=20)), source) for i in range(n)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r[0]: r[2] for r in rows}
    pieces = corpus_pipeline.packed(spark, docs, "", block_chars=1200, run_slots=40).collect()
    order = [source[p.doc_id] for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    assert len(order) == len(rows)
    # Weights go by the square root of the size: 4 to 2 to 1. The least source runs out after 200 * 7 documents.
    for at in range(0, 1200, 400):
        stretch = order[at : at + 400]
        for s, w in (("a", 4 / 7), ("b", 2 / 7), ("c", 1 / 7)):
            assert abs(stretch.count(s) / 400 - w) < 0.09, (at, s, stretch.count(s))
