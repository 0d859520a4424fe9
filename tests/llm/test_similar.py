"""Near copies by Jaccard similarity on five words, against brute force."""

import random

import pytest

from vespera.llm import similar
from vespera.llm.simhash import deduplicate
from vespera.llm.similar import near_groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_pairs_at_080_are_caught_and_those_below_stay(spark):
    rnd = random.Random(8)
    rows, close = [], 0
    for i in range(0, 400, 2):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
        other = list(base)
        for at in range(10, 300, 300 // (6 if i < 200 else 12)):  # about 0.82 and 0.66
            other[at] = "changed"
        rows += [(i, " ".join(base)), (i + 1, " ".join(other))]
        close += jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert close == 100
    caught = sum(i + 1 not in left for i in range(0, 200, 2))
    assert caught >= 98, caught
    assert {i for i, _ in rows if i >= 200 or i % 2 == 0} <= left


def test_chains_nulls_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[k:] + [f"x{i}" for i in range(k)]) for k in range(0, 60, 6)]  # each like the next
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(20, None, 1), (21, "", 1), (None, texts[0], 1), (30, "alone", 1), (30, "alone", 1), (31, "ALONE", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = deduplicate(docs, width=5, similarity=0.8)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 20, 30, 30]
    assert deduplicate(docs.limit(0), width=5, similarity=0.8).count() == 0


def test_fingerprints_alone_link_very_near_copies(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(0, 60, 2):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(3000)]
        rows += [(i, " ".join(base)), (i + 1, " ".join([*base, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_groups(docs, by_bands=False).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, 60, 2)) >= 28 and len(set(got.values())) >= 30


def exact_groups(texts, similarity=0.8):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    name = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]) and name[i] != name[j]:
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    return name


def test_links_between_texts_that_their_bucket_s_first_is_unlike(spark):
    """Two like texts share every bucket with texts of lower ids that are like neither."""
    rnd = random.Random(10)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (8, 40, 300):
        for _ in range(12):
            base = words(n)
            apart = [base[: n // 2] + words(n // 2), words(n // 2) + base[n // 2 :]]
            other = list(base)
            other[-1] = "end"
            texts += [*map(" ".join, apart), " ".join(base), " ".join(other)]
    base = words(100)
    texts += [" ".join(base + words(4 * k)) for k in range(30)] + ["", None, "  ", "one", "ONE x", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_groups(docs, by_fingerprint=False).collect()}
    assert [got[i] for i in range(len(texts))] == exact_groups(texts)


def test_no_pair_at_the_threshold_is_left_to_chance(spark):
    """1500 pairs just above 0.8, of which 24 bands of 6 minima leave some out; and as many below."""
    rnd = random.Random(11)
    rows = []
    for i in range(0, 6000, 2):
        base = [f"w{rnd.randrange(10**7)}" for _ in range(49)]  # 45 shingles: 40 of 50 in common is 0.8, 39 of 51 less
        other = base[5:] + [f"n{k}" for k in range(5)] if i < 3000 else base[6:] + [f"n{k}" for k in range(6)]
        rows += [(i, " ".join(base)), (i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_groups(docs, by_fingerprint=False).collect()}
    assert [got[i] == got[i + 1] for i in range(0, 6000, 2)] == [True] * 1500 + [False] * 1500


@pytest.mark.parametrize("few", [64, 3])
def test_a_large_group_of_near_copies_makes_no_row_for_each_pair(spark, monkeypatch, few):
    """400 copies of 200 words with three or two of them changed: pairs below 0.8 (0.73) and above (0.81), all in the same buckets."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    texts = []
    for _ in range(400):
        text = list(base)
        for at in rnd.sample(range(200), rnd.choice([3, 3, 3, 2])):
            text[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, whole = {}, similar.keep

    def counted(df, name):
        out = whole(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "keep", counted)
    monkeypatch.setattr(similar, "FEW_ROWS", few, raising=False)
    got = {r.doc_id: r.component_id for r in near_groups(docs, by_fingerprint=False).collect()}
    want = exact_groups(texts)
    assert [got[i] for i in range(400)] == want
    assert max(made.values()) < 40 * 400, made
