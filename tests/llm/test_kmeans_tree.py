"""The k-means tree search against brute force: recall, exact scores, ties, skew, defined cases."""

import numpy as np
import pytest

from vespera.llm.kmeans_tree import Tree, fit_tree, nearest


def brute(vectors, queries, k):
    out = {}
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], float)
    for i, v in queries:
        d = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[i] = [(int(ids[n]), float(d[n])) for n in order if ids[n] != i][:k]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("group_rows", [300, 15])
def test_recall_on_the_test_vectors(spark, group_rows):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    asked = [r for r in rows if r[0] % 100 == 0]
    want = brute(rows, asked, 10)
    got = by_query(nearest(table, table.where("vec_id % 100 = 0"), sample_rows=700, group_rows=group_rows))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hit = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert hit >= 0.9
    x = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0])) and q not in {i for i, _ in near}
        for i, s in near:
            assert np.isclose(s, np.sqrt(((np.array(x[i], float) - np.array(x[q], float)) ** 2).sum()), rtol=1e-12)


def test_ties_copies_and_rows_that_take_no_part(spark):
    same = [1.0, 2.0]
    rows = [(i, same) for i in range(40)] + [(40, [1.0, 2.5]), (41, [3.0, 1.0])]
    odd = [(50, None), (51, [0.0, 0.0]), (52, [1.0, None]), (53, [float("nan"), 1.0]), (54, [float("inf"), 1.0]), (None, same), (55, [1.0]), (3, same)]
    table = spark.createDataFrame([(i, v, 9) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    got = by_query(nearest(table, table.where("vec_id in (0, 5, 39, 40, 50, 51)"), k=3))
    assert {q: [i for i, _ in near] for q, near in got.items()} == {0: [1, 2, 3], 5: [0, 1, 2], 39: [0, 1, 2], 40: [0, 1, 2]}
    assert got[40][0][1] == 0.5
    few = by_query(nearest(table.where("vec_id in (40, 41)"), table.where("vec_id = 40"), k=10))
    assert [i for i, _ in few[40]] == [41]
    assert nearest(table.limit(0), table.limit(0)).count() == 0
    assert nearest(table, table.limit(0)).count() == 0


def test_every_leaf_is_reached_best_bin_first():
    x = np.random.default_rng(1).normal(size=(500, 5))
    tree: Tree = fit_tree(x)
    assert sorted(tree.walk(x[0], 10**6)) == list(range(tree.leaves))
    held = np.zeros(tree.leaves, int)
    held[-1] = 5
    far = tree.walk(x[0], 1, held, 5)
    assert far[-1] == tree.leaves - 1 and len(tree.walk(x[0], 1, held + 5, 5)) == 1
    home = tree.assign(x)
    assert np.bincount(home, minlength=tree.leaves).max() <= 60
    assert np.mean([home[i] in tree.walk(x[i], 3) for i in range(500)]) > 0.95


def test_long_vectors_and_other_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3000))
    table = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "vec_id long, embedding array<double>, leaf string")
    got = by_query(nearest(table, table.where("vec_id = 7"), k=3))
    assert [i for i, _ in got[7]] == [i for i, _ in brute(list(enumerate(x)), [(7, x[7])], 3)[7]]
