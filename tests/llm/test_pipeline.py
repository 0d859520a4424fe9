"""The pipeline against its stages' own brute-force rules on a small table."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vespera.llm import quality_crf

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_hand_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact", "near", "mixing", "packing"]
    now, left = docs, set(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(got) and set(got) <= left and all(got[i] == rows[i] for i in got)
        if name == "exact":
            assert {"".join(rows[i].text.split()) for i in left} == {"".join(r.text.split()) for r in got.values()}
            assert len({"".join(r.text.split()) for r in got.values()}) == len(got)
        if name == "mixing":
            assert set(got) == left
        now, left = spark.createDataFrame(list(got.values()), docs.schema), set(got)
    assert len(left) > len(rows) / 2
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(tok.encode(rows[i].text, add_special_tokens=False).ids) + 1 for i in left}
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == want and good


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "a fair text of some plain words that say what there is to say "


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names, empty tables."""
    rows = [(i, PROSE * 3 + f"number {i} of many", "en", "s", 10) for i in range(6)]
    rows += [(10, None, None, None, None), (11, "", "en", "s", 0), (None, PROSE + "no id", "en", None, 1), (12, PROSE * 20_000, "en", "s", 1)]
    rows += [rows[0], rows[0], (20, rows[1][1].replace(" ", "\n"), "en", "s", 10), (21, rows[2][1] + " more", "en", "t", 10)]
    labels = spark.createDataFrame([(i, 1, None) for i in range(4)] + [(10, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SHAPE)
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and good.subtract(docs).count() == 0
    extra = docs.selectExpr("*", "1 as h", "2 as sha", "3 as x", "4 as tkey", "5 as component_id", "6 as slot", "7 as run", "8 as score")
    exact = corpus_pipeline.exact(spark, extra, "")
    assert exact.columns == extra.columns
    stay = ["0", "1", "10", "12", "2", "21", "3", "4", "5", "None"]  # 20 equals 1, 11 equals 10, 0 comes three times
    assert ids(exact) == stay
    near = corpus_pipeline.near(spark, exact, "")
    left = ids(near)
    assert near.columns == extra.columns and left == [i for i in stay if i != "21"]
    mixed = corpus_pipeline.mixed(spark, near, "")
    assert mixed.columns == extra.columns and ids(mixed) == left
    pieces = corpus_pipeline.packed(spark, mixed, "").collect()
    assert {str(p.doc_id) for p in pieces} == set(left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_quality_and_near_equal_plain_rules(spark):
    """The kept rows are those that score 0.3, and of each group at Jaccard 0.8, all pairs compared, the least id."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in quality_crf.assess(docs.select("doc_id", "text"), labels).collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).collect()} == {i for i, s in score.items() if s >= 0.3}
    rows = {r.doc_id: r.text.split() for r in docs.collect()}
    sets = {i: {tuple(x.lower() for x in w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in rows.items()}
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == {root(i) for i in sets}


def test_run_equals_its_last_stage_written(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and set(out.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
