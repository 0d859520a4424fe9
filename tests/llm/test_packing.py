"""Packing: every token once, no padding, curve neighbours, exact token ids."""

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vespera.llm import packing
from vespera.llm.packing import Encoder, Packer, curve_keys, hilbert_index, pack, splits_words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_index_visits_every_cell_by_single_steps(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    index = hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert all(np.abs(a - b).sum() == 1 for a, b in pairwise(path))


ENCODER, WHOLE = Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=6), st.sampled_from([" ", "\n", " ", "́", " ", "<|endoftext|>", "it's", "Word.,", "ÉtÉ!!", "a—.", "x×,", "7%", "It'S", "<|ENDOFTEXT|>", "İ", "a.b", "...", "é|", "ΑΣ", "\x1c", "é"])), max_size=12).map("".join))
def test_ids_are_those_of_the_whole_text(text):
    got = np.frombuffer(ENCODER.ids(text.encode()), "<u4").tolist()
    assert got == WHOLE.encode(text, add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("text", ["T\u0308a", "Y\u030ab", "H\u0331i", "J\u030cx", "W\u030aord", "A\u030a,", "I\u0307."])
def test_marks_join_their_letter_before_case_is_dropped(text):
    assert np.frombuffer(ENCODER.ids(text.encode()), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids + [1]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not splits_words(path) and splits_words(PATH)
    text = "It's one  or two\n\n words, <|endoftext|> É"
    assert np.frombuffer(Encoder(path).ids(text.encode()), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [1]


def test_ranges_follow_the_bytes_and_ties_are_split(spark):
    same = [(i, "one text that many rows hold " * 20) for i in range(400)]
    docs = spark.createDataFrame(same, "doc_id long, text string")
    out = pack(docs, PATH, range_bytes=8192).collect()
    task = {}
    for p in out:
        task.setdefault(p.sequence_id >> 40, set()).add(p.doc_id)
    assert len(task) >= 20 and max(map(len, task.values())) < 60 and sum(p.length for p in out) == sum({p.doc_id: p.doc_tokens for p in out}.values())


def test_packer_cuts_what_is_left_at_powers_of_two():
    packer = Packer(7, 16)
    docs = {i: np.arange(n, dtype="<u4").tobytes() for i, n in enumerate([5, 40, 1, 7])}
    pieces = [p for i, d in docs.items() for p in packer.add(i, d)] + list(packer.close())
    sizes = {}
    for doc, start, n, ids, total, seq, offset in pieces:
        assert offset == sizes.get(seq, 0) and ids == docs[doc][4 * start : 4 * (start + n)] and total == len(docs[doc]) // 4
        sizes[seq] = offset + n
    assert list(sizes.values()) == [16, 16, 16, 4, 1]


def test_pack_keeps_every_token_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(9001, None, "x"), (9002, "", "x"), (None, "no id", "x"), (3, " ".join(["word"] * 60_000), "x")], docs.schema)
    docs = docs.where("doc_id <> 3").union(odd)
    rows = pack(docs, PATH, with_ids=True).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    parts, sequences = {}, {}
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        parts.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(parts) == set(text)
    for i, pieces in parts.items():
        ids = [x for _, p, _ in sorted(pieces) for x in p]
        assert ids == WHOLE.encode(text[i], add_special_tokens=False).ids + [1] and {t for *_, t in pieces} == {len(ids)}
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end <= 2048 and end & (end - 1) == 0
    assert pack(docs.limit(0), PATH).count() == 0
    assert pack(docs.select("doc_id", "text").limit(2).union(docs.select("doc_id", "text").limit(2)), PATH).count() >= 4


def test_like_texts_are_neighbours():
    a = [b"the quick brown fox jumps over the lazy dog " * 20 + bytes([97 + i]) for i in range(5)]
    b = ["größe und maß überall schön öfter ".encode() * 20 + bytes([97 + i]) for i in range(5)]
    order = np.argsort(curve_keys([x for p in zip(a, b) for x in p]), kind="stable") % 2
    assert abs(np.diff(order)).sum() == 1


def test_plain_words_skip_the_whole_tokenizer_and_few_are_remembered():
    encoder, asked = Encoder(PATH), []

    class Counted:
        model = encoder.tokenizer.model

        def encode(self, words, **options):
            asked.extend(words)
            return WHOLE.encode(words, **options)

    encoder.tokenizer = Counted()
    text = "Plain words, façade ÉTÉ ÿ straße 12a x’y"
    assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids + [1]
    assert sorted(asked) == sorted([",", "12a", "x’y"])
    assert 2 * packing.CACHE_WORDS <= 250_000


def test_a_batch_becomes_objects_in_slices():
    batch = pa.record_batch([pa.array(range(2000)), pa.array([b"x"] * 2000)], ["doc_id", "text"])
    parts = list(packing._slices([batch]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and max(p.num_rows for p in parts) <= packing.SLICE_ROWS < 2000
