"""Packing documents into training sequences along a space-filling curve.

Order. Each document becomes a vector of hashed byte 4-gram counts, which fixed random directions project to
four numbers; those, as a point of a grid, have a place on the Hilbert curve. Spark range-sorts
by that key (ties by a hash of the id, so that many equal documents spread over tasks), and
neighbours on the curve, whose texts are alike, are packed next to each other. The ranges' bounds are
quantiles, by bytes, of a sample of rows (``PER_RANGE`` for each range, ``SAMPLE_ROWS`` at least), as in any
range sort; every row is placed by them.

Packing. Within each range the documents' token ids, each followed by the end id, are laid end to end and
cut at every ``length`` tokens. What is left at the end of a range is cut into sequences
whose lengths are powers of two, so no sequence needs padding. Each id lies in exactly one piece.

Scale. One range shuffle of the texts, into ranges of about ``range_bytes`` of text; a task streams its range and
holds one sequence and one document at a time, with a bounded cache of words already encoded. A sequence's number is
the task's number and a running number, so a repeated task gives the same sequences.

Defined results: null and empty texts are documents of one token (the end id); repeated rows are packed
each; a null id is kept; very long texts span sequences; an empty table gives no pieces; other columns than id and
text are not read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import small

DIMS, BITS = 4, 8
BINS = 1 << 9
END_ID = 1
#: Words and stems that a worker remembers: two generations of each, of this many.
CACHE_WORDS = 100_000
#: Documents of a batch whose texts and vectors are held at once.
SLICE_ROWS = 512
CHUNK = 1 << 20
#: Rows of the sample that bounds the ranges: at least so many, and so many for each range.
SAMPLE_ROWS, PER_RANGE = 20_000, 20


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of a grid of 2**bits per dimension.

    Walks from the coarsest bit to the finest: each level undoes the reflection or exchange that
    the curve's orientation there implies, then the Gray code of the interleaved bits is read off.
    """
    x = points.astype(np.uint64).copy()
    dims = x.shape[1]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for d in range(dims):
            on = (x[:, d] & bit) > 0
            x[on, 0] ^= low
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= swap
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip ^= np.where((x[:, dims - 1] & bit) > 0, bit - one, np.uint64(0))
    x ^= flip[:, None]
    out = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << one) | ((x[:, d] >> np.uint64(level)) & one)
    return out.astype(np.int64)


_DIRECTIONS: list[np.ndarray] = []


def directions() -> np.ndarray:
    if not _DIRECTIONS:
        _DIRECTIONS.append(np.random.default_rng(17).choice([-1.0, 1.0], (BINS, DIMS)))
    return _DIRECTIONS[0]


def document_vector(text: bytes) -> np.ndarray:
    """Hashed counts of the byte 4-grams of the whole text."""
    out = np.zeros(BINS)
    raw = np.frombuffer(text.ljust(4, b" "), np.uint8)
    for i in range(0, len(raw) - 3, CHUNK):
        a = raw[i : i + CHUNK + 3].astype(np.uint32)
        gram = a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)
        out += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(23), minlength=BINS)
    return out


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of some documents: square-rooted counts, unit length, projected and spread evenly."""
    if not texts:
        return np.zeros(0, np.int64)
    v = np.empty((len(texts), BINS))
    for i, t in enumerate(texts):
        v[i] = document_vector(t)
    np.sqrt(v, out=v)
    out = (v @ directions()) / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    even = 1 / (1 + np.exp(-1.7 * out))  # near the normal distribution function
    return hilbert_index(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class _Generations:
    """A bounded memory: what is not asked for during a whole generation is forgotten."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: Iterable[bytes]) -> list[bytes]:
        """The keys (each once) that are not known; known ones are in ``young`` afterwards."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old, out = self.young, self.old, []
        for k in set(keys).difference(young):
            if (v := old.get(k)) is not None:
                young[k] = v
            else:
                out.append(k)
        return out


#: What normalises and splits texts in the kind of tokenizer whose words are encoded one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Plain punctuation after a letter or digit: no token holds both, so a word is cut between them.
_PUNCTUATION = b".,;:!?|%#$&*"
_LETTERS = frozenset(bytes([0xC3, x]) for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))
#: Words of small Latin letters: nothing in them is normalised or split, so they go to the tokenizer's model, spelled in
#: the characters that stand for their bytes there.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_SPELLED = {ord(b.decode()): "\u00c3" + chr(b[1] if b[1] > 0xA0 and b[1] != 0xAD else 0x143 if b[1] == 0xAD else b[1] + 0xA2) for b in _LETTERS}


def splits_words(path: str) -> bool:
    """Whether a tokenizer file never joins letters, digits, punctuation or white space in one token."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    pre = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = pre[0].get("pattern") == {"Regex": SPLIT} and pre[0].get("behavior") == "Removed" and pre[0].get("invert") is True
    levels = len(pre) == 2 and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in pre[1:])
    specials = all(x["content"].startswith("<|") and not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]) for x in d.get("added_tokens") or ())
    return split and levels and specials and (d.get("normalizer") or {}).get("normalizers") == NORMALIZERS


class Encoder:
    """Token ids of whole texts.

    Where white space ends every token, letters and punctuation are never in one token and letter case is
    ignored (:func:`splits_words`), words, and below them their stems, are encoded once and remembered. A text of any
    other tokenizer is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), splits_words(path)
        self.words, self.stems = _Generations(CACHE_WORDS), _Generations(CACHE_WORDS)

    def ids(self, text: bytes) -> bytes:
        """The ids as little-endian 32-bit numbers, the end id included."""
        end = END_ID.to_bytes(4, "little")
        if not self.by_word:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes() + end
        words = text.split()
        if new := self.words.missing(words):
            self._learn(new)
        return b"".join([*map(self.words.young.__getitem__, words), end])

    def _learn(self, words: list[bytes]) -> None:
        stems, tails = [], []
        for w in words:
            stem = w
            if b"<|" not in w:
                stem = w.rstrip(_PUNCTUATION)
                if not (stem[-1:].isalnum() or stem[-2:] in _LETTERS):
                    stem = w
                elif stem.isascii():
                    stem = stem.lower()  # beyond ASCII a mark may join its letter before case is dropped
            stems.append(stem)
            tails.append(w[len(stem) :])
        new = self.stems.missing(p for pair in (stems, tails) for p in pair if p)
        known, other, one = self.stems.young, [], self.tokenizer.model.tokenize
        for w in new:
            text = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(small := text.lower()):
                known[w] = b"".join([t.id.to_bytes(4, "little") for t in one(small if w.isascii() else small.translate(_SPELLED))])
            else:
                other.append((w, text))
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            whole = self.tokenizer.encode([text for _, text in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(whole.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(whole.word_ids, np.int64), np.arange(len(part)), side="right") * 4
            at = 0
            for (w, _), end in zip(part, ends.tolist()):
                known[w] = ids[at:end]
                at = end
        young = self.words.young
        for w, stem, tail in zip(words, stems, tails):
            young[w] = known[stem] + known[tail] if tail else known[stem]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A worker's encoder outlives its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Lays documents end to end; gives out pieces once their sequence is full."""

    def __init__(self, first_sequence: int, length: int):
        self.sequence, self.length = first_sequence, length
        self.held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of the open sequence
        self.fill = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total = len(ids) // 4
        at = 0
        while at < total:
            take = min(self.length - self.fill, total - at)
            self.held.append((doc_id, at, ids[4 * at : 4 * (at + take)], total))
            self.fill += take
            at += take
            if self.fill == self.length:
                yield from self._give(self.held)
                self.held, self.fill = [], 0

    def _give(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc_id, start, n, ids, total, self.sequence, offset
            offset += n
        self.sequence += 1

    def close(self) -> Iterator[tuple]:
        """The rest, in sequences whose lengths are powers of two."""
        rest = self.held[::-1]
        left, self.held, self.fill = self.fill, [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            part: list[tuple] = []
            while size:
                doc_id, start, ids, total = rest.pop()
                n = len(ids) // 4
                if n > size:
                    rest.append((doc_id, start + size, ids[4 * size :], total))
                    ids, n = ids[: 4 * size], size
                part.append((doc_id, start, ids, total))
                size -= n
            yield from self._give(part)


FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A worker keeps what its largest batch took, so few rows become Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)


def _pack(batches: Iterator[pa.RecordBatch], path: str, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    packer = Packer(TaskContext.get().partitionId() << 40, length)
    names = [*FIELDS, "ids"] if with_ids else list(FIELDS)
    kind = pa.int64()

    def out(pieces: list[tuple]) -> pa.RecordBatch:
        doc, start, n, ids, total, sequence, offset = zip(*pieces)
        cols = [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        return pa.record_batch(cols, names)

    pieces: list[tuple] = []
    size = 0
    for batch in _slices(batches):
        kind = batch.column(0).type
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in packer.add(doc_id, encoder_of(path).ids(text or b"")):
                pieces.append(piece)
                size += piece[2]
                if size >= CHUNK:
                    yield out(pieces)
                    pieces, size = [], 0
    pieces += packer.close()
    if pieces:
        yield out(pieces)


def _keyed(batches: Iterator[pa.RecordBatch], cuts: list[tuple] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, run, spread) with their place on the curve and, between cuts, their range."""
    for batch in _slices(batches):
        texts = batch.column(1).to_pylist()
        keys = curve_keys([t or b"" for t in texts])
        run, spread = (batch.column(k).to_pylist() for k in (2, 3))
        if cuts is None:
            yield pa.record_batch([batch.column(2), pa.array(keys), batch.column(3), pa.array([len(t or b"") + 1 for t in texts], pa.int64())], ["run", "curve", "spread", "size"])
        else:
            part = [bisect_right(cuts, x) for x in zip(run, keys.tolist(), spread)]
            yield pa.record_batch([*batch.columns, pa.array(keys), pa.array(part, pa.int32())], [*batch.schema.names, "curve", "part"])


def range_cuts(rows: DataFrame, range_bytes: int, max_ranges: int, placed: Callable[[DataFrame], DataFrame]) -> list[tuple]:
    """Where ranges of about ``range_bytes`` end: (run, curve, spread) of sampled rows, by their bytes.

    ``placed`` gives rows their run and spread; only the sample passes through it here.
    """
    total, wanted = rows.count(), SAMPLE_ROWS
    while True:
        share = min(1.0, wanted / max(1, total))
        sample = rows if share == 1 else rows.sample(share, seed=7)
        found = placed(sample).mapInArrow(_keyed, "run long, curve long, spread long, size long").toArrow()
        keys = sorted(zip(*(c.to_pylist() for c in found.columns)))
        size = np.cumsum([k[3] for k in keys], dtype=float)
        ranges = int(min(size[-1] / share / range_bytes, max_ranges)) + 1 if len(keys) else 1
        if share == 1 or ranges * PER_RANGE <= wanted:
            break
        wanted = ranges * PER_RANGE
    ranges = max(ranges, min(rows.sparkSession.sparkContext.defaultParallelism, len(keys)))
    at = np.searchsorted(size, size[-1] / ranges * np.arange(1, ranges)) if len(keys) else []
    return sorted({keys[i][:3] for i in at})


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, runs: DataFrame | None = None, range_bytes: int = 16 << 20, max_ranges: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer`` is the path of a tokenizer file that every executor can read. ``runs`` (id, run: one row for each
    id, null ones too; a written table) gives whole numbers that come before the place on the curve, as the runs of a mix. Ranges outgrow
    ``range_bytes`` only once there are ``max_ranges``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spread = F.xxhash64("doc_id").alias("spread")

    def placed(part: DataFrame) -> DataFrame:
        if runs is None:
            return part.select("doc_id", "text", F.lit(0).cast("long").alias("run"), spread)
        of = small(runs.select(F.col(runs.columns[0]).cast("long").alias("_id"), F.col(runs.columns[1]).cast("long").alias("run")))
        return part.join(of, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "run", spread)

    cuts = range_cuts(rows, range_bytes, max_ranges, placed)
    keyed = placed(rows).mapInArrow(lambda it: _keyed(it, cuts), "doc_id long, text binary, run long, spread long, curve long, part int")
    ordered = keyed.repartitionById(len(cuts) + 1, "part").sortWithinPartitions("run", "curve", "spread", "doc_id").select("doc_id", "text")
    schema = ", ".join(f"{n} long" for n in FIELDS) + (", ids array<int>" if with_ids else "")
    return ordered.mapInArrow(lambda it: _pack(it, tokenizer, length, with_ids), schema)
