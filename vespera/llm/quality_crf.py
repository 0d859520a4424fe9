"""Document quality by a linear-chain conditional random field over lines.

Every line has counts of character classes, words and repetitions, and the same figures of the
lines before and after it. A two-state chain (good, bad) is fitted by maximum conditional
likelihood on labelled documents, whose lines take their document's label. Scoring
runs forward-backward over all lines of the whole text; the marginals of "good" are averaged with the
lines' lengths as weights, and a logistic curve fitted on the training documents turns the average
into the probability of label 1.

The training labels are those of documents, so a labelled chain never moves between good and bad; the chain learns how much
neighbouring lines agree, and its marginals smooth lines over their neighbours.

Training reads a bounded sample: at most ``max_docs`` labelled documents (those whose id hashes
lowest), cut into chains of at most ``max_chain`` lines, ``max_lines`` lines in all. Only their
line features reach the driver. Scoring covers every row and whole texts, needs no shuffle
and keeps a slab of about ``SLAB`` characters at a time.

Labels, language, source and id are never inputs of a score. Documents whose
crc32(id as text) mod 5 is 0 are never trained on.

Defined results: null and empty texts are one empty line and get that line's score; repeated
rows get equal scores; without any usable label (or an empty table) every weight is zero and the
score is 0.5; a null id counts as not held out; very long texts are read whole; an empty table gives an empty
result; extra columns, whatever their names, are passed through by :func:`keep_good` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SLAB = 1 << 20
FOLDS = 5
#: Names of a line's own figures, in the order of the columns.
OWN = ("symbols", "upper", "bars", "bangs", "log_length", "repeats", "same_as_before", "stops", "letters_only")
NEAR = ("symbols", "upper", "bars", "bangs", "repeats", "same_as_before", "log_length")
N_FEATURES = len(OWN) + 2 * len(NEAR) + 3

_TABLES: list[np.ndarray] = []


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 65536 its class bits, and a random value for hashing words."""
    if not _TABLES:
        cls = np.zeros(1 << 16, np.uint8)
        for c in range(1 << 16):
            ch = chr(c)
            cls[c] = 1 * ch.isspace() | 2 * ch.isupper() | 4 * ch.isdigit() | 8 * (ch in ".,;:'\"-?()") | 16 * ch.isalpha()
        _TABLES.extend((cls, np.random.default_rng(11).integers(1, 1 << 31, 1 << 16, dtype=np.int64)))
    return _TABLES[0], _TABLES[1]


def _pieces(line: str) -> Iterator[str]:
    """A line in parts of at most SLAB characters, cut at blanks where there are any."""
    while len(line) > SLAB:
        cut = line.rfind(" ", 0, SLAB) + 1 or SLAB
        yield line[:cut]
        line = line[cut:]
    yield line


def _counts(pieces: list[str]) -> np.ndarray:
    """Per piece: characters, symbols, capitals, digits, bars, bangs, words, word characters, repeated words, stops.

    Digits and word lengths are no features: they would mark documents that hold identifiers.
    """
    cls_of, mix = _char_tables()
    cp = np.frombuffer("".join(p + "\n" for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
    start = np.cumsum(size) - size
    low = np.minimum(cp, 65535).astype(np.uint16)
    cls = cls_of[low]
    space = (cls & 1) > 0
    out = np.empty((len(pieces), 10))
    out[:, 0] = size - 1
    for k, hit in enumerate((cls == 0, (cls & 2) > 0, (cls & 4) > 0, low == ord("|"), low == ord("!")), 1):
        out[:, k] = np.add.reduceat(hit, start, dtype=np.int64)
    out[:, 9] = np.add.reduceat(low == ord("."), start, dtype=np.int64)
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    out[:, 7] = np.add.reduceat(solid, start, dtype=np.int64)
    line_of = np.searchsorted(start, at, side="right") - 1
    out[:, 6] = np.bincount(line_of, minlength=len(pieces))
    if len(at):
        word = np.add.reduceat(np.where(solid, mix[low], 0), at)
        twice = np.zeros(len(at), bool)
        twice[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
        out[:, 8] = np.bincount(line_of[twice], minlength=len(pieces))
    else:
        out[:, 8] = 0
    return out


def _own(lines: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Figures of lines (first: whether a line begins its text) and their lengths."""
    pieces: list[str] = []
    line_of: list[int] = []
    for k, line in enumerate(lines):
        for p in _pieces(line):
            pieces.append(p)
            line_of.append(k)
    raw = np.zeros((len(lines), 10))
    lo, size = 0, 0
    for k, p in enumerate(pieces):
        size += len(p) + 1
        if size >= SLAB or k == len(pieces) - 1:
            np.add.at(raw, line_of[lo : k + 1], _counts(pieces[lo : k + 1]))
            lo, size = k + 1, 0
    n, words = np.maximum(raw[:, 0], 1), np.maximum(raw[:, 6], 1)
    before = np.zeros(len(lines))
    before[1:] = [a == b and a != "" for a, b in zip(lines[1:], lines[:-1])]
    before[first] = 0
    x = np.stack([raw[:, 1] / n, raw[:, 2] / n, raw[:, 4] / words, np.minimum(raw[:, 5] / words, 3), np.log1p(raw[:, 0]) / 5, raw[:, 8] / words, before, raw[:, 9] / words, (raw[:, 1] + raw[:, 3] + raw[:, 5] == 0)], 1)
    return x, raw[:, 0]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, lines per text) of all lines of some texts."""
    split = [(t or "").split("\n") for t in texts]
    n = np.fromiter(map(len, split), np.int64, len(split))
    first = np.zeros(n.sum(), bool)
    first[np.cumsum(n) - n] = True
    own, size = _own([x for s in split for x in s], first)
    near = own[:, [OWN.index(c) for c in NEAR]]
    before, after = np.zeros_like(near), np.zeros_like(near)
    before[1:], after[:-1] = near[:-1], near[1:]
    last = np.roll(first, -1)
    before[first] = 0
    after[last] = 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))]), size, n


@dataclass
class Chain:
    """Weights of the two-state chain; state 1 is good. ``curve`` maps log-odds to a probability."""

    w: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] = (1.0, 0.0)

    def marginals(self, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each line the probability of good, the expected moves of all chains, and each chain's log Z."""
        emit = x @ self.w
        order = np.argsort(-n, kind="stable")
        start, long = (np.cumsum(n) - n)[order], n[order]
        steps = int(long[0]) if len(long) else 0
        live = np.searchsorted(-long, -np.arange(steps), side="left")  # chains longer than t
        alpha = np.zeros((len(emit), 2))
        for t in range(steps):
            at = start[: live[t]] + t
            if t:
                prev = alpha[at - 1]
                alpha[at] = np.logaddexp(prev[:, :1] + self.move[0], prev[:, 1:] + self.move[1])
            alpha[at, 1] += emit[at]
        z = np.zeros(len(n))
        z[order] = np.logaddexp(*alpha[start + long - 1].T) if len(n) else 0
        beta = np.zeros((len(emit), 2))
        moves = np.zeros((2, 2))
        z_of = np.repeat(z, n)
        for t in range(steps - 2, -1, -1):
            at = start[: live[t + 1]] + t
            ahead = beta[at + 1].copy()
            ahead[:, 1] += emit[at + 1]
            for a in (0, 1):
                via = self.move[a] + ahead
                beta[at, a] = np.logaddexp(via[:, 0], via[:, 1])
                moves[a] += np.exp(alpha[at, a][:, None] + via - z_of[at][:, None]).sum(axis=0)
        return np.exp(np.clip(alpha[:, 1] + beta[:, 1] - z_of, -700, 0)), moves, z

    def average(self, x: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each text."""
        if not len(n):
            return np.zeros(0)
        p, _, _ = self.marginals(x, n)
        start = np.cumsum(n) - n
        mean = np.add.reduceat(p * (size + 1), start) / np.add.reduceat(size + 1, start)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def score(self, x: np.ndarray, size: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.curve[0] * self.average(x, size, n) + self.curve[1])))


def fit(x: np.ndarray, size: np.ndarray, n: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.15, ridge: float = 2e-3) -> Chain:
    """Maximum conditional likelihood by Adam steps on whole batches; label has one 0/1 per chain."""
    chain = Chain()
    if not len(n) or label.min() == label.max():
        return chain
    y = np.repeat(label, n).astype(float)
    seen = np.zeros((2, 2))
    for c in (0, 1):
        seen[c, c] = (n[label == c] - 1).sum()
    # Every text counts alike for the emissions, however many lines it has; both labels weigh the same.
    weight = np.repeat(1 / n, n) * np.where(y > 0, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    m, v = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for k in range(1, rounds + 1):
        p, moves, _ = chain.marginals(x, n)
        grad = np.concatenate([x.T @ (weight * (p - y)), ((moves - seen) / max(1, n.sum())).ravel()])
        grad += ridge * np.concatenate([chain.w, chain.move.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        chain.w -= step[:N_FEATURES]
        chain.move -= step[N_FEATURES:].reshape(2, 2)
    odds = chain.average(x, size, n)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge logistic curve
        p = 1 / (1 + np.exp(-(a * odds + b)))
        g = np.array([((p - label) * odds).sum() + 0.1 * (a - 1), (p - label).sum() + 0.1 * b])
        s = p * (1 - p) + 1e-6
        h = np.array([[(s * odds**2).sum() + 0.1, (s * odds).sum()], [(s * odds).sum(), s.sum() + 0.1]])
        da, db = np.linalg.solve(h, g)
        a, b = float(np.clip(a - da, 0.05, 5)), float(b - db)
    chain.curve = (a, b)
    return chain


def _features(batches: Iterator[pa.RecordBatch], max_chain: int) -> Iterator[pa.RecordBatch]:
    """Training rows: one for each chain of at most max_chain lines."""
    for batch in batches:
        for label, text, h in zip(*(c.to_pylist() for c in batch.columns)):
            x, size, n = line_features([text])
            rows = range(0, int(n[0]), max_chain)
            cut = [(x[i : i + max_chain], size[i : i + max_chain]) for i in rows]
            yield pa.record_batch([pa.array([h] * len(cut), pa.int64()), pa.array([label] * len(cut), pa.int32()), pa.array([a.astype(np.float32).tobytes() for a, _ in cut], pa.binary()), pa.array([b.astype(np.float32).tobytes() for _, b in cut], pa.binary())], ["h", "label", "x", "size"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4000, max_chain: int = 200, max_lines: int = 100_000) -> Chain:
    """Fit the chain on a bounded sample of the labelled documents that are not held out.

    ``labels`` has (id, quality); other values than 0 and 1 and null ids are left out, and a document with two labels
    takes the lower one.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(fold != 0)
    chosen = marked.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(lambda it: _features(it, max_chain), "h long, label int, x binary, size binary").orderBy("h", "x").limit(max_lines)
    xs, sizes, ns, ys, total = [], [], [], [], 0
    for r in rows.toLocalIterator():
        size = np.frombuffer(r["size"], np.float32)
        total += len(size)
        if total > max_lines:
            break
        xs.append(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES))
        sizes.append(size)
        ns.append(len(size))
        ys.append(r["label"])
    if not ns:
        return Chain()
    return fit(np.concatenate(xs).astype(float), np.concatenate(sizes).astype(float), np.array(ns), np.array(ys))


def _slabs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= SLAB or k == len(texts) - 1:
            yield lo, k + 1
            lo, size = k + 1, 0


def score_texts(chain: Chain, texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts))
    for lo, hi in _slabs(texts):
        out[lo:hi] = chain.score(*line_features(texts[lo:hi]))
    return out


def scored(docs: DataFrame, chain: Chain, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of docs with the column ``name``; one pass, no shuffle."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = score_texts(chain, batch.column(where).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    chain = train(docs, labels, **options)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    out = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), chain).drop("text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text_col: str = "text", **options) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    from vespera.llm.common import fit_name

    name = fit_name(docs, "_score")
    chain = train(docs, labels, text_col=text_col, **options)
    return scored(docs, chain, text_col, name).where(F.col(name) >= threshold).drop(name)
