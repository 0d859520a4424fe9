"""SimHash near-duplicates by a binary trie self-join.

Fingerprints. A text is lower-cased (A-Z), cut into words at white space and into shingles of
four words (the whole sequence when it is shorter); bit b of the 64-bit fingerprint is 1 when
more than half of the shingles' XXH64 hashes (seed 42) have it. No word: fingerprint zero.

Self-join. Equal fingerprints are one key of the join, so copies cost one row. Seen as strings
of 64 bits the keys form a binary trie. Two nodes of one level are traversed together, their
differing bits are accumulated, and a pair of nodes is pruned once it exceeds the budget.
To spread the traversal over tasks the 64 bits are cut into blocks, and the trie is built once for each choice of
blocks brought to the top: of five blocks a pair within four bits agrees wholly in at least one, of six in two, of seven in
three. So under each choice only node pairs (x, x) are followed through the top blocks, every subtree below them is one
task's work, and no pair is lost. Blocks are as many as keep subtrees small: 5 copies of a key up to 1.6e8 keys (8192
subtrees a choice), 15 up to 2e10 (2**20), 35 up to 2e12 (2**27).

Skew. A subtree that still has more than ``group_rows`` keys is dealt over pairs of salted parts, all
pairs of which are traversed. Within a subtree only links that join two components
so far apart are emitted (a spanning forest), never all pairs of a group.

Near copies of some similarity. ``deduplicate(..., similarity=0.8)`` asks for the Jaccard similarity of shingle sets. Four
bits find few pairs at 0.8 (about ten bits apart), and no cover of 64 bits reaches ten errors without comparing most keys; so the
trie's links are joined there by all pairs that share a rare shingle, and all are decided by their shingle sets (similar.py).

Defined results: null and empty texts have fingerprint zero and link like any other; repeated
rows keep their own row; a null doc_id is never a component's name unless nothing else
is there; very long texts are read whole; an empty table gives an empty result; extra columns, whatever their
names, are passed through by :func:`deduplicate` and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import Kept, fit_name, keep, small
from vespera.llm.components import connected_components

SEED = 42
CHUNK = 1 << 15
LEAF = 64


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[min(width, len(words)) - 1 :])]), ">u8")


def fingerprint_of(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    return fingerprint_of(shingle_hashes(text, width))


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "fp"])


Block = tuple[int, int]


def cover(keys: int, budget: int, group_rows: int) -> list[tuple[list[Block], list[Block]]]:
    """Choices of blocks (first bit from the top, width) that are brought to the top, each with the blocks left over.

    A pair within the budget agrees in all top blocks of at least one choice. As many blocks are taken as leave
    about ``group_rows`` of ``keys`` in a subtree.
    """
    for agree in range(1, 9):
        count = budget + agree
        ends = [64 * i // count for i in range(count + 1)]
        if keys >> (agree * (64 // count)) <= group_rows:
            break
    blocks = [(a, b - a) for a, b in zip(ends, ends[1:])]
    return [([blocks[i] for i in top], [x for i, x in enumerate(blocks) if i not in top]) for top in combinations(range(count), agree)]


def _turn(fp: np.ndarray, order: list[Block]) -> np.ndarray:
    """Each fingerprint with its blocks in another order."""
    out = np.zeros_like(fp)
    for start, width in order:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(64 - start - width)) & np.uint64((1 << width) - 1))
    return out


class _Forest:
    """Components of one subtree's keys; remembers the links that joined two of them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.parts: dict[int, list[int]] = {}
        self.links: list[tuple[int, int]] = []

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            apart = self.root[a] != self.root[b]
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            x, y = int(a[0]), int(b[0])
            self.links.append((x, y))
            rx, ry = int(self.root[x]), int(self.root[y])
            px, py = self.parts.pop(rx, [rx]), self.parts.pop(ry, [ry])
            if len(px) < len(py):
                px, py, rx = py, px, ry
            self.root[py] = rx
            px += py
            self.parts[rx] = px


def trie_links(keys: np.ndarray, budget: int = 4) -> list[tuple[int, int]]:
    """A spanning forest of the links among sorted keys: index pairs at most ``budget`` bits apart.

    A node is a range of the sorted keys that share their leading bits. The stack holds pairs of nodes
    of one level with the bits by which their paths differ; a pair over the budget is not pushed.
    Small nodes are compared whole.
    """
    forest = _Forest(len(keys))

    def split(lo: int, hi: int, bit: int) -> int:
        """Where the node's right child begins."""
        mask = np.uint64(1) << np.uint64(63 - bit)
        prefix = keys[lo] & ~((mask << np.uint64(1)) - np.uint64(1)) if bit else np.uint64(0)
        return lo + int(np.searchsorted(keys[lo:hi], prefix | mask))

    stack = [(0, len(keys), 0, len(keys), 0, 0)]
    while stack:
        a0, a1, b0, b1, bit, diff = stack.pop()
        if a0 == a1 or b0 == b1:
            continue
        same = a0 == b0
        if bit == 64 or (a1 - a0) * (b1 - b0) <= LEAF * LEAF:
            apart = np.bitwise_count(keys[a0:a1, None] ^ keys[None, b0:b1]) <= budget
            x, y = np.nonzero(np.triu(apart, 1) if same else apart)
            if len(x):
                forest.link(x + a0, y + b0)
            continue
        am = split(a0, a1, bit)
        bm = am if same else split(b0, b1, bit)
        stack.append((a0, am, b0, bm, bit + 1, diff))
        stack.append((am, a1, bm, b1, bit + 1, diff))
        if diff < budget:
            stack.append((a0, am, bm, b1, bit + 1, diff + 1))
            if not same:
                stack.append((am, a1, b0, bm, bit + 1, diff + 1))
    return forest.links


def _join_groups(batches: Iterator[pa.RecordBatch], budget: int, choices: list[tuple[list[Block], list[Block]]]) -> Iterator[pa.RecordBatch]:
    """Rows (g, choice, fp) sorted by g: links within each run of one g. A run may span batches."""
    names = ["a", "b"]

    def solve(fp: np.ndarray, choice: int) -> list[np.ndarray]:
        top, rest = choices[choice]
        turned = _turn(fp.view(np.uint64), top + rest)
        order = np.argsort(turned)
        pairs = np.array(trie_links(turned[order], budget), np.int64).reshape(-1, 2)
        return [fp[order[pairs[:, 0]]], fp[order[pairs[:, 1]]]]

    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        g = cols[0]
        cut = np.flatnonzero(np.diff(g)) + 1
        bounds = np.concatenate([[0], cut]).astype(int)
        held = [c[bounds[-1] :] for c in cols]
        found = [solve(cols[2][i:j], int(cols[1][i])) for i, j in zip(bounds[:-1], bounds[1:]) if j - i > 1]
        if found:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], names)
    if held is not None and len(held[0]) > 1:
        yield pa.record_batch([pa.array(x) for x in solve(held[2], int(held[1][0]))], names)


def trie_self_join(keys: DataFrame, budget: int = 4, group_rows: int = 20_000) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within the budget."""
    choices = cover(keys.count(), budget, group_rows)

    def bits(top: list[Block]) -> Column:
        out = F.lit(0).cast("long")
        for start, width in top:
            part = F.shiftrightunsigned("fp", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            out = F.shiftleft(out, width).bitwiseOR(part)
        return out

    top = F.array(*[F.struct(F.lit(k).alias("choice"), bits(t).alias("value")) for k, (t, _) in enumerate(choices)])
    dealt = keys.select("fp", F.explode(top).alias("t")).select("fp", "t.choice", "t.value")
    full = Kept(dealt.groupBy("choice", "value").agg(F.count("*").alias("n")).where(F.col("n") > group_rows), "simhash-full")
    if full.df.take(1):
        parts = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / group_rows).cast("int")
        dealt = dealt.join(full.df, ["choice", "value"], "left").withColumn("k", parts)
        dealt = dealt.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        dealt = dealt.withColumn("g", F.xxhash64("choice", "value", F.least("s", "t"), F.greatest("s", "t")))
    else:
        dealt = dealt.withColumn("g", F.xxhash64("choice", "value"))
    dealt = dealt.select("g", "choice", "fp").repartition("g").sortWithinPartitions("g", "choice")
    return dealt.mapInArrow(lambda it: _join_groups(it, budget, choices), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, group_rows: int = 20_000) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (its component's least doc_id), x (a hash of the text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("x")).alias("key"), text.cast("binary").alias("text"))
    out = source.schema["key"].dataType.simpleString()
    rows = keep(source.mapInArrow(lambda it: _fingerprints(it, width), f"key {out}, fp long").select("key.doc_id", "key.x", "fp"), "simhash-fp")
    nodes = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-keys")
    links = Kept(trie_self_join(nodes.select("fp"), budget, group_rows), "simhash-links")
    member = connected_components(links.df).select(F.col("node").alias("fp"), "root")
    linked = nodes.join(member, "fp")
    name = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = linked.join(name, "root").select("fp", "least")
    # Written, so that the last join has two plain sides, of which Spark can split a hot fingerprint's.
    table = keep(nodes.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-names")
    return rows.join(table, "fp").select("doc_id", "fp", "component_id", "x")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **options) -> DataFrame:
    """One document of each group stays: the one that names it; all columns are kept.

    With ``similarity`` links are pairs of that Jaccard similarity of their shingle sets, found by fingerprints and shared shingles.
    Rows that share the naming id but not its text stay too (ids are taken as row names).
    A group without any id keeps all its rows.
    """
    if similarity is not None:
        from vespera.llm.similar import near_groups

        groups = near_groups(docs, id_col, text_col, similarity=similarity, **options)
        return without_copies(docs, groups, id_col, text_col)
    groups = near_duplicates(docs, id_col, text_col, **options)
    return without_copies(docs, groups, id_col, text_col)


def without_copies(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that name their group (doc_id, component_id, x), or whose group nothing names."""
    gone = groups.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    gone = keep(gone.select(F.col("doc_id").alias("_i"), F.col("x").alias("_x")).distinct(), "simhash-gone")
    key = fit_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return keyed.join(small(gone), F.col(f"`{id_col}`").eqNullSafe(F.col("_i")) & (F.col(key) == F.col("_x")), "left_anti").drop(key)
