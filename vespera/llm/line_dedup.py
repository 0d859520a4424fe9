"""Line deduplication by content-defined chunks of lines.

Chunks. Every line that is not blank is hashed (128 bits). A line of ``min_words`` words or more (or ten bytes for each of
them, for scripts without spaces) is a chunk of its own. In runs of shorter lines a rolling hash runs over the hashes of
two successive lines, and of each two successive rolling hashes the smaller one is a boundary; a chunk reaches from one
boundary to the next, both lines of each included, so it has three or four lines. Boundaries depend on the nearest
lines alone: whatever is put in or taken out before a passage, those inside it are the same, and any five successive
short lines hold a whole chunk.

Edges. Around a chunk that occurs more than once the passage may go on. Up to ``REACH`` lines on each side are chained to
it: the key of a line at distance j is the hash of the key at distance j - 1 and the line. A chained line is
repeated if its key is. Only chunks that somewhere end beside a line that no repeated chunk covers are chained, on that
side, wherever they occur. As more lines than that would hold a chunk, a repeated passage that holds a line of
``min_words`` words or five lines is found whole, however its surroundings differ.

Removal. A line goes when a chunk, or a chunk's chained line, that holds it has occurred before (lower id, then text key,
then line), unless it belongs to the first occurrence of another repeated chunk or chain: of each repeated
passage a whole copy stays. Blank lines go with the line they follow. Before anything is removed the bytes of all chunks and chained lines
that share a key are compared; keys that stand for different bytes count as not repeated.

Scale. Texts are read twice and shuffled once, to meet their marks. The first pass leaves 17 bytes for each line; chunks
and chains are worked out from those. Counts are combined before they are shuffled and the joins have two written
sides, which Spark can split at a very common chunk; for the comparison each task gives the bytes of a key once.

Defined results: null text counts as empty and stays so (empty); a text without a repeated passage is returned
unchanged; a text may become empty, its row stays; rows that tie wholly are treated alike (the first
occurrence stays in each); null ids come last; very long texts and lines are treated like others; extra columns are kept,
and names that clash with the added ones get an underscore; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import fit_name, keep

Digest = Callable[[bytes], bytes]
PRIME, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Lines that are chained to each side of a repeated chunk: one less than always hold a chunk.
REACH = 4
WIDTH = 16


def digests(text: bytes, min_words: int, digest: Digest) -> tuple[bytes, bytes]:
    """The hashes of the lines that are not blank, end to end, and for each whether it is long."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return b"".join(map(digest, lines)), bytes(len(line) >= 10 * min_words or len(line.split()) >= min_words for line in lines)


def boundaries(hashes: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Lines at which chunks of short lines begin and end: of two successive rolling hashes the smaller one's line."""
    if len(hashes) < 3:
        return np.zeros(0, np.int64)
    rolling = hashes[:-1] * PRIME + hashes[1:]
    rolling ^= rolling >> np.uint64(32)
    rolling *= MIX
    whole = short[:-2] & short[1:-1] & short[2:]  # windows of two rolling hashes: three lines
    at = np.flatnonzero(whole)
    return np.unique(at + (rolling[at + 1] <= rolling[at]))


def chunks(hashes: bytes, long: bytes, digest: Digest = xxhash.xxh3_128_digest) -> Iterator[tuple[int, int, bytes]]:
    """(first line, end, key) of each chunk; lines are counted without blank ones."""
    for i, is_long in enumerate(long):
        if is_long:
            yield i, i + 1, digest(hashes[WIDTH * i : WIDTH * (i + 1)])
    if long.count(0) > 3:
        heads = np.frombuffer(hashes, "<u8")[::2]
        ends = boundaries(heads, np.frombuffer(long, np.uint8) == 0).tolist()
        for a, b in zip(ends, ends[1:]):
            if b - a <= 2:  # else another run of short lines begins
                yield a, b + 2, digest(hashes[WIDTH * a : WIDTH * (b + 2)])


def chains(hashes: bytes, first: int, end: int, key: bytes, sides: str, digest: Digest = xxhash.xxh3_128_digest) -> Iterator[tuple[int, bytes]]:
    """(line, key) of the lines around a chunk on some sides, outward."""
    n = len(hashes) // WIDTH
    for side, lines in (("<", range(first - 1, max(-1, first - 1 - REACH), -1)), (">", range(end, min(n, end + REACH)))):
        if side in sides:
            now = key
            for i in lines:
                now = digest(now + side.encode() + hashes[WIDTH * i : WIDTH * (i + 1)])
                yield i, now


def open_sides(n: int, spans: list[tuple[int, int]]) -> list[str]:
    """For each chunk (first, end) of a text of n lines the sides on which a line follows that no chunk covers."""
    covered = np.zeros(n + 2, bool)
    covered[[0, -1]] = True  # beyond the text there is nothing to chain
    for a, b in spans:
        covered[a + 1 : b + 1] = True
    return ["<" * (not covered[a]) + ">" * (not covered[b + 1]) for a, b in spans]


def _digests(batches: Iterator[pa.RecordBatch], min_words: int, digest: Digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [digests(t, min_words, digest) for t in batch.column(2).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([h for h, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["doc_id", "tkey", "hashes", "long"])


def _rows(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    """(row of the batch, key, line, until, first, end) as columns beside the rows' ids."""
    row, key, *places = list(zip(*rows)) or [()] * 6
    at = pa.array(row, pa.int64())
    return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(key, pa.binary()), *(pa.array(p, pa.int32()) for p in places)], ["doc_id", "tkey", "h", "line", "until", "first", "end"])


def _chunks(batches: Iterator[pa.RecordBatch], digest: Digest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _rows(batch, [(i, key, a, b, a, b) for i, (h, long) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3)))) for a, b, key in chunks(h, long, digest)])


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, side) of the chunks beside uncovered lines; the columns are the hashes and the repeated chunks of texts."""
    for batch in batches:
        found = set()
        for hashes, marked in zip(*(c.to_pylist() for c in batch.columns)):
            sides = open_sides(len(hashes) // WIDTH, [(m["first"], m["end"]) for m in marked])
            found.update((m["h"], side) for m, s in zip(marked, sides) for side in s)
        yield pa.record_batch([pa.array([h for h, _ in found], pa.binary()), pa.array([s for _, s in found], pa.string())], ["h", "side"])


def _chains(batches: Iterator[pa.RecordBatch], digest: Digest) -> Iterator[pa.RecordBatch]:
    """Chained lines of the chunks that the last column lists, with the sides on which they are chained."""
    for batch in batches:
        rows = []
        for i, (hashes, marked) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 3)))):
            for m in marked:
                rows += [(i, key, line, line + 1, min(line, m["first"]), max(line + 1, m["end"])) for line, key in chains(hashes, m["first"], m["end"], m["h"], m["sides"], digest)]
        yield _rows(batch, rows)


def _repeated(table: DataFrame) -> DataFrame:
    """The rows whose key occurs more than once, with whether theirs is the first occurrence."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey", "first", "line")
    often = keep(table.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("place")).where("n > 1").select("h", "place"), "lines-repeated")
    stays = F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("tkey") == F.col("place.tkey")) & (F.col("first") == F.col("place.first")) & (F.col("line") == F.col("place.line"))
    # Written, so that Spark can split the join at a very common chunk before rows are grouped by document.
    return keep(table.join(often, "h").select("doc_id", "tkey", "h", "line", "until", "first", "end", stays.alias("stays")), "lines-met")


def _bodies(batches: Iterator[pa.RecordBatch], digest: Digest) -> Iterator[pa.RecordBatch]:
    """(key, bytes) of marked chunks and chained lines, each once a batch; a chained line with the key it is chained to."""
    for batch in batches:
        found: set[tuple[bytes, bytes]] = set()
        for text, marked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = [line for line in text.split(b"\n") if line.strip()]
            wanted = {m["h"] for m in marked}
            for first, end in {(m["first"], m["end"]) for m in marked if (m["line"], m["until"]) == (m["first"], m["end"])}:
                hashes = b"".join(map(digest, lines[max(0, first - REACH) : end + REACH]))
                a = min(first, REACH)
                key = digest(hashes[WIDTH * a : WIDTH * (a + end - first)])
                found.add((key, b"\n".join(lines[first:end])))
                before = {"<": key, ">": key}
                for line, now in chains(hashes, a, a + end - first, key, "<>", digest):
                    side = "<" if line < a else ">"
                    if now in wanted:
                        found.add((now, side.encode() + before[side] + lines[line - a + first]))
                    before[side] = now
        yield pa.record_batch([pa.array([k for k, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["h", "body"])


def _remove(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The last column holds the marks; it gives way to the counts of lines."""
    for batch in batches:
        texts, totals, gone = [], [], []
        *rest, marks = batch.columns
        for text, marked in zip(rest[text_at].to_pylist(), marks.to_pylist()):
            lines = (text or "").split("\n")
            kept = lines
            if marked:
                later, stay = set(), set()
                for m in marked:
                    if m["stays"]:
                        stay.update(range(m["first"], m["end"]))
                    else:
                        later.update(range(m["line"], m["until"]))
                later -= stay
                kept, going, at = [], False, -1
                for line in lines:
                    if line.encode().strip():
                        at += 1
                        going = at in later
                    if not going:
                        kept.append(line)
            totals.append(len(lines))
            gone.append(len(lines) - len(kept))
            texts.append("\n".join(kept))
        rest[text_at] = pa.array(texts, pa.string())
        yield pa.record_batch([*rest, pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], [str(i) for i in range(len(rest) + 2)])


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = ("n_lines", "n_removed"), min_words: int = 10, digest: Digest = xxhash.xxh3_128_digest) -> DataFrame:
    """All rows and columns with repeated passages of lines removed from the text.

    ``counts`` names two more columns: the lines of the original text, and those removed; None leaves them out.
    Names that docs has already are prefixed by an underscore. ``digest`` is the lines' hash (16 bytes).
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    short_key = F.unhex(F.md5(text.cast("binary")))
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), short_key.alias("tkey"), text.cast("binary").alias("text"))
    ids = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, tkey binary"
    places = f"{ids}, h binary, line int, until int, first int, end int"
    hashed = keep(source.mapInArrow(lambda it: _digests(it, min_words, digest), f"{ids}, hashes binary, long binary"), "lines-hashed")
    table = keep(hashed.mapInArrow(lambda it: _chunks(it, digest), places), "lines-chunks")
    by_row = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.tkey") == F.col("b.tkey"))
    key = fit_name(docs, "_tkey")
    keyed = docs.withColumn(key, short_key)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_i")) & (F.col(key) == F.col("_k"))
    bad: DataFrame | None = None
    while True:
        met = _repeated(table if bad is None else table.join(bad, "h", "left_anti"))
        marked = met.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("first", "end", "h")).alias("marked"))
        beside = hashed.alias("a").join(marked.alias("b"), by_row).select("a.hashes", "b.marked").mapInArrow(_open, "h binary, side string")
        sides = keep(beside.distinct().groupBy("h").agg(F.array_join(F.collect_set("side"), "").alias("sides")), "lines-open")
        chained = met.join(sides, "h").groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("first", "end", "h", "sides")).alias("marked"))
        around = hashed.alias("a").join(chained.alias("b"), by_row).select("a.doc_id", "a.tkey", "a.hashes", "b.marked")
        chained = keep(around.mapInArrow(lambda it: _chains(it, digest), places), "lines-chained")
        also = _repeated(chained if bad is None else chained.join(bad, "h", "left_anti"))
        marks = met.union(also).groupBy(F.col("doc_id").alias("_i"), F.col("tkey").alias("_k")).agg(F.collect_set(F.struct("h", "line", "until", "first", "end", "stays")).alias("_marked"))
        joined = keep(keyed.join(marks, same, "left").drop("_i", "_k", key), "lines-marked")  # texts are shuffled here alone
        bodies = joined.where("_marked is not null").select(text.cast("binary").alias("text"), "_marked").mapInArrow(lambda it: _bodies(it, digest), "h binary, body binary")
        shared = keep(bodies.distinct().groupBy("h").count().where("count > 1").select("h"), "lines-shared")
        if not shared.take(1):
            break
        bad = shared if bad is None else keep(bad.union(shared), "lines-bad")  # one key for different bytes: without it
    total, gone = (fit_name(docs, c) for c in counts or ("n_lines", "n_removed"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at_text = docs.columns.index(text_col)
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], "_marked")
    done = out.mapInArrow(lambda it: _remove(it, at_text), f"{fields}, `{total}` long, `{gone}` long")
    return done if counts else done.drop(total, gone)
