"""Exact deduplication through an extendible-hash index on shared files.

Method. Every document is reduced to a 64-bit hash of its normalised text (white space
deleted), a SHA-256 digest and its length. Rows that share both hashes are one entry of an extendible-hash index, with
their number and the row that would stay. A directory, addressed by the leading bits of the hash, doubles whenever a
bucket that already uses all directory bits is overfull; each bucket is one folder of files in the shared
directory, so a lost executor costs the reading of some buckets, not the index.

Owner tasks take buckets: they read the entries of each hash that more than one row has, meet the texts of
those rows, and walk the chain of each hash: a text is compared byte by byte with every link, and one that differs
from all of them becomes a new link. A link gives the group: its size and the row that stays. A document takes the
group of its hash and digest; two links of one chain with one SHA-256 digest are refused with an error, not guessed at.
Documents whose hash nobody shares are groups of one; their texts are never shuffled.

A hot group (say a third of all rows holding one text) is one entry, and its text reaches the owner once or a few
times for each task that read it; no task and no driver ever holds a group's rows.

Defined results: null text counts as empty, and all empty texts form one group. Of rows that tie
wholly (same id, same text) exactly one stays. A null doc_id sorts after every other. Very long texts are
treated like others (one text and one chain's links are held at a time).
An empty table gives an empty result. Extra columns, whatever their names, are passed through by :func:`deduplicate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vespera.llm.common import BROADCAST_KEYS, Kept, fit_name, keep, small

#: The characters deleted before texts are compared (space and 09 to 0D).
WHITE = b" \t\n\x0b\x0c\r"
#: Directory bits counted at a time when the directory doubles.
STEP_BITS = 8
#: Bytes of texts that a task remembers in order to send the same one only once.
SEEN_BYTES = 8 << 20


def normalised(text: bytes) -> bytes:
    return text.translate(None, WHITE)


def key_hash(norm: bytes) -> int:
    """The index's hash, signed."""
    h = xxhash.xxh3_64_intdigest(norm)
    return h - (1 << 64) if h >> 63 else h


@dataclass(frozen=True)
class Directory:
    """Leaves (depth, prefix) of an extendible hash; depth is the number of leading bits used. A leaf of less than
    the greatest depth stands for all slots of the directory that begin with its prefix."""

    leaves: tuple[tuple[int, int], ...]

    def place(self, keys: DataFrame) -> DataFrame:
        """Rows with the bucket of their hash ``h``: its leading bits, as many as some leaf has, are looked up."""
        depths = sorted({d for d, _ in self.leaves})
        if depths == [0]:
            return keys.withColumn("bucket", F.lit(0))
        named = [(d, prefix - (1 << 64) if prefix >> 63 else prefix, number) for number, (d, prefix) in enumerate(self.leaves)]
        table = keys.sparkSession.createDataFrame(named, "depth int, prefix long, bucket int")
        if len(named) <= BROADCAST_KEYS:
            table = F.broadcast(table)
        bits = F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("h", 64 - d).alias("prefix")) for d in depths])
        return keys.withColumn("_bits", F.explode(bits)).select(*keys.columns, "_bits.*").join(table, ["depth", "prefix"]).drop("depth", "prefix")


def build_directory(keys: DataFrame, capacity: int) -> Directory:
    """Split overfull buckets, doubling the directory, until each holds at most ``capacity`` of the distinct hashes ``h``.

    Only counts by prefix reach the driver, at most 2**STEP_BITS for each overfull bucket.
    """
    leaves: list[tuple[int, int]] = []
    open_: list[tuple[int, int]] = [(0, 0)]
    while open_:
        base = open_[0][0]
        bits = min(base + STEP_BITS, 64)
        part = keys.select(F.shiftrightunsigned("h", 64 - bits).alias("p"))
        if base:
            over = keys.sparkSession.createDataFrame([(p,) for _, p in open_], "over long")
            part = part.join(over, F.shiftrightunsigned("p", bits - base) == F.col("over"), "left_semi")
        counts = {r["p"] % (1 << 64): r["n"] for r in part.groupBy("p").agg(F.count("*").alias("n")).collect()}

        def size(d: int, prefix: int) -> int:
            width = bits - d
            return sum(counts.get((prefix << width) + k, 0) for k in range(1 << width))

        again: list[tuple[int, int]] = []
        todo = list(open_)
        while todo:
            d, prefix = todo.pop()
            if size(d, prefix) <= capacity:
                leaves.append((d, prefix))
            elif d == bits:
                again.append((d, prefix))
            else:
                todo += [(d + 1, 2 * prefix), (d + 1, 2 * prefix + 1)]
        open_ = again
    return Directory(tuple(sorted(leaves, key=lambda x: x[1] << (64 - x[0]))))


def _texts(column: pa.Array) -> Iterator[bytes]:
    """The texts of a batch, one at a time."""
    return (text.as_py() for text in column.cast(pa.binary()))


def _keys(batches: Iterator[pa.RecordBatch], hash_of: Callable[[bytes], int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, sha = [], []
        for text in _texts(batch.column(1)):
            norm = normalised(text)
            h.append(hash_of(norm))
            sha.append(hashlib.sha256(norm).digest())
        n = pc.utf8_length(batch.column(1)).cast(pa.int64())
        yield pa.record_batch([batch.column(0), batch.column(2), n, pa.array(h, pa.int64()), pa.array(sha, pa.binary())], ["doc_id", "x", "n", "h", "sha"])


def _bodies(batches: Iterator[pa.RecordBatch], hash_of: Callable[[bytes], int]) -> Iterator[pa.RecordBatch]:
    """Normalised texts with their hash, as good as once a task."""
    seen: set[bytes] = set()
    size = 0
    for batch in batches:
        new = []
        for text in _texts(batch.column(0)):
            norm = normalised(text)
            if norm not in seen:
                if size > SEEN_BYTES:
                    seen, size = set(), 0
                seen.add(norm)
                size += len(norm) + 100
                new.append(norm)
        yield pa.record_batch([pa.array([hash_of(b) for b in new], pa.int64()), pa.array(new, pa.binary())], ["h", "body"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, body, sha, size, keep_id, keep_uid) of some buckets, by h: entries (without a body) and texts.

    Gives one row for each link of a chain. One chain is held at a time, each of its texts once.
    """
    at: int | None = None
    entries: dict[bytes, tuple] = {}
    links: list[bytes] = []

    def close() -> list[tuple]:
        out = {}
        for body in links:
            sha = hashlib.sha256(body).digest()
            if sha in out:
                raise ValueError("two different texts have one SHA-256 digest")
            out[sha] = (at, sha, *entries.get(sha, ()))
        if set(out) != set(entries):
            raise ValueError("index entries without a text: the table has changed between two reads")
        return list(out.values())

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), kind, pa.int64())
        columns = list(zip(*rows)) or [()] * 5
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["h", "sha", "group_size", "keep_id", "keep_uid"])

    kind = pa.int64()
    for batch in batches:
        kind, done = batch.column(4).type, []
        for h, body, sha, *entry in zip(*(c.to_pylist() for c in batch.columns)):
            if h != at:
                if at is not None:
                    done += close()
                at, entries, links = h, {}, []
            if body is None:
                entries[sha] = tuple(entry)
            elif not any(body == link for link in links):
                links.append(body)
        yield batch_of(done, kind)
    if at is not None:
        yield batch_of(close(), kind)


def _small(df: DataFrame) -> DataFrame:
    return small(df, BROADCAST_KEYS)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 50_000, hash_of: Callable[[bytes], int] = key_hash) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256 and x (a hash of the text as it is).

    Of equal texts the row with the most code points stays, then the one with the smallest id.
    ``hash_of`` is the index's hash; a poor one only makes longer chains.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.withColumn("x", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    keyed = source.mapInArrow(lambda it: _keys(it, hash_of), f"doc_id {kind}, x long, n long, h long, sha binary")
    rows = keep(keyed.withColumn("uid", F.monotonically_increasing_id()), "dedup-keys")

    # The index: an entry for each hash and digest, in the bucket that the directory names.
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    entries = keep(rows.groupBy("h", "sha").agg(F.count("*").alias("size"), F.min(order).alias("best")), "dedup-entries")
    directory = build_directory(entries.select("h").distinct(), bucket_capacity)
    placed = directory.place(entries.select("h", "sha", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.uid").alias("keep_uid")))
    index = Kept(placed.repartition("bucket").sortWithinPartitions("bucket", "h"), "dedup-index", ["bucket"]).df

    # The hashes that several rows have, and the texts of those rows.
    several = keep(index.groupBy("bucket", "h").agg(F.sum("size").alias("n")).where("n > 1").select("bucket", "h"), "dedup-several")
    wanted = keep(rows.join(_small(several.select("h")), "h", "left_semi").select("x").distinct(), "dedup-wanted")
    texts = source.join(_small(wanted), "x", "left_semi").select("text").mapInArrow(lambda it: _bodies(it, hash_of), "h long, body binary")
    chained = index.join(several.select("bucket", "h"), ["bucket", "h"], "left_semi")
    none = F.lit(None)
    both = chained.select("bucket", "h", none.cast("binary").alias("body"), "sha", "size", "keep_id", "keep_uid").union(
        directory.place(texts).select("bucket", "h", "body", none.cast("binary"), none.cast("long"), none.cast(kind), none.cast("long"))
    )
    owned = both.repartition("bucket").sortWithinPartitions("bucket", "h", F.col("body").isNotNull()).drop("bucket")
    groups = keep(owned.mapInArrow(_own, f"h long, sha binary, group_size long, keep_id {kind}, keep_uid long"), "dedup-groups")

    out = rows.join(groups, ["h", "sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "x",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns; of rows that tie wholly, one."""
    groups = duplicate_groups(docs, id_col, text_col, **options)
    per = groups.groupBy(F.col("doc_id").alias("_i"), F.col("x").alias("_x")).agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    odd = keep(per.where("not stays or n > 1"), "dedup-odd")
    key, copy = fit_name(docs, "_key"), fit_name(docs, "_copy")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_i")) & (F.col(key) == F.col("_x"))
    stay = keyed.join(_small(odd.where("not stays").select("_i", "_x")), same, "left_anti")
    twice = odd.where("stays").select("_i", "_x")
    if not twice.take(1):
        return stay.drop(key)
    first = Window.partitionBy(id_col, key).orderBy(F.lit(0))
    several = stay.join(_small(twice), same, "left_semi").withColumn(copy, F.row_number().over(first)).where(F.col(copy) == 1).drop(copy)
    return stay.join(_small(twice), same, "left_anti").unionByName(several).drop(key)
