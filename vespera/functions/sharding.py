"""Shard of a document or namespace: FNV-1a (64 bits) of its canonical key, modulo the shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of FNV-1a.
OFFSET = 0xCBF29CE484222325
PRIME = 0x100000001B3


def canonical_id(value: int | str) -> str:
    """Integers in decimal; strings trimmed, and all-digit ones without leading zeros."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ValueError(f"an id is an integer or a string, not {value!r}")
    if isinstance(value, int):
        if value < 0:
            raise ValueError("an id cannot be negative")
        return str(value)
    text = value.strip()
    return (text.lstrip("0") or "0") if text.isdigit() and text.isascii() else text


def fnv1a(data: bytes) -> int:
    h = OFFSET
    for byte in data:
        h = (h ^ byte) * PRIME % (1 << 64)
    return h


def key_of(namespace: str, doc_id: int | str | None = None) -> bytes:
    if doc_id is None:
        return namespace.encode()
    return namespace.encode() + b"\0" + canonical_id(doc_id).encode()


def shard_for(namespace: str, doc_id: int | str | None, shards: int) -> int:
    return fnv1a(key_of(namespace, doc_id)) % shards


def canonical_column(doc_id: Column) -> Column:
    text = F.trim(doc_id.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", "")).otherwise(text)


def _fnv_mod(keys: pd.Series, shards: pd.Series) -> pd.Series:
    """All keys of a batch at once, a byte position at a time."""
    raw = [b if b is not None else b"" for b in keys]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    order = np.argsort(-size, kind="stable")
    grid = np.zeros((len(raw), int(size.max(initial=0))), np.uint8)
    for i, j in enumerate(order):
        grid[i, : size[j]] = np.frombuffer(raw[j], np.uint8)
    h = np.full(len(raw), OFFSET, np.uint64)
    live = np.searchsorted(-size[order], -np.arange(grid.shape[1]), side="left")
    for t in range(grid.shape[1]):
        h[: live[t]] = (h[: live[t]] ^ grid[: live[t], t]) * np.uint64(PRIME)
    out = np.empty(len(raw), np.int64)
    out[order] = (h % shards.to_numpy().astype(np.uint64)[order]).astype(np.int64)
    return pd.Series(out)


def shard(namespace: str, doc_id: Column, shards: int) -> Column:
    key = F.concat(F.lit(namespace.encode()), F.lit(b"\0"), canonical_column(doc_id).cast("binary"))
    return F.pandas_udf(_fnv_mod, "long")(key, F.lit(shards))
