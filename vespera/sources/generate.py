"""Synthetic vectors, and a deterministic text embedder that needs no network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.functions.vectors import normalize


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = 7) -> DataFrame:
    """n unit vectors of independent normal numbers."""
    v = F.array(*[F.randn(seed * 10_007 + d) for d in range(dim)])
    return spark.range(n).select("id", v.alias("g")).select("id", normalize(F.col("g")).cast("array<float>").alias("vector"))


def clustered(spark: SparkSession, n: int, dim: int, clusters: int | None = None, noise: float = 0.35, seed: int = 7) -> DataFrame:
    """n unit vectors around random unit centres: normalize(centre + noise * unit noise)."""
    count = clusters or max(32, n // 256)
    centres = gaussian(spark, count, dim, seed + 1).select(F.col("id").alias("cluster"), F.col("vector").alias("c"))
    points = gaussian(spark, n, dim, seed).withColumn("cluster", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)))
    mixed = F.zip_with(F.col("c").cast("array<double>"), F.col("vector").cast("array<double>"), lambda a, b: a + b * noise)
    return points.join(centres, "cluster").select("id", normalize(mixed).cast("array<float>").alias("vector"), "cluster")


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed counts of hashed words, unit length; an empty text is the first axis."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
            if not out[i].any():
                out[i, 0] = 1.0
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return embed


def embed_texts(docs: DataFrame, embedder: Callable[[list[str]], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vector) by any embedder that takes a list of texts; batches travel through Arrow."""
    embed = embedder or hashing_embedder()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            v = embed(f["text"].fillna("").tolist())
            yield pd.DataFrame({"id": f["id"], "vector": list(v)})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, vector array<float>")


