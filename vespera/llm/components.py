"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum and one equi-join, so a node with very many neighbours is
pre-aggregated before the shuffle and its rows are never gathered into one list. Every
round is written to the shared folder: lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import Kept, keep


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u > v)."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select("u", "v")
    # Written, so that the join has two plain sides, of which Spark can split a node with very many neighbours.
    least = keep(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that has a link; root is the component's least node.

    ``edges`` has two columns of one orderable type. Nulls and self-links are dropped,
    repeated and reversed links count once. An empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now = Kept(pairs, "cc")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = mark(now.df)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        step = Kept(_star(now.df, True), "cc")
        then = Kept(_star(step.df, False), "cc")
        step.drop()
        now.drop()
        now = then
        new = mark(now.df)
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError("connected components did not settle")
    stars = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
