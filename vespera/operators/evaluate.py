"""Retrieval quality: recall, agreement, hit rate, MRR, nDCG, percentiles.

Rankings are tables (qid, rn, id); relevance is a table (qid, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(truth: DataFrame, got: DataFrame) -> DataFrame:
    """Mean over the truth's queries of the share of its ids that were returned."""
    hit = truth.select("qid", "id").join(got.select("qid", "id", F.lit(1).alias("hit")).distinct(), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall")).agg(F.avg("recall").alias("recall"))


def top1_agreement(truth: DataFrame, got: DataFrame) -> DataFrame:
    a = truth.where("rn = 1").select("qid", F.col("id").alias("a"))
    b = got.where("rn = 1").select("qid", F.col("id").alias("b"))
    return a.join(b, "qid", "left").agg(F.avg(F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("double")).alias("agreement"))


def _judged(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    return ranking.select("qid", "rn", "id").join(relevant.select("qid", "id", F.lit(1).alias("rel")).distinct(), ["qid", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def hit_at_k(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    return _judged(ranking, relevant).groupBy("qid").agg(F.max("rel").alias("hit")).agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def mrr_at_k(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    first = _judged(ranking, relevant).groupBy("qid").agg(F.min(F.when(F.col("rel") == 1, F.col("rn"))).alias("first"))
    return first.agg(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def ndcg_at_k(ranking: DataFrame, relevant: DataFrame, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """Binary gains over the ideal ranking of min(relevant, k) hits.

    ``sizes`` (qid, n) tells how many rows are relevant where ``relevant`` lists only those that were ranked.
    """
    gain = _judged(ranking, relevant).where(F.col("rn") <= k).groupBy("qid").agg(F.sum(F.when(F.col("rel") == 1, 1.0 / F.log2(F.col("rn") + 1.0)).otherwise(0.0)).alias("gain"))
    size = relevant.distinct().groupBy("qid").agg(F.count("*").alias("n")) if sizes is None else sizes
    size = size.select("qid", F.least("n", F.lit(k)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    return gain.join(size, "qid", "left").agg(F.avg(F.when(F.col("n") > 0, F.col("gain") / ideal).otherwise(0.0)).alias("ndcg"))


def percentile_floor(rows: DataFrame, value: Column, ps: list[float]) -> DataFrame:
    """sorted[min(n - 1, floor(p * n))] for each p, with count and mean.

    Equal to the discrete percentile at (that index + 1) / n, which Spark takes from merged counts per value.
    """
    n = rows.where(value.isNotNull()).count()
    if not n:
        return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *[F.max(value).alias(f"p{round(p * 100)}") for p in ps])
    index = [min(n - 1, int(p * n)) for p in ps]
    # Half a step below (index + 1) / n, so that rounding cannot reach the next value.
    at = [F.expr(f"percentile_disc({(i + 0.5) / n!r}D) within group (order by v)").alias(f"p{round(p * 100)}") for i, p in zip(index, ps)]
    return rows.select(value.alias("v")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), *at)


def percentile_ceil(rows: DataFrame, value: Column, ps: list[float]) -> DataFrame:
    """sorted[ceil(p * n) - 1] for each p."""
    at = [F.expr(f"percentile_disc({p!r}D) within group (order by v)").alias(f"p{round(p * 100)}") for p in ps]
    return rows.select(value.alias("v")).agg(*at)
