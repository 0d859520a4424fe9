"""Registered queries of the corpus operators, with production parameters and whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.pii import find

    return find(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.html_text import main_text

    return main_text(_table(spark, sf_dir, "pages"))


def op3_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, length(coalesce(text, '')) + 1 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || coalesce(text, ''))) AS digest FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS size FROM d GROUP BY source
), w AS (
  SELECT source, pow(size, 0.5) / sum(pow(size, 0.5)) OVER () * (1000 - count(*) OVER ()) AS ideal, count(*) OVER () AS n FROM sizes
), f AS (
  SELECT source, ideal - floor(ideal) AS part, floor(ideal) AS low, 1000 - n - sum(floor(ideal)) OVER () AS missing FROM w
), share AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS rank,
         CAST(1 + low + CASE WHEN row_number() OVER (ORDER BY part DESC, source NULLS FIRST) <= missing THEN 1 ELSE 0 END AS BIGINT) AS share
  FROM f
), listed AS (
  SELECT list(share ORDER BY rank) AS s FROM share
), sim AS (
  SELECT CAST(-1 AS BIGINT) AS slot, s, list_transform(s, lambda x: CAST(0 AS BIGINT)) AS given, CAST(0 AS BIGINT) AS rank FROM listed
  UNION ALL
  SELECT slot + 1, s, list_transform(generate_series(1, len(s)), lambda i: given[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick
  FROM (
    SELECT slot, s, given, list_min(list_transform(generate_series(1, len(s)), lambda i:
             CASE WHEN given[i] * 1000 // s[i] <= slot + 1 THEN ((given[i] + 1) * 1000 + s[i] - 1) // s[i] * 100000 + i ELSE 9000000000000000 END)) % 100000 AS pick
    FROM sim WHERE slot < 999
  )
), turns AS (
  SELECT rank, slot, given[rank] - 1 AS turn FROM sim WHERE slot >= 0
), placed AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
), known AS (
  SELECT p.*, s.rank, s.share, CAST(p.start AS BIGINT) // 262144 AS k FROM placed p JOIN share s ON p.source IS NOT DISTINCT FROM s.source
), slotted AS (
  SELECT n.*, t.slot + k // n.share * 1000 AS turn_slot FROM known n JOIN turns t ON n.rank = t.rank AND n.k % n.share = t.turn
)
SELECT doc_id, source, share / 1000 AS weight, k + 1 AS block, k * 1000 // share AS release,
       ((k + 1) * 1000 + share - 1) // share AS deadline, turn_slot AS slot,
       row_number() OVER (ORDER BY turn_slot, start, digest, doc_id) - 1 AS position
FROM slotted
"""


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.quality_crf import assess

    return assess(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.warc import read_archives, write_archives

    return read_archives(write_archives(_table(spark, sf_dir, "pages")), payloads=False).drop("payload", "url")


OP5_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), g AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS best FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < best THEN best END AS refers_to
FROM g
"""


def op6_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.kmeans_tree import nearest

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from vespera.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.exact_dedup import duplicate_groups

    return duplicate_groups(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("x")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vespera.llm.line_dedup import deduplicate_lines

    return deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_html_text": op2_html_text,
        "op3_pfair_mixing": op3_pfair_mixing,
        "op4_quality_crf": op4_quality_crf,
        "op5_warc": op5_warc,
        "op6_kmeans_tree": op6_kmeans_tree,
        "op7_packing": op7_packing,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_line_dedup": op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_pfair_mixing": OP3_SQL, "op5_warc": OP5_SQL, "op9_exact_dedup": OP9_SQL}
