"""Registered queries over the driver tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vespera.collection import CELL, Collection
from vespera.functions import vectors as V
from vespera.functions.sharding import PRIME, fnv1a, key_of, shard
from vespera.operators import evaluate, fold, knn
from vespera.plans.filters import compile_filter
from vespera.sources import generate, ingest
from vespera.sources.store import work_dir

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the attributes of the document of the same id; quality and toxic have nulls."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return vectors(spark, sf_dir).join(docs, "id").join(labels, "id", "left")


def probe(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


# SQL texts of the distances: sums in double, left to right, as the Spark expressions take them.
A, B = "CAST(e.embedding AS DOUBLE[])", "CAST(q.embedding AS DOUBLE[])"
DOT = f"list_dot_product({A}, {B})"
L2 = f"list_sum(list_transform(list_zip({A}, {B}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
COS = f"greatest(0.0, 1 - {DOT} / (sqrt(list_dot_product({A}, {A})) * sqrt(list_dot_product({B}, {B}))))"
FORM = {"cosine_distance": COS, "euclidean_squared": L2, "dot_product": f"-{DOT}"}
QUERY0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
RICH = "(SELECT v.vec_id, v.embedding, v.label, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM embeddings v JOIN documents d ON v.vec_id = d.doc_id LEFT JOIN labels l ON v.vec_id = l.doc_id) e"


def scalar(name: str, make: Callable, expr: str) -> None:
    sql = f"SELECT e.vec_id AS id, {expr} AS value FROM embeddings e, {QUERY0}"

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vectors(spark, sf_dir).select("id", make(F.col("vector"), V.literal(probe(spark, sf_dir))).alias("value"))


SCALE = "(list_max(list_transform({0}, lambda x: abs(x))) / 127)"
CODES = "list_transform({0}, lambda x: CAST(greatest(-127.0, least(127.0, round(x / " + SCALE + "))) AS BIGINT))"
scalar("vec_dot", V.dot, DOT)
scalar("vec_cosine", V.cosine_distance, COS)
scalar("vec_l2sq", V.l2_squared, L2)
scalar("vec_negdot", V.negative_dot, f"-{DOT}")
scalar("vec_norm", lambda v, q: V.l2_norm(v), f"sqrt(list_dot_product({A}, {A}))")
scalar("vec_normalize", lambda v, q: V.normalize(v), f"list_transform({A}, lambda x: x / sqrt(list_dot_product({A}, {A})))")
scalar("vec_quantize", lambda v, q: V.int8_codes(v).cast("array<long>"), CODES.format(A))
scalar("vec_doti8", lambda v, q: V.dot_int8(V.int8_codes(v), V.int8_codes(q)), f"CAST(list_sum(list_transform(list_zip({CODES.format(A)}, {CODES.format(B)}), lambda p: p[1] * p[2])) AS BIGINT)")
I8 = f"(list_sum(list_transform(list_zip({CODES.format(A)}, {CODES.format(B)}), lambda p: p[1] * p[2])) * {SCALE.format(A)} * {SCALE.format(B)})"
I8_COS = f"greatest(0.0, 1 - {I8} / sqrt(list_dot_product({A}, {A}) * list_dot_product({B}, {B})))"
scalar("vec_qdist", lambda v, q: V.int8_distance("cosine_distance", V.int8_codes(v), V.int8_scale(v), V.dot(v, v), V.int8_codes(q), V.int8_scale(q), V.dot(q, q)), I8_COS)
scalar("vec_prefix", lambda v, q: V.dot(V.prefix(v, 48), V.prefix(q, 48)), f"list_dot_product({A}[1:48], {B}[1:48])")


@query("vec_validate", "SELECT e.vec_id AS id, CASE e.vec_id % 5 WHEN 0 THEN 'zero' WHEN 1 THEN 'not_finite' WHEN 2 THEN 'empty' WHEN 3 THEN 'overflow' END AS problem FROM embeddings e")
def vec_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector").cast("array<double>")
    at = F.col("id") % 5
    spoilt = F.when(at == 0, F.transform(v, lambda x: x * 0)).when(at == 1, F.concat(v, F.array(F.lit(float("nan"))))).when(at == 2, F.slice(v, 1, 0)).when(at == 3, F.transform(v, lambda x: x * 1e30)).otherwise(v)
    return vectors(spark, sf_dir).select("id", V.problem(spoilt).alias("problem"))


def exact(name: str, metric: str) -> None:
    @query(name, f"SELECT e.vec_id AS id, {FORM[metric]} AS distance FROM embeddings e, {QUERY0} ORDER BY distance, id LIMIT 10")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn.top_k(vectors(spark, sf_dir), probe(spark, sf_dir), 10, metric)


exact("knn_exact_cosine", "cosine_distance")
exact("knn_exact_l2", "euclidean_squared")
exact("knn_exact_dot", "dot_product")


def collection(spark: SparkSession, sf_dir: str, compacted: bool = True, shards: int = 1) -> Collection:
    """The vectors as a collection with the attribute label, written through its log."""
    c = Collection(spark, work_dir(spark), "vectors", shards)
    c.write_tables(vectors(spark, sf_dir).select("id", "vector", attrs("label").alias("attrs")))
    if compacted:
        c.compact()
    return c


def attrs(*names: str):
    return F.map_from_entries(F.array(*[F.struct(F.lit(n), ingest.tagged(F.col(n), "int")) for n in names])).cast(f"map<string, {CELL}>")


@query("knn_ann", f"SELECT id, distance FROM (SELECT e.vec_id AS id, {COS} AS distance, {I8_COS} AS rough FROM embeddings e, {QUERY0} ORDER BY rough, id LIMIT 128) ORDER BY distance, id LIMIT 10")
def knn_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection's approximate search: the best 128 by stored codes, then exact distances."""
    return collection(spark, sf_dir).query(probe(spark, sf_dir), 10, ef=128, rerank=4)


@query("collection_query", f"SELECT e.vec_id AS id, {COS} AS distance FROM embeddings e, {QUERY0} WHERE e.vec_id % 7 <> 0 AND e.label IN (1, 2, 3) ORDER BY distance, id LIMIT 10")
def collection_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered query of a snapshot with deletes on top."""
    c = collection(spark, sf_dir)
    c.write_tables(deletes=vectors(spark, sf_dir).where("id % 7 = 0").select("id"))
    return c.query(probe(spark, sf_dir), 10, ["label", "In", [1, 2, 3]])


def filtered(name: str, expr: list, where: str) -> None:
    """A filtered query over the vectors and the attributes of their documents."""

    @query(name, f"SELECT e.vec_id AS id, {COS} AS distance FROM {RICH}, {QUERY0} WHERE {where} ORDER BY distance, id LIMIT 10")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return knn.top_k(rich(spark, sf_dir), probe(spark, sf_dir), 10, filters=expr)


FILTERS = {
    "eq": (["lang", "Eq", "en"], "e.lang IS NOT DISTINCT FROM 'en'"),
    "eq_null": (["quality", "Eq", None], "e.quality IS NULL"),
    "eq_cross_kind": (["Or", [["lang", "Eq", 1], ["label", "Eq", 3]]], "e.label = 3"),
    "noteq": (["quality", "NotEq", 1], "e.quality IS DISTINCT FROM 1"),
    "in": (["quality", "In", [0, None]], "e.quality = 0 OR e.quality IS NULL"),
    "in_empty": (["Or", [["lang", "In", []], ["label", "In", [1, 2.0]]]], "e.label IN (1, 2)"),
    "notin": (["quality", "NotIn", [1]], "e.quality IS NULL OR e.quality NOT IN (1)"),
    "range": (["n_chars", "Gte", 1500.5], "e.n_chars >= 1500.5"),
    "range_text": (["lang", "Gt", "en"], "e.lang > 'en'"),
    "and": (["And", [["lang", "Eq", "en"], ["n_chars", "Lt", 2000]]], "e.lang = 'en' AND e.n_chars < 2000"),
    "or": (["Or", [["lang", "Eq", "de"], ["toxic", "Eq", 1]]], "e.lang = 'de' OR coalesce(e.toxic = 1, false)"),
    "not": (["Not", ["toxic", "Eq", 0]], "e.toxic IS DISTINCT FROM 0"),
    "id": (["And", [["id", "Gt", 20], ["id", "NotIn", [25, 30]]]], "e.vec_id > 20 AND e.vec_id NOT IN (25, 30)"),
    "missing": (["And", [["nothing", "Eq", None], ["nothing", "NotEq", 5], ["label", "Lte", 4]]], "e.label <= 4"),
}
for _name, (_expr, _where) in FILTERS.items():
    filtered(f"knn_filter_{_name}", _expr, _where)
filtered("knn_filtered_scan", ["And", [["source", "In", ["src1", "src2", "src3"]], ["Not", ["quality", "Eq", 0]]]], "e.source IN ('src1', 'src2', 'src3') AND e.quality IS DISTINCT FROM 0")


def scan(name: str, source: str, key: str, expr: list, where: str) -> None:
    """A filter alone, over a driver table."""

    @query(name, f"SELECT {key} FROM {source} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source)
        return rows.where(compile_filter(expr, rows.schema, key)).select(key)


scan("filter_scan_events", "events", "event_id", ["And", [["event_type", "Eq", "click"], ["value", "Gt", 50]]], "event_type = 'click' AND value > 50")
scan("filter_scan_orders", "orders", "o_orderkey", ["Or", [["o_orderpriority", "In", ["1-URGENT", "2-HIGH"]], ["o_totalprice", "Lt", 1000]]], "o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice < 1000")
scan("filter_scan_documents", "documents", "doc_id", ["Not", ["Or", [["lang", "Eq", "en"], ["n_chars", "Gte", 3000]]]], "NOT (lang = 'en' OR n_chars >= 3000)")


@query("knn_include_attrs", f"SELECT e.vec_id AS id, {COS} AS distance, e.lang, e.source FROM {RICH}, {QUERY0} ORDER BY distance, id LIMIT 10")
def knn_include_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(rich(spark, sf_dir), probe(spark, sf_dir), 10, include=["source", "lang", "unknown"])


@query("knn_json", f"SELECT e.vec_id AS id, round({COS}, 9) AS distance, CAST(e.label AS VARCHAR) AS label, e.lang, CAST(e.quality AS VARCHAR) AS quality, '\"note\":' || to_json('say \"' || e.lang || '\"' || chr(10) || chr(92)) AS note FROM {RICH}, {QUERY0} ORDER BY {COS}, e.vec_id LIMIT 10")
def knn_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON records, read back for the comparison; ``note`` is cut out as it is written, escapes and all."""
    note = F.concat(F.lit('say "'), F.col("lang"), F.lit('"\n\\'))
    out = knn.to_json(knn.top_k(rich(spark, sf_dir).withColumn("note", note), probe(spark, sf_dir), 10, include=True))
    distance = F.round(F.get_json_object("json", "$['$distance']").cast("double"), 9).alias("distance")
    written = F.regexp_extract("json", r'"note":"(?:[^"\\]|\\.)*"', 0).alias("note")
    return out.select("id", distance, *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("label", "lang", "quality")], written)


BATCH = "(SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 10 = 0) q"
RANKED = "SELECT qid, rn, id, distance FROM (SELECT q.qid, e.vec_id AS id, {0} AS distance, row_number() OVER (PARTITION BY q.qid ORDER BY {0}, e.vec_id) AS rn FROM embeddings e, " + BATCH + " WHERE {1}) WHERE rn <= 10"


def batch(name: str, metric: str, filters: list | None, where: str) -> None:
    @query(name, RANKED.format(FORM[metric], where))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = vectors(spark, sf_dir)
        asked = docs.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
        return knn.batch_top_k(docs, asked, 10, metric, filters)


batch("knn_batch", "cosine_distance", None, "true")
batch("knn_batch_l2", "euclidean_squared", None, "true")
batch("knn_batch_dot", "dot_product", None, "true")
batch("knn_batch_filtered", "cosine_distance", ["label", "In", [1, 2, 3]], "e.label IN (1, 2, 3)")


@query("knn_int8_rerank", f"SELECT id, distance FROM (SELECT e.vec_id AS id, {COS} AS distance, {I8_COS} AS rough FROM embeddings e, {QUERY0} ORDER BY rough, id LIMIT 64) ORDER BY distance, id LIMIT 10")
def knn_int8_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.int8_top_k(vectors(spark, sf_dir), probe(spark, sf_dir), 10)


@query("knn_int8_only", f"SELECT e.vec_id AS id, {I8_COS} AS distance FROM embeddings e, {QUERY0} ORDER BY distance, id LIMIT 10")
def knn_int8_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.int8_top_k(vectors(spark, sf_dir), probe(spark, sf_dir), 10, exact=False)


@query("knn_ivf")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells written by folder, of which a query reads six of sixteen."""
    docs = vectors(spark, sf_dir)
    centres = knn.fit_cells(docs, 16)
    celled = knn.write_cells(knn.assign_cells(docs, centres), f"{work_dir(spark)}/cells")
    return knn.probe_top_k(celled, centres, probe(spark, sf_dir), 6)


ASKED = "q AS (SELECT vec_id AS qid, embedding, label AS ql FROM embeddings WHERE vec_id % 20 = 0)"
POOLS = (10, 20, 40, 80)
SWEEP = f"""WITH {ASKED}, pairs AS (SELECT q.qid, e.vec_id AS id, {COS} AS d, {I8_COS} AS rough FROM embeddings e, q),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rough, id) AS at, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rn FROM pairs),
cut AS (SELECT p.pool, x.qid, x.id, row_number() OVER (PARTITION BY p.pool, x.qid ORDER BY x.d, x.id) AS rn FROM placed x JOIN (SELECT unnest([10, 20, 40, 80]) AS pool) p ON x.at <= p.pool)
SELECT CAST(pool AS INTEGER) AS pool, round(avg(hit), 9) AS recall FROM (SELECT c.pool, c.qid, count(*) FILTER (t.id IS NOT NULL) / 10 AS hit FROM cut c LEFT JOIN placed t ON c.qid = t.qid AND c.id = t.id AND t.rn <= 10 WHERE c.rn <= 10 GROUP BY c.pool, c.qid) GROUP BY pool"""


def asked_of(docs: DataFrame) -> DataFrame:
    """The query set: every id divisible by 20."""
    return docs.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("q"))


@query("ef_sweep", SWEEP)
def ef_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the int8 candidate stage for several pool sizes."""
    docs = vectors(spark, sf_dir)
    asked = asked_of(docs)
    truth = knn.batch_top_k(docs, asked, 10).select("qid", "id", F.lit(1).alias("hit"))
    got = knn.int8_batch_top_k(docs, asked, POOLS, 10)
    each = got.join(truth, ["qid", "id"], "left").groupBy("pool", "qid").agg((F.count("hit") / 10).alias("hit"))
    return each.groupBy("pool").agg(F.round(F.avg("hit"), 9).alias("recall"))


# The write log that the driver's vectors stand for: four batches of upserts, deletes of every seventh
# id, then every fifth id again under another label.
LOG_SQL = """log AS (
  SELECT 1 + vec_id % 4 AS seq, vec_id AS ord, 'upsert' AS op, vec_id AS id, label FROM embeddings
  UNION ALL SELECT 5, vec_id, 'delete', vec_id, NULL FROM embeddings WHERE vec_id % 7 = 0
  UNION ALL SELECT 6, vec_id, 'upsert', vec_id, label + 100 FROM embeddings WHERE vec_id % 5 = 0
)"""


def write_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)

    def part(rows: DataFrame, seq, op: str, label) -> DataFrame:
        return rows.select(F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.alias("seq"), F.col("id").alias("ord"), F.lit(op).alias("op"), "id", label.cast("int").alias("label"))

    return part(v, 1 + F.col("id") % 4, "upsert", F.col("label")).union(part(v.where("id % 7 = 0"), 5, "delete", F.lit(None))).union(part(v.where("id % 5 = 0"), 6, "upsert", F.col("label") + 100))


FOLD_SQL = "WITH " + LOG_SQL + " SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, ord DESC) AS rn FROM log) WHERE rn = 1 AND op = 'upsert'"


def logged(spark: SparkSession, sf_dir: str, upto: int = 6) -> Collection:
    """The log as a collection, a batch for each seq."""
    v, c = vectors(spark, sf_dir), Collection(spark, work_dir(spark), "log")
    rows = write_log(spark, sf_dir).join(v.select("id", "vector"), "id").withColumn("attrs", attrs("label"))
    rows = rows.select("seq", F.col("ord").cast("int").alias("ord"), "op", "id", *[F.when(F.col("op") == "upsert", F.col(x)).alias(x) for x in ("vector", "attrs")])
    for seq in range(1, upto + 1):
        c.append(rows.where(F.col("seq") == seq), seq - 1, "cosine_distance")
    return c


def labels_of(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.col("attributes.label.i").cast("int").alias("label"))


@query("wal_replay", FOLD_SQL)
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON segments, one for each seq, read and folded; vectors travel along."""
    v = vectors(spark, sf_dir)
    rows = write_log(spark, sf_dir).join(v.select("id", "vector"), "id")
    entry = F.when(F.col("op") == "delete", F.concat(F.lit("["), "id", F.lit(",null]"))).otherwise(F.concat(F.lit("["), "id", F.lit(","), F.to_json("vector"), F.lit(',{"label":'), "label", F.lit("}]")))
    lines = rows.select("seq", F.struct("ord", entry.alias("e")).alias("x")).groupBy("seq").agg(F.array_sort(F.collect_list("x")).alias("x"))
    body = F.concat(F.lit('{"docs":['), F.array_join(F.transform("x", lambda x: x["e"]), ","), F.lit("]}"))
    live = fold.fold(ingest.log_segment(lines.select("seq", body.alias("body"))))
    return live.where(F.size("vector") > 0).select("id", F.element_at("attrs", "label")["i"].cast("int").alias("label"))


@query("wal_append", FOLD_SQL)
def wal_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches appended to a collection's log and read back."""
    return labels_of(logged(spark, sf_dir).documents())


@query("wal_list", "WITH " + LOG_SQL + " SELECT seq, count(*) AS entries FROM log WHERE seq > 3 GROUP BY seq")
def wal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches after the third, as the store lists them."""
    return logged(spark, sf_dir).store.log(2).groupBy("seq").agg(F.count("*").alias("entries")).orderBy("seq")


@query("compaction_equivalence", FOLD_SQL)
def compaction_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted after the third batch with the later ones on top, and the same compacted again: what both give."""
    rest = logged(spark, sf_dir).store

    def grown() -> Collection:
        c = logged(spark, sf_dir, 3)
        c.compact()
        for n in (3, 4, 5):
            c.append(rest.log(n - 1).where(F.col("seq") == n + 1), n, "cosine_distance")
        return c

    again = grown()
    again.compact()
    return labels_of(grown().documents()).intersect(labels_of(again.documents()))


@query("snapshot_write", "WITH " + LOG_SQL + f" SELECT l.id, l.label, list_dot_product({A}, {A}) AS norm2 FROM log l JOIN embeddings e ON l.id = e.vec_id WHERE seq <= 3")
def snapshot_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's own table, with the stored norms."""
    c = logged(spark, sf_dir, 3)
    c.compact()
    return c.store.snapshot()[1].select("id", F.col("attributes.label.i").cast("int").alias("label"), "norm2")


@query("snapshot_scan", "WITH " + LOG_SQL + " SELECT id, label FROM log WHERE seq <= 3")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = logged(spark, sf_dir, 3)
    c.compact()
    return labels_of(c.documents())


@query("upsert_fold", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE CAST(label AS VARCHAR) END AS label FROM embeddings")
def upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-document replacement: the new rows have no label."""
    docs = vectors(spark, sf_dir).select("id", F.col("label").cast("string").alias("label"))
    return fold.upsert(docs, docs.where("id % 5 = 0").select("id"))


@query("delete_ids", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 7 <> 0")
def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vectors(spark, sf_dir).select("id", "label")
    return fold.delete_ids(docs, docs.where("id % 7 = 0").select("id"))


@query("delete_by_filter", f"SELECT e.vec_id AS id, e.lang FROM {RICH} WHERE NOT (e.lang = 'en' AND e.n_chars < 1000)")
def delete_by_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rich(spark, sf_dir).select("id", "lang", "n_chars")
    return docs.where(~compile_filter(["And", [["lang", "Eq", "en"], ["n_chars", "Lt", 1000]]], docs.schema)).select("id", "lang")


@query("write_batch", "SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE (label <> 3 OR vec_id % 5 = 0) AND vec_id % 10 <> 0")
def write_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch: delete by filter on the state before it, then upserts, then deletes by id."""
    c, docs = collection(spark, sf_dir), vectors(spark, sf_dir)
    new = docs.where("id % 5 = 0").withColumn("label", F.col("label") + 100)
    c.write_tables(new.select("id", "vector", attrs("label").alias("attrs")), docs.where("id % 10 = 0").select("id"), ["label", "Eq", 3])
    return labels_of(c.documents())


@query("ns_stats", "SELECT count(*) AS count, max(len(embedding)) AS dim FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 5 = 0")
def ns_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logged(spark, sf_dir).stats()
    return spark.createDataFrame([(out["count"], out["dim"])], "count long, dim long")


#: FNV-1a in DuckDB: a fold over the id's digits in 128 bits, from the hash of the constant prefix.
FNV_SQL = f"list_reduce(list_prepend({fnv1a(key_of('serve-bench') + bytes(1))}::UHUGEINT, list_transform(range(1, length(CAST(vec_id AS VARCHAR)) + 1), lambda i: ord(CAST(vec_id AS VARCHAR)[i])::UHUGEINT)), lambda h, b: (xor(h, b) * {PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query("shard_assign", f"SELECT vec_id AS id, CAST({FNV_SQL} % 4 AS BIGINT) AS shard FROM embeddings")
def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", shard("serve-bench", F.col("id"), 4).alias("shard"))


@query("shard_write", f"SELECT CAST({FNV_SQL.replace(str(fnv1a(key_of('serve-bench') + bytes(1))), str(fnv1a(key_of('vectors') + bytes(1))))} % 4 AS BIGINT) AS shard, count(*) AS rows FROM embeddings GROUP BY 1")
def shard_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A write split by the hash of the id, upserts and deletes alike: the rows of each shard's folder."""
    c = collection(spark, sf_dir, shards=4)
    return c.store.snapshot()[1].groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("rows"))


@query("shard_query", f"SELECT e.vec_id AS id, {COS} AS distance FROM embeddings e, {QUERY0} WHERE e.vec_id % 7 <> 0 ORDER BY distance, id LIMIT 10")
def shard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sharded collection's scatter query, after deletes that were routed like the rows."""
    c = collection(spark, sf_dir, shards=4)
    c.write_tables(deletes=vectors(spark, sf_dir).where("id % 7 = 0").select("id"))
    return c.query(probe(spark, sf_dir), 10)


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("shard", shard("serve-bench", F.col("id"), 4))


@query("shard_knn", f"SELECT e.vec_id AS id, {COS} AS distance FROM embeddings e, {QUERY0} ORDER BY distance, id LIMIT 10")
def shard_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.sharded_top_k(sharded(spark, sf_dir), probe(spark, sf_dir), 10)


@query("shard_merge", f"SELECT e.vec_id AS id, {L2} AS distance FROM embeddings e, {QUERY0} ORDER BY distance, id LIMIT 10")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping partial results: the merge keeps each id once."""
    docs, q = vectors(spark, sf_dir), probe(spark, sf_dir)
    low = knn.top_k(docs, q, 10, "euclidean_squared", filters=["id", "Lt", 300])
    high = knn.top_k(docs, q, 10, "euclidean_squared", filters=["id", "Gte", 100])
    return knn.merge_shards(low.union(high), 10)


@query("shard_stats", "SELECT count(*) AS count, max(len(embedding)) AS dim FROM embeddings")
def shard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = sharded(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("count"), F.max(F.size("vector")).alias("dim"))
    return each.agg(F.sum("count").alias("count"), F.max("dim").cast("long").alias("dim"))


@query("shard_merge_overlap", f"""WITH {ASKED}, shards AS (SELECT vec_id, embedding, vec_id % 4 AS shard FROM embeddings),
one AS (SELECT q.qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.qid ORDER BY {COS}, e.vec_id) AS rn FROM embeddings e, q),
each AS (SELECT q.qid, e.shard, e.vec_id AS id, {COS} AS d, row_number() OVER (PARTITION BY q.qid, e.shard ORDER BY {COS}, e.vec_id) AS rn FROM shards e, q),
merged AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rn FROM each WHERE rn <= 3)
SELECT round(avg(x), 9) AS recall FROM (SELECT o.qid, count(m.id) / count(*) AS x FROM one o LEFT JOIN merged m ON o.qid = m.qid AND o.id = m.id AND m.rn <= 10 WHERE o.rn <= 10 GROUP BY o.qid)""")
def shard_merge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact ranking is left when each of four shards gives only its three nearest."""
    docs = vectors(spark, sf_dir)
    asked = asked_of(docs)
    each = None
    for s in range(4):
        part = knn.batch_top_k(docs.where(F.col("id") % 4 == s), asked, 3)
        each = part if each is None else each.union(part)
    best = Window.partitionBy("qid").orderBy("distance", "id")
    merged = each.withColumn("rn", F.row_number().over(best)).where("rn <= 10")
    return evaluate.recall_at_k(knn.batch_top_k(docs, asked, 10), merged).select(F.round("recall", 9).alias("recall"))


# Evaluation: int8 rankings (a pool of ten, no more) against the exact ones; relevance is the query's label. Queries: every
# id divisible by 20, against all rows.
RANK_CTE = f"""{ASKED},
pairs AS (SELECT q.qid, e.vec_id AS id, {COS} AS d, {I8_COS} AS rough FROM embeddings e, q),
exact AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rn FROM pairs) WHERE rn <= 10),
pool AS (SELECT * FROM (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY rough, id) AS place FROM pairs) WHERE place <= 10),
got AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rn FROM pool),
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
judged AS (SELECT g.qid, g.rn, CASE WHEN e.label = q.ql AND g.id <> g.qid THEN 1 ELSE 0 END AS rel FROM got g JOIN q ON g.qid = q.qid JOIN embeddings e ON g.id = e.vec_id)"""


def rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The exact ranking, the one by codes, which of its rows are relevant, and how many rows are for each query."""
    docs = vectors(spark, sf_dir)
    asked = asked_of(docs)
    exact_ = knn.batch_top_k(docs, asked, 10)
    got = knn.int8_batch_top_k(docs, asked, [10], 10)
    ask = docs.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("label").alias("ql"))
    met = got.join(docs.select("id", "label"), "id").join(ask, "qid")
    relevant = met.where("label = ql and id <> qid").select("qid", "id")
    sizes = ask.join(docs.groupBy(F.col("label").alias("ql")).count(), "ql").select("qid", (F.col("count") - 1).alias("n"))
    return exact_, got, relevant, sizes


def metric(name: str, take: Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame], sql: str) -> None:
    """A metric, rounded to nine places: the engines add up in different orders."""

    @query(name, f"WITH {RANK_CTE} SELECT round({sql}, 9) AS value")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = take(*rankings(spark, sf_dir))
        return out.select(F.round(F.col(out.columns[0]), 9).alias("value"))


metric("recall_at_k", lambda e, g, r, n: evaluate.recall_at_k(e, g), "(SELECT avg(x) FROM (SELECT count(g.id) / count(*) AS x FROM exact e LEFT JOIN got g ON e.qid = g.qid AND e.id = g.id GROUP BY e.qid))")
metric("top1_agreement", lambda e, g, r, n: evaluate.top1_agreement(e, g), "(SELECT avg(CASE WHEN e.id = g.id THEN 1.0 ELSE 0.0 END) FROM exact e JOIN got g ON e.qid = g.qid AND e.rn = 1 AND g.rn = 1)")
metric("hit_at_k", lambda e, g, r, n: evaluate.hit_at_k(g, r), "(SELECT avg(x) FROM (SELECT max(rel) AS x FROM judged GROUP BY qid))")
metric("mrr_at_k", lambda e, g, r, n: evaluate.mrr_at_k(g, r), "(SELECT avg(x) FROM (SELECT coalesce(1.0 / min(CASE WHEN rel = 1 THEN rn END), 0) AS x FROM judged GROUP BY qid))")
metric("ndcg_at_k", lambda e, g, r, n: evaluate.ndcg_at_k(g, r, 10, n), "(SELECT avg(coalesce(g.x / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= n.n - 1), 0)) FROM (SELECT qid, sum(CASE WHEN rel = 1 THEN 1 / log2(rn + 1) ELSE 0 END) AS x FROM judged GROUP BY qid) g JOIN q ON g.qid = q.qid JOIN sizes n ON q.ql = n.label)")


@query("latency_percentiles", "SELECT count(*) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"list_sort(list(value))[least(count(*), CAST(floor({p} * count(*)) AS BIGINT) + 1)] AS p{round(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM events")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentile_floor(table(spark, sf_dir, "events"), F.col("value"), [0.5, 0.95, 0.99]).withColumn("mean", F.round("mean", 6))


@query("percentile_ceil", "SELECT " + ", ".join(f"list_sort(list(value))[CAST(ceil({p} * count(*)) AS BIGINT)] AS p{round(p * 100)}" for p in (0.5, 0.9, 0.95)) + " FROM events")
def percentile_ceil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.percentile_ceil(table(spark, sf_dir, "events"), F.col("value"), [0.5, 0.9, 0.95])


@query("ingest_columns", "SELECT vec_id AS id, embedding AS vector, label FROM embeddings")
def ingest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a hundred ids as parallel arrays, back to rows."""
    rows = vectors(spark, sf_dir)
    batches = rows.groupBy(F.floor(F.col("id") / 100).alias("b")).agg(F.collect_list(F.struct("id", "vector", "label")).alias("r"))
    columns = batches.select(*[F.col(f"r.{c}").alias(c) for c in ("id", "vector", "label")])
    return ingest.from_columns(columns, ["label"]).drop("pos")


@query("ingest_rows", "SELECT vec_id AS id, embedding AS vector, label, CAST(NULL AS VARCHAR) AS kind FROM embeddings")
def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = vectors(spark, sf_dir).select(F.to_json(F.struct("id", "vector", "label")).alias("value"))
    return ingest.from_rows(spark, lines, "id long, vector array<float>, label int, kind string")


@query("text_cards", "SELECT doc_id, CASE WHEN length(text) > 2200 THEN left(text, 1100) || chr(10) || '...' || chr(10) || right(text, 1100) ELSE text END AS card FROM documents WHERE length(text) > 0")
def text_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.text_cards(table(spark, sf_dir, "documents")).select("doc_id", "card")


@query("qa_explode", "SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role <> 'user'")
def qa_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.question_pairs(table(spark, sf_dir, "conversations"))


@query("qa_nested", "SELECT q.text AS question, min(a.text) AS context FROM conversations q JOIN conversations a ON q.conv_id = a.conv_id AND a.turn = 0 WHERE q.role = 'user' AND length(a.text) > 0 GROUP BY q.conv_id, q.turn, q.text")
def qa_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested articles (first turn as context, user turns as questions), read back by gold context."""
    turns = table(spark, sf_dir, "conversations")
    first = turns.where("turn = 0 and length(text) > 0").select("conv_id", F.col("text").alias("context"))
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("text").alias("question"))).alias("qas"))
    data = first.join(asked, "conv_id").select(F.struct(F.col("conv_id").cast("string").alias("title"), F.array(F.struct("context", "qas")).alias("paragraphs")).alias("a"))
    contexts, questions = ingest.questions_of(data.select(F.to_json(F.struct(F.array("a").alias("data"))).alias("value")))
    return questions.join(contexts, questions["gold"] == contexts["ctx"]).select("question", F.col("text").alias("context"))


@query("gen_clustered")
def gen_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.clustered(spark, 2000, 32)


@query("embed_documents")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.embed_texts(table(spark, sf_dir, "documents"))


@query("labelled_queries", "SELECT event_type || '-' || CAST(user_id % 50 AS VARCHAR) AS query, list_sort(list(DISTINCT user_id)) AS relevant FROM events WHERE user_id IN (SELECT vec_id FROM embeddings) GROUP BY 1")
def labelled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds as query texts, users as the paths that the corpus may hold."""
    history = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", (F.col("user_id") % 50).cast("string")).alias("subject"), F.col("user_id").alias("path"))
    return ingest.labelled_queries(history, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path")))
