"""Write batches as DataFrames: column form, row form, log segments; text cards and question tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vespera.functions.vectors import problem

#: Names that no attribute may have.
RESERVED = ("id", "vector", "attributes")


class BatchError(ValueError):
    """A write batch that is refused as a whole."""


def check_names(names: list[str]) -> None:
    for n in names:
        if n in RESERVED or n.startswith("$"):
            raise BatchError(f"{n!r} cannot name an attribute")


def from_columns(batch: DataFrame, attrs: list[str]) -> DataFrame:
    """Rows of a batch whose cells are parallel arrays: id, vector and each attribute."""
    check_names(attrs)
    names = ["id", "vector", *attrs]
    uneven = batch.where(F.array_max(F.array(*[F.size(n) for n in names])) != F.array_min(F.array(*[F.size(n) for n in names])))
    if uneven.take(1):
        raise BatchError("the columns of a batch are of different lengths")
    return batch.select(F.posexplode(F.arrays_zip(*names)).alias("pos", "r")).select("pos", *[F.col(f"r.`{n}`").alias(n) for n in names])


def from_rows(spark: SparkSession, lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines (column value) under a DDL schema with id and vector; absent attributes are null."""
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def tagged(column: Column, kind: str) -> Column:
    """A typed column as tagged cells."""
    slot = {"boolean": "b", "tinyint": "i", "smallint": "i", "int": "i", "bigint": "i", "float": "f", "double": "f", "string": "s"}[kind]
    types = {"b": "boolean", "i": "bigint", "f": "double", "s": "string"}
    return F.when(column.isNotNull(), F.struct(*[(column if n == slot else F.lit(None)).cast(t).alias(n) for n, t in types.items()]))


def log_segment(lines: DataFrame) -> DataFrame:
    """(seq, ord, op, id, vector, attrs) of segments: seq and a JSON body {"docs": [[id, vector|null, attrs?], ...]}."""
    docs = F.from_json(F.get_json_object("body", "$.docs"), "array<array<string>>")
    entry = lines.select("seq", F.posexplode(docs).alias("ord", "e"))
    vector = F.from_json(F.try_element_at("e", F.lit(2)), "array<float>")
    raw = F.from_json(F.try_element_at("e", F.lit(3)), "map<string, string>")
    text = F.try_element_at("e", F.lit(3))
    return entry.select("seq", "ord", F.when(F.try_element_at("e", F.lit(2)).isNull(), "delete").otherwise("upsert").alias("op"), F.col("e")[0].cast("long").alias("id"), vector.alias("vector"), F.transform_values(raw, lambda k, v: _cell(k, v, text)).alias("attrs"))


def _cell(name: Column, value: Column, text: Column) -> Column:
    """A JSON scalar as a tagged cell; whether it was quoted is read from the object's own text."""
    quoted = F.regexp_like(text, F.concat(F.lit('"'), F.regexp_replace(name, r"([\\^$.|?*+()\[\]{}])", r"\\$1"), F.lit('"\\s*:\\s*"')))
    number = value.try_cast("bigint")
    real = value.try_cast("double")
    bare = ~quoted
    return F.when(value.isNotNull(), F.struct(F.when(bare & value.isin("true", "false"), value == "true").alias("b"), F.when(bare & ~value.contains(".") & ~F.lower(value).contains("e"), number).alias("i"), F.when(bare & (value.contains(".") | F.lower(value).contains("e") | number.isNull()) & ~value.isin("true", "false"), real).alias("f"), F.when(quoted, value).alias("s")))


def validate(rows: DataFrame, dim: int | None, metric: str) -> int:
    """The dimension of a batch, or an error: nothing of a faulty batch is applied."""
    bad = F.when(F.col("id").isNull() | (F.col("id") < 0), "id").otherwise(problem(F.col("vector"), metric))
    facts = rows.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi"), F.max(bad).alias("bad")).first()
    if facts["bad"]:
        raise BatchError(f"a row of the batch has a bad {facts['bad']}")
    if facts["lo"] is None:
        return dim or 0
    if facts["lo"] != facts["hi"] or dim and facts["hi"] != dim:
        raise BatchError("the vectors of a batch must have the collection's dimension")
    return facts["hi"]


#: Names, endings and folders of files that must not be read.
SENSITIVE_NAMES = (".env", ".dev.vars", ".git-credentials", ".netrc", ".npmrc", ".pypirc", "credentials.json", "credentials", "id_dsa", "id_ecdsa", "id_ecdsa_sk", "id_ed25519", "id_ed25519_sk", "id_rsa", "secrets.json", "secrets.yaml", "secrets.yml", "service-account.json")
SENSITIVE_ENDS = (".env", ".pem", ".key", ".p12", ".pfx", ".jks")
SENSITIVE_FOLDERS = (".ssh/", ".gnupg/", ".aws/")
MAX_CARD_BYTES = 131_072


def is_sensitive(path: Column) -> Column:
    """Whether a path's name, ending or a folder of it says that the file may hold secrets."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    tests = [name.isin(*SENSITIVE_NAMES), name.rlike(r"^\.env[._-]"), F.concat(F.lit("/"), low).contains("/.git/")]
    tests += [low.endswith(e) for e in SENSITIVE_ENDS] + [low.contains(f) for f in SENSITIVE_FOLDERS]
    return reduce(lambda a, b: a | b, tests)


def text_cards(docs: DataFrame, text_col: str = "text", limit: int = 2200, half: int = 1100, path_col: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Texts cut to a card: long ones keep their first and last part.

    Empty texts, binary ones (with a NUL), those of more than ``max_bytes`` bytes and those under a sensitive
    path have no card.
    """
    t = F.col(text_col)
    card = F.when(F.length(t) > limit, F.concat(F.substring(t, 1, half), F.lit("\n...\n"), F.substring(t, -half, half))).otherwise(t)
    fit = t.isNotNull() & (F.length(t) > 0) & ~t.contains("\0")
    if max_bytes is not None:
        fit = fit & (F.octet_length(t) <= max_bytes)
    if path_col is not None:
        fit = fit & ~F.coalesce(is_sensitive(F.col(path_col)), F.lit(False))
    return docs.where(fit).withColumn("card", card)


def file_cards(spark: SparkSession, path: str, max_bytes: int = MAX_CARD_BYTES) -> DataFrame:
    """(path, card) of the text files below a folder; large, binary, empty and sensitive ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length").between(1, max_bytes))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return text_cards(files.select("path", text.alias("text")), path_col="path").select("path", "card")


ARTICLES = "struct<data: array<struct<title: string, paragraphs: array<struct<context: string, qas: array<struct<question: string>>>>>>>"


def questions_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested articles (column value: JSON of data, paragraphs, qas) as contexts (ctx, text) and questions (question, gold).

    Equal contexts are one; ``gold`` is the number of the question's context. Numbers follow the contexts' hashes.
    """
    data = lines.select(F.explode(F.from_json("value", ARTICLES)["data"]).alias("a")).select(F.explode("a.paragraphs").alias("p"))
    pairs = data.select(F.col("p.context").alias("text"), "p.qas").where("text is not null").withColumn("ctx", F.xxhash64("text"))
    contexts = pairs.select("ctx", "text").distinct()
    questions = pairs.select(F.explode("qas.question").alias("question"), F.col("ctx").alias("gold")).where("question is not null")
    return contexts, questions


def question_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the reply that follows it."""
    a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    b = turns.where("role <> 'user'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return a.join(b, ["conv_id", "turn"])


def labelled_queries(history: DataFrame, corpus: DataFrame, limit: int | None = None) -> DataFrame:
    """(query, relevant): subjects of a history (subject, path) with those of their paths that the corpus (path) holds.

    A subject that occurs more than once is one query; subjects without a path in the corpus are left out. With a
    limit the first subjects by text are taken.
    """
    known = history.select("subject", "path").distinct().join(corpus.select("path").distinct(), "path", "left_semi")
    out = known.groupBy(F.col("subject").alias("query")).agg(F.array_sort(F.collect_set("path")).alias("relevant"))
    return out.orderBy("query").limit(limit) if limit else out
