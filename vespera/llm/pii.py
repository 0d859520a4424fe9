"""Personal data by bootstrapped contextual extraction.

Seeds. Four kinds of identifier (email, ip, card, phone) are found in whole texts by fixed
patterns; these base spans are always kept. Seeds of a fifth kind, secret, are long random-looking
tokens (32 characters or more: hexadecimal, or capitals, small letters and digits mixed); alone they are not reported.

Bootstrapping. Every seed, and every other token of identifier-like shape that the fixed
patterns left over, is an instance with patterns taken from its surroundings: the two words before, the word before and
the word after, the two words after; as back-off the word before alone, the word after alone, and the masked form of
the token itself. Spark then scores the bipartite graph of patterns and instances in rounds: a pattern is as
trustworthy, for one kind, as the lower confidence bound of the share of its distinct instances that are believed to be of
that kind; an instance is as credible as the noisy-or of its patterns. Instances over the threshold that at least
``min_patterns`` trustworthy patterns support, one of them of words, become spans of that kind wherever their token
occurs in such a context.

Words and tokens enter patterns whole (long ones by their hash). A word that is joined to a token counts up to the next
identifier.

:func:`hidden_yield` measures the method: it hides a third of the seeds and reports how many are found again.

Scale. Texts are read once; what is left of a document is one row with its spans and contexts. Edges are
counted with map-side combining before they are shuffled, so a very common word pair costs one
row per task and instance, and scores travel by equi-joins of written tables, whose hot keys Spark can split.

Defined results: null text counts as empty (no spans); repeated rows get equal results; very long
texts are scanned in linear time; spans that start together are listed by kind; an empty table gives an empty result;
other columns than id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import keep

#: The kinds, in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET = 4, 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Leftover tokens that may be identifiers: nine digits or more, or solid characters on both sides of an at sign.
_LONG_NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?[0-9(](?:[ ().-]?[0-9]){8,}(?![0-9A-Za-z])")
_SOLID = re.compile(r"[^\s@]{2,}")
#: Tokens that may be secrets: letters and digits mixed, read from each digit to both sides.
_FROM_DIGIT = re.compile(r"[0-9][A-Za-z0-9+/_-]*")
_TOKEN_CHARS = _LOCAL_CHARS - frozenset(".%") | frozenset("/")
_HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_WORD = re.compile(r"\S+")
SECRET_LENGTH, SEED_LENGTH = 12, 32
#: Words beyond this length enter a pattern by their hash.
_PLAIN_WORD = 64

Span = tuple[int, int, int]


def _emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain: the local part is the run of its characters left of an at sign."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, 0, end))
        else:
            end = max(end, at)  # what lies before a failed at sign cannot begin a later match
        at = text.find("@", max(end, at + 1))
    return out


def _ips(text: str) -> list[Span]:
    """Four parts at a time of each chain of numbers and points."""
    out = []
    for chain in _CHAIN.finditer(text):
        parts = [m.span() for m in _NUMBER.finditer(text, *chain.span())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(d := text[a:b].lstrip("0")) <= 3 and int(d or 0) <= 255 for a, b in four):
                out.append((four[0][0], 1, four[3][1]))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    return out


def _phones(text: str) -> list[Span]:
    found = (m for m in _PHONE.finditer(text))
    return [(m.start(), 3, m.end()) for m in found if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, by start and kind; ends exclusive, in code points."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += _ips(text) + _cards(text)
        if "+" in text:
            out += _phones(text)
    return sorted(out)


def secrets(text: str) -> list[tuple[int, int]]:
    """Runs of token characters of some length that mix letters and digits."""
    out, end = [], 0
    for m in _FROM_DIGIT.finditer(text):
        start = m.start()
        if start < end:
            continue
        while start > end and text[start - 1] in _TOKEN_CHARS:
            start -= 1
        end = m.end()
        token = text[start:end]
        if len(token) >= SECRET_LENGTH and sum(c.isalpha() for c in token) >= 4:
            out.append((start, end))
    return out


def is_seed(token: str) -> bool:
    """Whether a token that may be a secret looks so random that it serves as a seed."""
    if len(token) < SEED_LENGTH:
        return False
    if _HEX.fullmatch(token):
        return any(c.isalpha() for c in token)
    return token.isalnum() and any(c.islower() for c in token) and any(c.isupper() for c in token)


def leftovers(text: str, spans: list[Span]) -> list[Span]:
    """Tokens of identifier-like shape that touch no base span; kind -1, or SECRET for seeds of that kind."""
    found = []
    at, before = text.find("@"), 0
    while at >= 0:
        start = at
        while start > before and not text[start - 1].isspace():
            start -= 1
        before = at + 1
        if start < at and (m := _SOLID.match(text, at + 1)):
            found.append((start, -1, m.end()))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        found += [(m.start(), -1, m.end()) for m in _LONG_NUMBER.finditer(text)]
        found += [(a, SECRET if is_seed(text[a:b]) else -1, b) for a, b in secrets(text)]
    out, end, k = [], 0, 0
    for span in sorted(found):
        while k < len(spans) and spans[k][2] <= span[0]:
            k += 1
        if span[0] >= end and (k == len(spans) or spans[k][0] >= span[2]):
            out.append(span)
            end = span[2]
    return out


def shape(token: str) -> str:
    """The coarse form of a token: the kind it could be."""
    if "@" in token:
        return "email"
    if sum(c.isalpha() for c in token) >= 4:
        return "secret"
    digits = sum(c.isdigit() for c in token)
    if token.count(".") == 3 and digits == len(token) - 3:
        return "ip"
    return "card" if digits >= 12 and "(" not in token and "+" not in token else "phone"


def _plain(word: str) -> str:
    """A word as patterns hold it: in small letters, digits masked."""
    word = _NUMBER.sub("0", word.lower())
    return word if len(word) <= _PLAIN_WORD else xxhash.xxh3_128_hexdigest(word)


def masked(token: str) -> str:
    """A token's form: runs of letters, and digits by their number."""
    return _NUMBER.sub(lambda m: f"9x{len(m[0])}", re.sub(r"[^\W\d_]+", "a", token))


def contexts(text: str, spans: list[Span]) -> list[list[str]]:
    """The patterns of each span (by start); those of the token's own form begin with a number sign."""
    if not spans:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [w[0] for w in words]
    out = []
    for i, (a, _, b) in enumerate(spans):
        w, v = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
        left_edge = max([words[w][0], *(s[2] for s in spans[max(0, i - 1) : i] if s[2] <= a)])
        right_edge = min([words[v][1], *(s[0] for s in spans[i + 1 : i + 2] if s[0] >= b)])
        before = [text[left_edge:a]] * (left_edge < a) + [text[slice(*words[j])] for j in range(w - 1, max(-1, w - 3), -1)]
        after = [text[b:right_edge]] * (b < right_edge) + [text[slice(*x)] for x in words[v + 1 : v + 3]]
        left, right = [_plain(x) for x in before[:2]], [_plain(x) for x in after[:2]]
        found = []
        if left:
            found.append(f"{left[0]} _")
        if right:
            found.append(f"_ {right[0]}")
        if len(left) == 2:
            found.append(f"{left[1]} {left[0]} _")
        if left and right:
            found.append(f"{left[0]} _ {right[0]}")
        if len(right) == 2:
            found.append(f"_ {right[0]} {right[1]}")
        found.append("#" + _plain(masked(text[a:b])))
        out.append(found)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("shape", pa.string()), ("token", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        counts, sums, base, items = [], [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            spans = base_spans(text)
            counts.append([sum(s[1] == k for s in spans) for k in range(BASE)])
            text_of = joined(spans)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            sums.append(sha256(text_of.encode()).hexdigest())
            rows = []
            each = sorted(spans + leftovers(text, spans))
            for (a, k, b), patterns in zip(each, contexts(text, each)):
                token = text[a:b]
                rows.append({"start": a, "end": b, "kind": k, "shape": KINDS[k] if k >= 0 else shape(token), "token": xxhash.xxh3_128_hexdigest(token.lower()), "patterns": patterns})
            items.append(rows)
        span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
        cols = [batch.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(BASE)), pa.array(sums, pa.string()), pa.array(base, pa.list_(span)), pa.array(items, pa.list_(item))]
        yield pa.record_batch(cols, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "items"])


SCANNED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start: long, kind: int, end: long>>, items array<struct<start: long, end: long, kind: int, shape: string, token: string, patterns: array<string>>>"


def bound(hits: Column, of: Column, z2: float = 2.7) -> Column:
    """Lower end of the confidence interval (one-sided, 95 %) of a share, after Wilson."""
    p = F.least(hits / of, F.lit(1.0))
    return (p + z2 / (2 * of) - F.sqrt(F.lit(z2) * (p * (1 - p) / of + z2 / (4 * of * of)))) / (1 + z2 / of)


def score_graph(mentions: DataFrame, rounds: int = 3, min_trust: float = 0.5, min_score: float = 0.9, min_patterns: int = 2) -> tuple[DataFrame, DataFrame]:
    """Score patterns and instances in rounds.

    ``mentions`` has (token, kind, shape, pattern); kind is null for what is no seed. Returns
    (pattern, shape, trust) of trusted patterns and (token, shape, score) of accepted instances.
    A pattern's trust for a shape is the bound of believed / distinct, where believed sums the scores of its distinct
    instances of that shape and distinct counts all its instances of any shape.
    """
    edges = keep(mentions.groupBy("token", "shape", "pattern").agg(F.max(F.col("kind").isNotNull().cast("double")).alias("seed")), "pii-edges")
    reach = keep(edges.groupBy("pattern").agg(F.count("*").alias("reach")).where("reach > 1"), "pii-reach")
    seeds = keep(edges.where("seed = 1").select("token", "shape", F.lit(1.0).alias("score")).distinct(), "pii-seeds")
    score, credible = seeds, seeds.where("false")
    for _ in range(rounds):
        believed = edges.join(score, ["token", "shape"]).groupBy("pattern", "shape").agg(F.sum("score").alias("belief"))
        trust = believed.join(reach, "pattern").withColumn("trust", bound(F.col("belief"), F.col("reach"))).where(F.col("trust") >= min_trust)
        trusted = keep(trust.select("pattern", "shape", "trust"), "pii-trust")
        # Noisy-or of the patterns as a sum of logarithms; seeds keep the score 1.
        words = (~F.col("pattern").startswith("#")).cast("int")
        doubt = edges.where("seed = 0").join(trusted, ["pattern", "shape"]).groupBy("token", "shape").agg(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))).alias("doubt"), F.count("*").alias("patterns"), F.sum(words).alias("words"))
        fine = doubt.withColumn("score", 1 - F.exp("doubt")).where((F.col("score") >= min_score) & (F.col("patterns") >= min_patterns) & (F.col("words") > 0))
        before, credible = credible, keep(fine.select("token", "shape", "score"), "pii-credible")
        if credible.count() == before.count():
            break
        score = keep(seeds.unionByName(credible.join(seeds, ["token", "shape"], "left_anti").select("token", "shape", "score")), "pii-score")
    # A seed that is no base span counts once trusted patterns support it, like any other instance.
    support = edges.where("seed = 1 and shape = 'secret'").join(trusted, ["pattern", "shape"]).groupBy("token", "shape").agg(F.count("*").alias("n"), F.sum(words).alias("words"))
    grown = support.where((F.col("n") >= min_patterns) & (F.col("words") > 0)).select("token", "shape", F.lit(1.0).alias("score"))
    return trusted, keep(credible.unionByName(grown).dropDuplicates(["token", "shape"]), "pii-accepted")


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned documents, their instances, and the instances' patterns."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = keep(rows.mapInArrow(_scan, SCANNED).withColumn("uid", F.monotonically_increasing_id()), "pii-scan")
    items = scanned.where(F.size("items") > 0).select("uid", F.explode("items").alias("i")).select("uid", "i.*")
    kind = F.when(F.col("kind") >= 0, F.col("kind"))
    return scanned, items, items.select("token", kind.alias("kind"), "shape", F.explode(F.array_distinct("patterns")).alias("pattern"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans (base and discovered), and the numbers of
    discovered ones and of all."""
    scanned, items, mentions = _scanned(docs, id_col, text_col)
    trusted, accepted = score_graph(mentions, **options)
    open_ = items.where(f"kind < 0 or kind = {SECRET}").select("uid", "start", "end", "token", "shape", F.explode(F.array_distinct("patterns")).alias("pattern"))
    found = open_.join(accepted.select("token", "shape"), ["token", "shape"]).join(trusted.select("pattern", "shape"), ["pattern", "shape"], "left_semi").select("uid", "start", "end", "shape").distinct()
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("shape")) - 1
    extra = found.groupBy("uid").agg(F.collect_list(F.struct("start", number.cast("int").alias("kind"), "end")).alias("extra"))
    out = scanned.drop("items").join(extra, "uid", "left")
    spans = F.array_sort(F.concat(F.col("base"), F.coalesce(F.col("extra"), F.array().cast("array<struct<start: long, kind: int, end: long>>"))))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"), F.size(F.coalesce("extra", F.array())).cast("long").alias("n_discovered"), F.size(spans).cast("long").alias("n_spans"))


def hidden_yield(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(kind, hidden, found): a third of the distinct seeds, by hash, are not told to the graph; how many it accepts."""
    _, _, mentions = _scanned(docs, id_col, text_col)
    hides = F.pmod(F.xxhash64("token"), F.lit(3)) == 0
    blind = mentions.withColumn("kind", F.when(~hides, F.col("kind")))
    _, accepted = score_graph(blind, **options)
    hidden = mentions.where("kind is not null").where(hides).select("token", "shape").distinct()
    met = hidden.join(accepted.select("token", "shape", F.lit(1).alias("hit")), ["token", "shape"], "left")
    return met.groupBy(F.col("shape").alias("kind")).agg(F.count("*").alias("hidden"), F.count("hit").alias("found"))
