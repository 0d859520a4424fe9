"""Personal data: base spans against the plain patterns, and bootstrapped discovery."""

import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from vespera.llm import pii

#: The base patterns.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def slow_luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        s += v
    return s % 10 == 0


def slow(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(CARD, text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and slow_luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(PHONE, text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "Z9", "@", ".", "-", "+", " ", "1", "255", "256", "4111 1111-1111 1111", "a.b@c.de", "10.0.0.1", "+1 (017) 555-7713", "(", "٣", "é", "\n", "_", "%", "00", "--"]), max_size=25).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == slow(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1" * 200_000, "1 " * 200_000):
        pii.leftovers(text, pii.base_spans(text))


def test_long_tokens_and_words_are_read_whole():
    local = "ü" * 80
    text = f"write to {local}@intranet now"
    assert pii.leftovers(text, pii.base_spans(text)) == [(9, -1, 9 + 80 + 9)]
    far = "ü@" + "h" * 300
    assert pii.leftovers(far, []) == [(0, -1, 302)]
    a, b = "k" * 90 + "1", "k" * 90 + "2"
    one, two = (pii.contexts(f"{w} 10.0.0.1", [(92, 1, 100)]) for w in (a, b))
    assert one == two and one != pii.contexts("k" * 91 + "1 10.0.0.1", [(93, 1, 101)])
    text = 'x token="0a1b2c3d4e5f", then 10.0.0.1'
    spans = sorted(pii.base_spans(text) + pii.leftovers(text, pii.base_spans(text)))
    assert [text[s[0] : s[2]] for s in spans] == ["0a1b2c3d4e5f", "10.0.0.1"]
    assert {'token=" _', 'x token=" _', '_ ",', 'token=" _ ",'} < set(pii.contexts(text, spans)[0])
    assert pii.is_seed("0a" * 16) and pii.is_seed("aB3" * 11) and not pii.is_seed("1" * 40) and not pii.is_seed("ab" * 20 + "-")


def brute_scores(mentions, min_trust=0.5, min_score=0.9, min_patterns=2, rounds=3):
    """The graph in plain Python: {(token, shape)} accepted."""
    edges = {}
    for token, kind, shape, pattern in mentions:
        edges[token, shape, pattern] = max(edges.get((token, shape, pattern), 0), kind is not None)
    seeds = {(t, s) for (t, s, _), seed in edges.items() if seed}
    score, credible = {x: 1.0 for x in seeds}, {}

    def lower(hits, of, z2=2.7):
        p = min(hits / of, 1)
        return (p + z2 / (2 * of) - math.sqrt(z2 * (p * (1 - p) / of + z2 / (4 * of * of)))) / (1 + z2 / of)

    for _ in range(rounds):
        reach, belief = Counter(p for _, _, p in edges), Counter()
        for t, s, p in edges:
            belief[p, s] += score.get((t, s), 0)
        trust = {k: lower(v, reach[k[0]]) for k, v in belief.items() if v and reach[k[0]] > 1 and lower(v, reach[k[0]]) >= min_trust}
        by = {}
        for (t, s, p), seed in edges.items():
            if not seed and (p, s) in trust:
                by.setdefault((t, s), []).append((p, trust[p, s]))
        fresh = {k: 1 - math.prod(1 - min(x, 0.999) for _, x in v) for k, v in by.items() if len(v) >= min_patterns and any(p[0] != "#" for p, _ in v)}
        fresh = {k: v for k, v in fresh.items() if v >= min_score}
        done, credible = len(fresh) == len(credible), fresh
        if done:
            break
        score = {x: 1.0 for x in seeds} | {k: v for k, v in credible.items() if k not in seeds}
    return set(credible)


def test_graph_scores_equal_brute_force(spark):
    rnd = random.Random(5)
    mentions = []
    for i in range(300):
        shape = rnd.choice(["card", "phone"])
        kind = {"card": 2, "phone": 3}[shape] if rnd.random() < 0.7 else None
        good = rnd.random() < 0.7
        for _ in range(rnd.randrange(1, 5)):
            mentions.append((f"t{i}", kind, shape, f"{shape if good else 'any'} {rnd.randrange(6)} _"))
        if rnd.random() < 0.3:
            mentions.append((f"t{i}", kind, shape, "#form"))
    table = spark.createDataFrame(mentions, "token string, kind int, shape string, pattern string")
    _, accepted = pii.score_graph(table)
    want = brute_scores(mentions)
    assert {(r.token, r.shape) for r in accepted.collect()} == want and len(want) > 10


def test_hidden_seeds_are_found_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.kind: (r.hidden, r.found) for r in pii.hidden_yield(docs).collect()}
    assert got["secret"][1] >= 0.9 * got["secret"][0] > 20


def test_discovery_by_context_and_defined_cases(spark):
    people = [f"please write to contact address user{i}@mail{i}.example.com today or later" for i in range(12)]
    cards = [f"my card number is {n} and more" for n in ("4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011000990139424", "6011111111111117", "5105105105105100", "3530111333300000")]
    unseen = ["please write to contact address user77@intranet today or later", "my card number is 4111111111111112 and more"]
    clean = ["plain words only", "serial 123456789012345 of a part", None, "", "x" * 100_000]
    texts = people + cards + unseen + clean
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, people[0], "c"), (0, people[0], "c")], "doc_id long, text string, spans string")
    rows = pii.find(docs).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        base = slow(t or "")
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        if i not in (20, 21):
            assert got[i].spans == want
    a = texts[20].index("user77")
    assert got[20].spans == f"email:{a}:{a + len('user77@intranet')}"
    b = texts[21].index("4111")
    assert got[21].spans == f"card:{b}:{b + 16}"
    assert pii.find(docs.limit(0)).count() == 0
