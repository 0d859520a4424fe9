"""Main text of pages: site templates, side parts, article text kept whole."""

import html
import random
import re
from collections import Counter

import pytest

from vespera.llm import html_text
from vespera.llm.html_text import blocks, main_text


def text(page):
    return "\n".join(t for t, side, _ in blocks(page) if not side)


ARTICLE = "<article><h1>A &amp; B</h1><p>one\n two<b> three</b>&nbsp;four<br>five<p>six</article>"
WANT = "A & B\none two three four five\nsix"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li>menu</li></ul></nav>{ARTICLE}<footer>foot",
        f"<div class='site-header'>top</div><div class=cookie-notice><p>we use</p></div>{ARTICLE}<aside>side</aside>",
        f"<main><div role=navigation>x</div>{ARTICLE}<section id=comments><article><p>a comment</p></article></section></main>",
        ARTICLE.replace("<p>six", "<p>six<div class='ad'>buy</div><form><label>mail</label><input></form><script>var a='</p>';</script>"),
        ARTICLE.replace("article>", "main>"),
        ARTICLE.replace("<article>", "<div class='post-content has-sidebar'>").replace("</article>", "</div>") + "<div class=sidebar>x</div>",
        f"<body class='no-sidebar'><div class='wrapper has-ads'>{ARTICLE}</div></body>",
        ARTICLE.replace("<article>", "<article><header><h1>A &amp; B</h1><p>by me</p></header>").replace("</header><h1>A &amp; B</h1>", "</header>"),
        ARTICLE.replace("<h1>A &amp; B</h1>", "<div class='article-header'><h1>A &amp; B</h1><span>share</span></div>"),
        ARTICLE.replace("<p>six", "<p>six<section class=comments><article><p>a much longer comment than the text of the article is</p></article></section>"),
        f"<!-- <article>no</article> --><noscript>turn on</noscript><template>t</template>{ARTICLE}",
    ],
)
def test_side_parts_go_and_article_text_stays(page):
    assert text(page) == WANT


def test_broken_markup_and_text_without_markup():
    assert text("plain &lt;text&gt; &#233; &zz; 1 < 2") == "plain <text> é &zz; 1 < 2"
    assert text("<p>a<div>b</p>c<td>d</b></i>e") == "a\nb\nc\nde"
    assert text("<ul><li>x<ul><li>y</ul><li>z</ul>") == "x\ny\nz"
    assert text("<" * 1000) == "<" * 1000
    deep = "<div>" * 20_000 + "deep"
    assert text(deep) == "deep"


def test_templates_are_deleted_per_host_and_passages_stay(spark):
    rows = []
    for i in range(20):
        box = "<div class=x><p>Box of this site</p></div>"
        body = f"<div><p>only here {i}</p><p>Common words</p></div>" if i % 2 else f"<article><p>only here {i}</p><p>Common words</p>{box}</article>"
        rows.append((i, f"http://a.example/{i}", f"<div>Top line</div>{box}{body}<div><p>Bottom</p></div>", "c"))
    rows.append((20, "http://b.example/", "<div>Top line</div><p>alone</p>", "c"))
    rows += [(21, None, None, "c"), (22, "", "", "c"), (23, "nohost", "<p></p>", "c"), (20, "http://b.example/", "<div>Top line</div><p>alone</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in main_text(pages).collect()}
    for i in range(20):
        assert got[i].text == (f"only here {i}" if i % 2 else f"only here {i}\nCommon words")
        assert got[i].n_chars == len(got[i].text) and got[i].n_template > 0
    assert got[20].text == "Top line\nalone"
    assert [got[i].text for i in (21, 22, 23)] == ["", "", ""]
    assert main_text(pages).count() == len(rows) and main_text(pages.limit(0)).count() == 0


NAMES = ["post reply-guide", "content search-tips", "article tags", "post login-help", "comment-policy", "related-work"]


@pytest.mark.parametrize("name", NAMES)
def test_names_do_not_delete_a_pages_only_content(spark, name):
    words = "the page's only text, which goes on for some time " * 8
    menu = "<div class=menu><a href=/a>Home</a> <a href=/b>About</a></div>"
    rows = [(i, f"http://n.example/{i}", f"{menu}<div class='{name}'><p>{words}{i}</p></div>") for i in range(4)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{words}{i}" for i in range(4)}


def test_sections_with_telling_words_stay_inside_an_article():
    page = ARTICLE.replace("<p>six", "<section id='related-work'><p>six</p></section><div class='comment-policy'><p>seven</p></div><div class='related-posts'><p>gone</p></div><ul class=share-buttons><li>gone</ul>")
    assert text(page) == WANT + "\nseven"


def test_counts_alone_decide_where_tags_and_names_mean_nothing(spark):
    """Two hosts with the same parts: what recurs on many pages goes, what differs stays."""
    rows, want = [], {}
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    for host in ("p.example", "q.example"):
        fixed = [f"<x-{k} class={word()}>{' '.join(word() for _ in range(8))}</x-{k}>" for k in "abc"]
        section = [f"<div class={word()}>{' '.join(word() for _ in range(5))}</div>" for _ in range(3)]
        for i in range(30):
            own = [" ".join(word() for _ in range(20)) for _ in range(3)]
            body = "".join(f"<div class=k{j}>{t}</div>" for j, t in enumerate(own))
            html_ = f"<div>{fixed[0]}</div><div>{fixed[1]}</div><div class=z>{body}</div>{section[i % 3]}<div>{fixed[2]}</div>"
            rows.append((len(rows), f"https://{host}/{i}", html_))
            want[rows[-1][0]] = "\n".join(own)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in main_text(pages).collect()} == want
    ignoring = {r.page_id: r.text for r in main_text(pages, min_pages=10**9).collect()}
    assert all(ignoring[i] != want[i] for i in want)


def brute_templates(pages):
    """Hashes by host that enough pages hold, in plain Python."""
    by, n = {}, Counter()
    for url, page in pages:
        host = re.match(r"\w+://([^/]*)", url)[1]
        n[host] += 1
        for h in {h for _, _, chain in blocks(page) for h in chain}:
            by[host, h] = by.get((host, h), 0) + 1
    return {k for k, c in by.items() if c >= 3 and c >= min(0.1 * n[k[0]], 20)}


@pytest.mark.parametrize("pairs", [1_000_000, 0])
def test_templates_equal_brute_force(spark, monkeypatch, pairs):
    monkeypatch.setattr(html_text, "BROADCAST_PAIRS", pairs)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = [(r.page_id, r.url, r.html) for r in pages.collect()]
    known = brute_templates([x[1:] for x in source])
    got = {r.page_id: r.n_template for r in main_text(pages).collect()}
    want = {i: sum(bool({(re.match(r"\w+://([^/]*)", u)[1], h) for h in chain} & known) for _, _, chain in blocks(page)) for i, u, page in source}
    assert got == want and sum(want.values()) > 20


def test_whole_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in main_text(pages).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in want if b)
