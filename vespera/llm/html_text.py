"""Main text of web pages by removal of site templates.

Every page is parsed into a tree, and every element subtree that holds text is hashed bottom-up (tag,
text and children). Spark counts per host how many pages hold each subtree; subtrees that
recur across many pages of their host are its template and are deleted wherever they occur.
"Many" is ``min_share`` of the host's pages, but no less than ``min_pages`` and never more than ``enough_pages``.

What a single page says about itself removes the rest: navigation, headers, footers, asides, forms,
scripts, styles, notices, adverts and reader comments by tag or role, and, where the page marks an
article, all that lies outside it. Names of classes decide less: a name counts only if all its words are
of that kind (comment-list, but not comment-policy), and where no article is marked, parts with such names stay if
next to nothing else is left of the page once templates are gone.

Running text inside a marked article (paragraphs, headings, list items, quotes, tables) is never
deleted as template: a passage that many articles share is text. Elsewhere it may be.

Scale. Html is parsed once; (host, subtree) counts are combined before they
are shuffled, so a host with a third of all pages costs one row per task and subtree. While all templates together are
few (``BROADCAST_PAIRS``, and ``HOST_LIST`` for a host) they are broadcast as lists by host. Beyond that pages meet them by
(host, subtree), in a join that Spark can split at a hot one, and texts are shuffled once.

Defined results: null or empty html, and pages without any text left, give an empty text; repeated
rows get equal results; null urls share one unnamed host; very long pages are read whole, in linear time; an empty table
gives an empty result; other columns than id, url and html are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vespera.llm.common import keep

# Element names and words of class, id and role attributes.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RUNNING = frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option datalist button map".split())
SIDE = frozenset("nav header footer aside form menu dialog search".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
SIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adslot adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer form gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended recommendations related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar trending widget widgets".split())
#: Words that say nothing of a part's kind beside one that does, as in comment-list or site-footer.
NEUTRAL_WORDS = frozenset("area article articles bar big block body bottom box button buttons col column component container content count desktop entry field fields fixed global group holder icon icons inner item items left link links list main media mini mobile module new news outer page pages panel post posts primary right row secondary section site slot small sticky stories story sub text title top unit wrap wrapper zone".split())
MAIN_WORDS = frozenset("article articlebody content entry maincontent post postbody story".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]), "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"])}
STOPS = frozenset("table ul ol dl div section article main body html blockquote aside nav header footer form fieldset".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: Words that only say what a part has or lacks, as in has-sidebar.
_MODIFIER = re.compile(r"(?<![\w-])(?:has|no|with|without|is|js)[-_][\w-]+")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "side", "main", "head", "kids", "hash")

    def __init__(self, tag: str, side: int = 0, main: bool = False, head: bool = False):
        self.tag, self.side, self.main = tag, side, main
        self.head = head  # a header by its tag or class, whose headings may title an article
        self.kids: list = []  # texts and nodes, in page order
        self.hash = 0


#: Templates that are broadcast: pairs (host, subtree) in all, and of one host.
BROADCAST_PAIRS, HOST_LIST = 1_000_000, 2_000
#: How surely a part is no main text: names that speak for both, names alone, tags and roles.
BOTH, NAMED, MARKED = 1, 2, 3


def _names(attrs: dict) -> tuple[set[str], bool]:
    """The side words of the class and id names of which all words are side words or neutral, and whether a name says main."""
    side: set[str] = set()
    main = False
    for name in _MODIFIER.sub("", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").split():
        whole = re.sub("[^a-z]", "", name.lower())
        words = {w.lower() for w in _WORD.findall(name)} if whole not in SIDE_WORDS else {whole}
        if (hit := words & SIDE_WORDS) and words <= SIDE_WORDS | NEUTRAL_WORDS:
            side |= hit
        elif whole in MAIN_WORDS or not hit and words & MAIN_WORDS:
            main = True
    return side, main


_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: What ends a tag, or opens a quoted value.
_VALUE = re.compile(r""">|=\s*["']""")
_TELLING = re.compile("class|id|role|hidden|style|itemprop", re.I)
#: Elements whose content is not markup, with what ends them.
_RAW = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>?", re.I) for t in ("script", "style", "title", "textarea", "noembed", "noframes", "xmp", "iframe")}


class _Tree:
    """Builds the tree of a page; broken markup is read as browsers mostly do."""

    def __init__(self, page: str):
        self.root = Node("html")
        self.stack = [self.root]
        self.names = ["html"]
        self.open: dict[str, int] = {}  # by quote: a tag from which on no value in it is closed
        at = done = 0
        while (lt := page.find("<", at)) >= 0:
            at = lt + 1
            if not (page[at : at + 1] in ("!", "?") or (name := _NAME.match(page, at))):
                continue  # a lone less-than sign is text
            if lt > done:
                self.text(page[done:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = done = end + 3 if end >= 0 else len(page)
                continue
            end = self.tag_end(page, lt)
            at = done = end + 1
            if page[lt + 1] in "!?":
                continue
            tag = name[0].lower()
            if tag[0] == "/":
                self.end(tag[1:])
            elif raw := _RAW.get(tag):
                over = raw.search(page, at)
                at = done = over.end() if over else len(page)
            else:
                self.start(tag, page[name.end() : end])
        if done < len(page):
            self.text(page[done:])

    def tag_end(self, page: str, lt: int) -> int:
        """Where the tag ends: the first ">" outside quoted values; a quote that stays open is not one."""
        end = page.find(">", lt)
        if end < 0:
            return len(page)
        if page.find('"', lt, end) < 0 and page.find("'", lt, end) < 0:
            return end
        at = lt
        while m := _VALUE.search(page, at):
            if m[0] == ">":
                return m.start()
            quote = m[0][-1]
            if lt > self.open.get(quote, len(page)):
                close = -1  # no such quote follows
            elif (close := page.find(quote, m.end())) < 0:
                self.open[quote] = lt
            if close < 0:
                return end
            at = close + 1
        return end

    def text(self, data: str) -> None:
        self.stack[-1].kids.append(unescape(data) if "&" in data else data)

    def start(self, tag: str, attrs: str) -> None:
        side, main = MARKED if tag in SIDE or tag in UNSEEN else 0, tag in ("article", "main")
        head = tag == "header"
        if attrs and tag not in ("a", "html", "body", "meta", "img") and _TELLING.search(attrs):
            d = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed([*_ATTRIBUTE.finditer(attrs)])}
            role = d.get("role", "").lower()
            said, says_main = _names(d) if tag not in HEADINGS and ("class" in d or "id" in d) else ((), False)
            head = head or said == {"header"}
            hidden = "hidden" in d or d.get("aria-hidden") == "true" or "display:none" in d.get("style", "").replace(" ", "").lower()
            if hidden or role in SIDE_ROLES:
                side = MARKED
            elif said:
                side = max(side, BOTH if says_main else NAMED)
            main = main or role in ("main", "article") or d.get("itemprop") == "articleBody" or says_main and not side
        if tag in VOID:
            self.stack[-1].kids.append(Node(tag) if tag in BLOCKS else " ")
            return
        if "head" in self.names[:8] and (tag == "body" or tag in BLOCKS and tag != "html"):
            k = self.names.index("head")  # its end tag may be left out
            del self.stack[k:], self.names[k:]
        if tag in ("html", "body"):
            return
        if tag in BLOCKS:
            # A new block ends an open paragraph, and an item ends the item before it.
            ends = CLOSES.get(tag, CLOSES["p"])
            k = len(self.names) - 1
            last = 0
            while k and self.names[k] not in STOPS:
                if self.names[k] in ends:
                    last = k
                k -= 1
            if last:
                del self.stack[last:], self.names[last:]
        elif not (side or main):
            if tag in ("noscript", "a", "span", "b", "i", "em", "strong", "u"):
                return  # inline formatting carries no structure
        node = Node(tag, side, main, head)
        self.stack[-1].kids.append(node)
        self.stack.append(node)
        self.names.append(tag)

    def end(self, tag: str) -> None:
        inline = tag not in BLOCKS
        k = len(self.names) - 1
        while k:
            if self.names[k] == tag:
                del self.stack[k:], self.names[k:]
                return
            if inline and self.names[k] in BLOCKS:
                return  # an inline end tag does not close blocks
            k -= 1
        if tag == "p":
            self.stack[-1].kids.append(Node("p"))  # a lone end tag is an empty paragraph


def _digest(root: Node) -> None:
    """Hash every subtree that holds text, without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    for node in reversed(order):
        h = xxhash.xxh64(node.tag)
        text = False
        for kid in node.kids:
            if isinstance(kid, Node):
                if kid.hash:
                    h.update(kid.hash.to_bytes(8, "big"))
                    text = True
            elif kid := " ".join(kid.split()):
                h.update(kid)
                text = True
        node.hash = h.intdigest() if text else 0


def _size(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                total += len(k)
            elif not k.side:
                todo.append(k)
    return total


def _main_part(root: Node) -> list[Node]:
    """The path from the root to the page's article, or an empty list.

    Of the marked parts one that no side part holds comes first, then one marked by its tag
    rather than by a class or role, then the one with most text, then the outermost.
    """
    best: tuple | None = None
    path: list[Node] = []
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while todo:
        node, depth, beside = todo.pop()
        del path[depth:]
        path.append(node)
        if node.tag in UNSEEN:
            continue
        if node.main and not node.side and (size := _size(node)):
            rank = (not beside, node.tag == "article", size, -depth)
            if best is None or rank > best[0]:
                best = (rank, list(path))
        todo += [(k, depth + 1, beside or node.side) for k in reversed(node.kids) if isinstance(k, Node)]
    return best[1] if best else []


def blocks(html: str) -> list[tuple[str, int, list[int]]]:
    """(text, side, hashes of the subtrees whose deletion removes it) of each block in page order.

    ``side`` is what the page itself says: 0, or how surely the block is no main text. Where an article is marked,
    all outside it is MARKED, and so are its parts with side names.
    """
    root = _Tree(html).root
    _digest(root)
    path = _main_part(root)
    part, above = (path[-1], set(map(id, path))) if path else (None, set())
    out: list[tuple[str, int, list[int]]] = []
    words: list[str] = []
    outside = MARKED if part is not None and part is not root else 0

    def flush(side: int, chain: tuple[int, ...]) -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            out.append((text, side, [h - (1 << 64) if h >> 63 else h for h in chain]))

    # Each frame: node, next child, side, inside the article, in a header of the article, chain.
    frames: list[list] = [[root, 0, outside, part is root, False, ()]]
    while frames:
        node, k, side, inside, titled, chain = frames[-1]
        if k == len(node.kids):
            frames.pop()
            if node.tag in BLOCKS or frames and frames[-1][2] != side:
                flush(side, chain)
            continue
        frames[-1][1] += 1
        kid = node.kids[k]
        if isinstance(kid, str):
            words.append(kid)
            continue
        if kid.tag in UNSEEN:
            continue
        within = inside or kid is part
        head = titled
        if kid is part:
            beside = 0
        elif inside and titled and kid.tag in HEADINGS:
            beside, head = 0, False  # the title in an article's own header is text
        else:
            own = 0 if id(kid) in above else MARKED if kid.side and part is not None else kid.side
            beside = max(side, own)
            head = titled or inside and not side and kid.head
        if kid.tag in BLOCKS or beside != side:
            flush(side, chain)
        may_go = kid.hash and id(kid) not in above and not (within and not beside and kid.tag in RUNNING)
        frames.append([kid, 0, beside, within, head, (*chain, kid.hash) if may_go else chain])
    flush(outside, ())
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("text", pa.string()), ("side", pa.int32()), ("chain", pa.list_(pa.int64()))])
    for batch in batches:
        found = [blocks(h) if h else [] for h in batch.column(2).to_pylist()]
        rows = pa.array([[{"text": t, "side": s, "chain": c} for t, s, c in page] for page in found], pa.list_(item))
        hashes = pa.array([list(dict.fromkeys(h for _, _, c in page for h in c)) for page in found], pa.list_(pa.int64()))
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(3), rows, hashes], ["page_id", "url", "host", "blocks", "hashes"])


PARSED = "page_id long, url string, host string, blocks array<struct<text: string, side: int, chain: array<long>>>, hashes array<long>"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(parsed: DataFrame, min_pages: int = 3, min_share: float = 0.1, enough_pages: int = 20) -> DataFrame:
    """(host, h): the subtrees that recur across many pages of their host."""
    pages = keep(parsed.groupBy("host").agg(F.count("*").alias("pages")), "html-hosts")
    counts = keep(parsed.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages), "html-counts")
    return counts.join(pages, "host").where(F.col("n") >= F.least(F.col("pages") * min_share, F.lit(enough_pages))).select("host", "h")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """page_id, url, text, n_chars, n_template (blocks deleted as template) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    parsed = keep(rows.mapInArrow(_parse, PARSED).withColumn("uid", F.monotonically_increasing_id()), "html-blocks")
    sites = keep(templates(parsed, **options), "html-templates")
    none = F.array().cast("array<long>")
    longest = sites.groupBy("host").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if (longest["n"] or 0) <= BROADCAST_PAIRS and (longest["most"] or 0) <= HOST_LIST:
        lists = F.broadcast(sites.groupBy("host").agg(F.collect_list("h").alias("template")))
        joined = parsed.join(lists, "host", "left").withColumn("own", F.array_intersect("hashes", F.coalesce("template", none)))
    else:
        met = keep(parsed.select("uid", "host", F.explode("hashes").alias("h")).join(sites, ["host", "h"]).select("uid", "h"), "html-met")
        joined = parsed.join(met.groupBy("uid").agg(F.collect_list("h").alias("own")), "uid", "left")
    left = joined.withColumn("left", F.filter("blocks", lambda b: ~F.arrays_overlap(b["chain"], F.coalesce("own", none))))

    def size(most: int) -> Column:
        return F.aggregate(F.filter("left", lambda b: b["side"] <= most), F.lit(0), lambda n, b: n + F.length(b["text"]))

    # Names decide only while they leave some text: a tenth of the rest, or 200 characters.
    left = left.withColumn("some", F.greatest(F.lit(1), F.least(F.lit(200), size(NAMED) / 10)))
    most = F.when(size(0) >= F.col("some"), 0).when(size(BOTH) >= F.col("some"), BOTH).otherwise(NAMED)
    text = F.array_join(F.transform(F.filter("left", lambda b: b["side"] <= F.col("most")), lambda b: b["text"]), "\n")
    out = left.withColumn("most", most).select("page_id", "url", text.alias("text"), (F.size("blocks") - F.size("left")).cast("long").alias("n_template"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")
