"""Main text of web pages: site template removal by subtree hashes, then block text.

Each page is read into an element tree. The subtrees of its elements (tag, text and children)
are hashed; Spark counts on how many different pages of a host each hash occurs (copies of a page
are one), and subtrees found on at least ``outer_pages`` of them are the site's template and are
deleted. Inside the article (or what stands for it, below) a subtree must be on ``min_pages`` pages
and ``inner_share`` of the host's, so passages that a site's articles share stay; the counts of one
place delete nothing in the other. Elements that are boilerplate by tag, role or
class (menus, headers and footers outside the article, sidebars, notices, adverts, forms,
comments, scripts, styles) are deleted on any page, also where a host has few pages. Only classes made of nothing
but words of widgets count, so ``with-sidebar``, ``share-price`` or a heading's id stays, and no element goes for its class
(or as a form) that holds most of the text of the page's articles or, where there are none, of the page.

From what is left the articles (in page order, without nested ones, comments and teasers; else main,
else the largest content container, else the body) give their text: character references decoded, white space inside a block one space, blocks
trimmed, empty ones left out, joined in page order by ``\\n``.

Scale: pages meet only as (host, hash) rows, counted with partial aggregation. Pages and their template hashes join by page,
so a host with a third of all pages isn't one task's.

Nulls: null html is empty and gives ''; a null or relative url has host ''. Repeated rows count
as one page and give repeated results. Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import pick, stash

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)|<|[^<]+",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# HTML element names by their part in the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend summary".split())
OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("table ul ol dl td th div article section main body html aside nav header footer form blockquote".split())
DROP_TAGS = frozenset("nav aside footer form button select option input label dialog menu head".split()) | RAW
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices notification comment comments respond disqus share sharing social related recommended newsletter subscribe subscription signup login "
    "popup modal overlay pagination pager toolbar widget widgets skip masthead".split()
)
WIDGET_PARTS = frozenset("area bar block bottom box buttons col column container content form global group header inline inner items left link links list main module page panel post posts primary right row secondary section site slot small top unit wrap wrapper zone".split())
ITEM_PARTS = frozenset("article entry item news story".split())
NEVER_TEXT = DROP_TAGS - frozenset("form dialog label menu".split())
TEASER_WORDS = frozenset("teaser card preview excerpt comment comments reply related".split())
OUTER_WORDS = frozenset("header topbar site-header".split())
CONTENT_WORDS = frozenset("article content post entry story articlebody maintext".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []


def parse(page: str) -> Node:
    """Element tree with text (still with references decoded) as str children."""
    root = at = Node("#root", {}, None)
    raw: str | None = None
    for m in _TOKEN.finditer(page):
        token = m[0]
        tag = m[2]
        if raw:
            if tag and m[1] and tag.lower() == raw:
                raw = None
            continue
        if tag is None:
            if not token.startswith(("<!", "<?")):
                at.kids.append(entities.unescape(token))
            continue
        tag = tag.lower()
        if not m[4]:
            continue  # a tag that the page's end cuts off
        if m[1]:
            if tag == "p" or tag in BLOCK or tag in ("b", "i", "a", "em", "strong", "span"):
                up = at
                while up is not root and up.tag != tag:
                    if up.tag in STOPS and tag not in BLOCK:
                        up = root
                        break
                    up = up.parent
                if up is not root:
                    at = up.parent
            else:
                up = at
                while up is not root and up.tag != tag and up.tag not in BLOCK:
                    up = up.parent
                if up.tag == tag:
                    at = up.parent
            continue
        closing = m[3].rstrip().endswith("/")
        if tag in RAW:
            if not closing or tag in ("script", "style", "title", "textarea"):
                raw = tag
            continue
        if tag in CLOSES_P:
            up = at
            while up is not root and up.tag != "p" and up.tag not in STOPS:
                up = up.parent
            if up.tag == "p":
                at = up.parent
        if tag in OWN_KIND:
            up = at
            while up is not root and up.tag not in OWN_KIND[tag] and up.tag not in ("ul", "ol", "dl", "table", "select"):
                up = up.parent
            while up is not root and up.tag in OWN_KIND[tag]:
                at = up = up.parent
        node = Node(tag, {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(m[3])} if m[3].strip(" /") else {}, at)
        at.kids.append(node)
        if tag not in VOID:
            at = node
    return root


def _words(node: Node) -> set[str]:
    found = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    return set(re.split(r"[^a-z0-9]+", found)) | set(found.split())


def _named(node: Node, words: frozenset[str], others: frozenset[str]) -> bool:
    """Is a class (or the id of a plain box) made of nothing but ``words``, one at least, and ``others``? Ids of headings and sections come from titles."""
    if not node.attrs:
        return False
    names = node.attrs.get("class", "").lower().split()
    if node.tag in ("div", "ul", "ol", "table"):
        names.append(node.attrs.get("id", "").lower())
    for name in names:
        parts = set(filter(None, re.split(r"[^a-z0-9]+", name)))
        if parts & words and parts <= words | others:
            return True
    return False


def _widget(node: Node) -> bool:
    return _named(node, DROP_WORDS, WIDGET_PARTS)


def _teaser(node: Node) -> bool:
    return _named(node, TEASER_WORDS, WIDGET_PARTS | ITEM_PARTS)


def boilerplate(node: Node, inside: bool, safe: set[int] | frozenset[int] = frozenset()) -> bool:
    """By tag, role, class or being hidden; ``inside``: within the article; ``safe``: elements that hold the article (``holders``)."""
    if id(node) in safe:
        return node.tag in NEVER_TEXT
    if node.tag in DROP_TAGS or (node.tag == "header" and not inside):
        return True
    a = node.attrs
    if not a:
        return False
    if a.get("role", "").lower() in DROP_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if node.tag in ("html", "body", "#root") or not ("class" in a or "id" in a):
        return False
    return _widget(node) or (not inside and bool(set(a.get("class", "").lower().split()) & OUTER_WORDS))


def holders(root: Node) -> set[int]:
    """Elements that hold most of the text of the page's articles or, where it has none, most of its text; they aren't dropped for a class or as forms.

    Text in links and in what is never text doesn't count, nor do comments and teasers.
    """
    order: list[tuple[Node, Node | None]] = []
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        node, top = stack.pop()
        if node is not root and (node.tag in NEVER_TEXT or node.tag == "a" or _teaser(node)):
            continue
        top = top or (node if node.tag in ("article", "main") or node.attrs.get("role", "").lower() == "main" else None)
        order.append((node, top))
        stack.extend((k, top) for k in node.kids if isinstance(k, Node))
    size = {id(n): sum(len(k.strip()) for k in n.kids if isinstance(k, str)) for n, _ in order}
    for node, _ in reversed(order):
        if node.parent is not None:
            size[id(node.parent)] += size[id(node)]
    tops = [n for n, top in order if n is top and size[id(n)]]
    safe: set[int] = set()
    if tops:
        most = max(tops, key=lambda n: size[id(n)])
        node = most if 2 * size[id(most)] > sum(size[id(n)] for n in tops) else None
        while node is not None:
            safe.add(id(node))
            node = node.parent
        return safe
    node = root if size[id(root)] else None
    while node is not None:
        safe.add(id(node))
        node = next((k for k in node.kids if isinstance(k, Node) and 2 * size.get(id(k), 0) > size[id(root)]), None)
    return safe


def subtrees(root: Node) -> list[tuple[Node, int, bool]]:
    """Every element with text, its hash and whether it is inside the container that gives the text."""
    tops, inner = _content(root, set(), holders(root))
    chosen = {id(t) for t in tops}
    found: list[tuple[Node, int, bool]] = []
    order: list[tuple[Node, bool]] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append((node, inside))
        deeper = inside or (inner and id(node) in chosen)
        stack.extend((k, deeper) for k in node.kids if isinstance(k, Node))
    hashes: dict[int, tuple[int, bool]] = {}
    for node, inside in reversed(order):
        h = xxhash.xxh64(node.tag)
        text = False
        for k in node.kids:
            if isinstance(k, str):
                words = " ".join(k.split())
                text = text or bool(words)
                h.update(f"\x00{words}")
            else:
                of, has = hashes[id(k)]
                text = text or has
                h.update(f"\x01{of:x}")
        hashes[id(node)] = (h.intdigest(), text)
        if text and node.tag not in ("#root", "html", "body", "article", "main") and not (inner and id(node) in chosen):
            found.append((node, h.intdigest() - (1 << 63), inside))
    return found


def _size(node: Node, gone: set[int], inside: bool, safe: set[int]) -> int:
    total, stack = 0, [(node, inside)]
    while stack:
        n, within = stack.pop()
        for k in n.kids:
            if isinstance(k, str):
                total += len(k.strip())
            elif id(k) not in gone and not boilerplate(k, within, safe):
                stack.append((k, within))
    return total


def _content(root: Node, gone: set[int], safe: set[int]) -> tuple[list[Node], bool]:
    """The articles (but nested ones, comments and teasers), else main, else the largest content container, else all."""
    article, main, other = [], [], []
    stack = [(root, False)]
    while stack:
        n, within = stack.pop()
        if n is not root and (id(n) in gone or boilerplate(n, within, safe)):
            continue
        if n.tag == "article" and not within:
            article.append(n)
        elif n.tag == "main" or n.attrs.get("role", "").lower() == "main":
            main.append(n)
        elif n.attrs and (n.attrs.get("itemprop", "").lower() == "articlebody" or _words(n) & CONTENT_WORDS) and n.tag in ("div", "section", "td"):
            other.append(n)
        within = within or n.tag == "article"
        stack.extend((k, within) for k in reversed(n.kids) if isinstance(k, Node))
    found = [n for n in article if _size(n, gone, True, safe) > 0]
    if found:
        return [n for n in found if not _teaser(n)] or found, True
    for found in (main, other):
        sized = [(_size(n, gone, True, safe), -i, n) for i, n in enumerate(found)]
        if sized and max(sized)[0] > 0:
            return [max(sized)[2]], True
    return [root], False


def text_of(root: Node, gone: set[int]) -> str:
    safe = holders(root)
    tops, inside = _content(root, gone, safe)
    chosen = {id(t) for t in tops}
    blocks: list[str] = []
    parts: list[str] = []

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(text)
        parts.clear()

    stack: list = list(reversed(tops))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif id(x) in chosen or (id(x) not in gone and not boilerplate(x, inside, safe)):
            if x.tag == "br":
                parts.append(" ")
            elif x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.kids))
    flush()
    return "\n".join(blocks)


def main_text(page: str | None, template: frozenset[tuple[int, bool]] | set[tuple[int, bool]] = frozenset()) -> str:
    """``template``: hashes of subtrees, each with the place (inside the container or not) where it is template."""
    root = parse(page or "")
    gone = {id(n) for n, h, inside in subtrees(root) if (h, inside) in template} if template else set()
    return text_of(root, gone)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, tx, host, page in zip(*[batch[c].to_pylist() for c in ("page_id", "tx", "host", "html")]):
            found = subtrees(parse(page or ""))
            seen = {(h, inside) for _, h, inside in found}
            whole = xxhash.xxh64("".join(f"{h:x}{inside:d}" for _, h, inside in found)).intdigest() - (1 << 63)
            rows.append((page_id, tx, host, whole, [{"hash": h, "inside": i} for h, i in seen]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("hash", pa.int64()), ("inside", pa.bool_())])))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "tx", "host", "content", "seen"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p, {(x["hash"], x["inside"]) for x in t or ()}) for p, t in zip(batch["html"].to_pylist(), batch["template"].to_pylist())]
        yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, min_pages: int = 20, outer_pages: int = 5, inner_share: float = 0.8) -> DataFrame:
    """``pages(page_id, url, html)`` to ``(page_id, url, text)``."""
    rows = pick(pages, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64("url", "html").alias("tx"), F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host"))
    seen = stash(rows.mapInArrow(_hashes, "page_id long, tx long, host string, content long, seen array<struct<hash: long, inside: boolean>>"), "subtrees")
    each = seen.select("page_id", "tx", "host", F.explode("seen").alias("s")).select("page_id", "tx", "host", "s.hash", "s.inside")
    contents = seen.groupBy("host", "content").agg(F.first("seen").alias("seen"))
    sizes = contents.groupBy("host").agg(F.count("*").alias("pages"))
    counted = contents.select("host", F.explode("seen").alias("s")).select("host", "s.hash", "s.inside").groupBy("host", "hash", "inside").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("inside"), min_pages).otherwise(outer_pages))
    common = counted.join(sizes, "host").where(~F.col("inside") | (F.col("n") >= F.col("pages") * inner_share))
    template = stash(common.select("host", "hash", "inside"), "template")
    own = each.join(template, ["host", "hash", "inside"], "left_semi").groupBy("page_id", "tx").agg(F.collect_set(F.struct("hash", "inside")).alias("template"))
    own = own.select(F.col("page_id").alias("_id"), F.col("tx").alias("_tx"), "template")
    joined = rows.join(own, rows["page_id"].eqNullSafe(own["_id"]) & (rows["tx"] == own["_tx"]), "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(_texts, "page_id long, url string, text string")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
