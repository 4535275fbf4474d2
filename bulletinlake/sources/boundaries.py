"""Element trees of pages: text with the ranks of its boundaries, and dates with the element that holds them.

Pages are read in tasks, in Arrow batches, by the standard parser; no step recurses, so depth has no limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names by the boundary that their end makes, containers of the text in order of preference, and the marks.
ROW_TAGS = frozenset("tr table tbody thead tfoot caption".split())
CELL_TAGS = frozenset("td th".split())
INNER_TAGS = frozenset("div p li br dl dd dt section article h1 h2 h3 h4 h5 h6 ul ol blockquote".split())
SKIPPED = frozenset("script style noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = (
    "div.board_view", "div.board-view", "div.view_cont", "div.view_content", "div.bbs_view", "div.content_view", "div.bbsView", "div.board_content",
    "div.view_area", "div.contents", "div.sub_content", "div.sub_contents", "td.content", "div#content", "div#contents",
)
ROW, CELL, INNER = "\ue000", "\ue001", "\ue002"
DATE = r"\d{4}\s*[-./년]\s*\d{1,2}\s*[-./월]\s*\d{1,2}\s*일?\.?"
RANGE_DATE = re.compile(rf"({DATE})\s*(?:[~∼〜]|부터|\s[-–—]\s)\s*({DATE})")
SINGLE_DATE = re.compile(DATE)
NOTE = re.compile(r"\([^)0-9]*\)")
LABEL_EDGES = " :：·-–—()[]"

_RUN = re.compile(f" ?([{ROW}{CELL}{INNER}][{ROW}{CELL}{INNER} ]*)")


class Element:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """All elements below, in page order."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Element)]
        while stack:
            at = stack.pop()
            yield at
            stack.extend(k for k in reversed(at.kids) if isinstance(k, Element))

    def strings(self) -> Iterator[str]:
        stack: list = [*reversed(self.kids)]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                yield at
            else:
                stack.extend(reversed(at.kids))

    def text(self) -> str:
        """Stripped strings joined by spaces, white space as one space."""
        return " ".join(" ".join(s.split()) for s in self.strings() if s.strip())


# Tags in plain form: lower-case names, attributes in quotes without references.
_PLAIN_START = re.compile(r"""<([a-z][a-z0-9]*)((?: [a-z][a-z-]*(?:="[^"&<>]*"|='[^'&<>]*'))*)>""")
_PLAIN_ATTR = re.compile(r""" ([a-z-]+)=(?:"([^"]*)"|'([^']*)')""")
_PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
_RAW_TEXT = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())  # the parser's own way, whatever it is


class _Tree(HTMLParser):
    """Elements as written: an end tag closes up to the last open element of its name, and is ignored where there is none.

    Tags in plain form are read at once, all else by the standard parser's steps; line numbers aren't kept.
    """

    def updatepos(self, i, j):
        return j

    def parse_starttag(self, i):
        plain = _PLAIN_START.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None or plain[1] in _RAW_TEXT:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], [(k, a or b) for k, a, b in _PLAIN_ATTR.findall(plain[2])] if plain[2] else ())
        return plain.end()

    def parse_endtag(self, i):
        plain = _PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None or plain[1] in _RAW_TEXT:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.open.get(tag):
            return
        while True:
            closed, self.at = self.at.tag, self.at.parent
            self.open[closed] -= 1
            if closed == tag:
                return

    def handle_data(self, data):
        self.at.kids.append(data)


def tree(page: str | None) -> Element:
    parser = _Tree()
    parser.feed(page or "")
    parser.close()
    return parser.root


@cache
def _simple(selector: str) -> tuple[str, str, str]:
    """Tag, class and id of a simple selector; there are as many as configurations name."""
    return tuple(x or "" for x in re.fullmatch(r"([\w-]*)(?:\.([\w-]+))?(?:#([\w-]+))?", selector).groups())


def matches(node: Element, selector: str) -> bool:
    """One simple selector: tag, .class and #id, each at most once, in this order."""
    tag, cls, name = _simple(selector)
    return (not tag or node.tag == tag) and (not cls or cls in node.classes) and (not name or node.attrs.get("id") == name)


def selected(top: Element, selector: str) -> Iterator[Element]:
    """Elements below ``top`` that match simple selectors nested in each other (``td.subject a``), in page order, one by one."""
    *outer, last = selector.split()
    for node in top.walk():
        if not matches(node, last):
            continue
        left, up = list(outer), node.parent
        while left and up is not None and up is not top:
            if matches(up, left[-1]):
                left.pop()
            up = up.parent
        if not left:
            yield node


def select(top: Element, selector: str) -> list[Element]:
    return list(selected(top, selector))


def boundary_text_of(page: str | None) -> str:
    """The text of the content container (else the body, else the page) with a mark where a row, cell or block ends.

    Ends of rows are ``ROW``, of cells ``CELL``; a block's end is ``INNER`` within a cell and ``ROW`` outside. Within a cell
    all marks are ``INNER``, also those of nested tables. Of neighbouring marks the strongest stays; none stand at either end.
    """
    root = tree(page)
    top = next((found for s in CONTAINERS if (found := next(selected(root, s), None))), None) or next(selected(root, "body"), root)
    parts: list[str] = []
    stack: list[tuple] = [(top, False, False)]
    while stack:
        node, in_cell, ends = stack.pop()
        if isinstance(node, str):
            parts.append(node)
        elif ends:
            if node.tag in ROW_TAGS or node.tag in CELL_TAGS or node.tag in INNER_TAGS:
                rank = INNER if in_cell else CELL if node.tag in CELL_TAGS else ROW
                parts.append(rank)
        elif node.tag not in SKIPPED:
            stack.append((node, in_cell or (node is top and node.tag in CELL_TAGS), True))
            inside = in_cell or node.tag in CELL_TAGS
            stack.extend((k, inside, False) for k in reversed(node.kids))
    text = re.sub(r"\s+", " ", "".join(parts).replace("\xa0", " "))
    text = _RUN.sub(lambda m: next(mark for mark in (ROW, CELL, INNER) if mark in m[1]), text)
    return text.strip(f" {ROW}{CELL}{INNER}")


def boundary_text(page: Column) -> Column:
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(boundary_text_of)

    return F.pandas_udf(of, "string")(page)


def boundary_rows(pages: DataFrame, id_col: str, page: str) -> DataFrame:
    """A row for each piece of the boundary text: ``(id, row, cell, text)``, rows and cells counted from 0."""
    rows = pages.select(id_col, F.posexplode(F.split(boundary_text(F.col(page)), ROW)).alias("row", "_row"))
    cells = rows.select(id_col, "row", F.posexplode(F.split("_row", CELL)).alias("cell", "_cell"))
    return cells.select(id_col, "row", "cell", F.trim(F.regexp_replace("_cell", f"[\\s{INNER}]+", " ")).alias("text"))


def _cleaned(text: str) -> str:
    return NOTE.sub(" ", text)


def date_and_label_of(top: Element) -> tuple[str, str]:
    """(date text, label) of the smallest element below ``top`` that holds a range of dates, else a single date; ('', '') without one.

    The label is what stands before the date in that element. Where only ``top`` itself holds the date, it has no label.
    An element holds what its children hold, so the search goes down only where a date is.
    """

    def smallest(pattern: re.Pattern) -> str | None:
        best, stack = None, [k for k in reversed(top.kids) if isinstance(k, Element)]
        while stack:
            node = stack.pop()
            text = node.text()
            if pattern.search(_cleaned(text)):
                if best is None or len(text) < len(best):
                    best = text
                stack.extend(k for k in reversed(node.kids) if isinstance(k, Element))
        return best

    for pattern in (RANGE_DATE, SINGLE_DATE):
        text = smallest(pattern)
        if text is not None:
            text = " ".join(_cleaned(text).split())
            # without its notes the text may read as a range only now
            found = RANGE_DATE.search(text) or SINGLE_DATE.search(text)
            return found[0].strip(), text[: found.start()].strip(LABEL_EDGES)
    text = _cleaned(top.text())
    found = RANGE_DATE.search(text) or SINGLE_DATE.search(text)
    return (found[0].strip() if found else ""), ""


def dated_items(page: str | None, selector: str = "") -> list[dict]:
    """Every item of a page (elements that match ``selector``; else table rows and list items) with its text, date and label."""
    root = tree(page)
    items = select(root, selector) if selector else [n for n in root.walk() if n.tag in ("tr", "li")]
    out = []
    for pos, item in enumerate(items):
        date, label = date_and_label_of(item)
        out.append({"pos": pos, "text": item.text(), "date": date, "label": label})
    return out


PORTION = 1 << 18  # characters of pages whose items are returned at once
READ = 200  # pages taken from a batch at once


def _portions(pages: list[str | None]) -> Iterator[slice]:
    """Slices of about ``PORTION`` characters, a longer page alone."""
    begin = size = 0
    for i, page in enumerate(pages):
        if i > begin and size + len(page or "") > PORTION:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(page or "")
    if begin < len(pages):
        yield slice(begin, len(pages))


def dates_and_labels(pages: DataFrame, id_col: str, page: str, selector: str = "") -> DataFrame:
    """``(id, pos, text, date, label)``: a row per item of each page; pages without items have none.

    Pages come in small batches and their items go on in portions, so a task holds no more than a few pages, however many items they have.
    """
    kinds = {"pos": pa.int32(), "text": pa.string(), "date": pa.string(), "label": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, READ) for i in range(0, whole.num_rows, READ)):
                texts = batch.column(1).to_pylist()
                for some in _portions(texts):
                    found = [dated_items(p, selector) for p in texts[some]]
                    of = [some.start + i for i, items in enumerate(found) for _ in items]
                    columns = [pa.array([x[k] for items in found for x in items], t) for k, t in kinds.items()]
                    yield pa.record_batch([batch.column(0).take(pa.array(of, pa.int64())), *columns], names=[id_col, *kinds])

    some = pages.select(F.col(id_col), F.col(page).alias("_page"))
    return some.mapInArrow(run, f"`{id_col}` {some.dtypes[0][1]}, pos int, text string, date string, label string")
