"""HTML pages to visible text and to the rows of their lists (standard parser, in tasks)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names by how they count in the visible text.
DROPPED = frozenset("script style noscript template nav header footer aside svg iframe select option button title".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd label mark q s samp small span strike strong sub sup time u var".split())
MARKED = frozenset("sup sub del s strike".split())
VOID = frozenset("area base basefont br col embed hr img input link meta param source track wbr".split())
CONTENT_HINT = re.compile(r"content|board|view|article|bbs|detail", re.I)
SENTINEL = "￼"
_INVISIBLE = re.compile("[​‌‍⁠﻿]")
_DATE = re.compile(r"\d{4}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}")


def _hidden(attrs: dict) -> bool:
    style = re.sub(r"\s+", "", re.sub(r"/\*.*?(?:\*/|\Z)", "", attrs.get("style") or "", flags=re.S)).lower()
    return "hidden" in attrs or (attrs.get("aria-hidden") or "").strip().lower() == "true" or "display:none" in style or "visibility:hidden" in style


class _Scan(HTMLParser):
    """Text with the stack of open elements: each candidate container gathers what is visible in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int | None]] = []  # tag, dropped here, container number
        self.dropped = 0
        self.containers: list[tuple[int, list[str]]] = [(3, [])]  # rank (0 article, 1 main, 2 hinted, 3 all), parts
        self.open = [0]

    def _say(self, text: str) -> None:
        for i in self.open:
            self.containers[i][1].append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.dropped == 0 and tag not in INLINE:
            self._say(" ")
        if tag in VOID:
            return
        gone = tag in DROPPED or tag in MARKED or _hidden(a)
        if gone and self.dropped == 0 and tag in MARKED:
            self._say(SENTINEL)
        rank = 0 if tag == "article" else 1 if tag == "main" or (a.get("role") or "").strip().lower() == "main" else 2 if CONTENT_HINT.search(f"{a.get('id') or ''} {a.get('class') or ''}") else None
        number = None
        if rank is not None and not gone and self.dropped == 0:
            number = len(self.containers)
            self.containers.append((rank, []))
            self.open.append(number)
        self.dropped += gone
        self.stack.append((tag, gone, number))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _, _ in self.stack):
            return
        while self.stack:
            t, gone, number = self.stack.pop()
            self.dropped -= gone
            if self.dropped == 0 and t not in INLINE:
                self._say(" ")
            if number is not None:
                self.open.remove(number)
            if t == tag:
                break

    def handle_data(self, data):
        if self.dropped == 0:
            self._say(data)


def visible_text_of(page: str | None) -> str:
    """Visible text of the article, else main, else the largest content container, else the page."""
    scan = _Scan()
    scan.feed(page or "")
    scan.close()
    texts = [(rank, " ".join(_INVISIBLE.sub("", "".join(parts)).split())) for rank, parts in scan.containers]
    for rank in (0, 1):
        for r, t in texts:
            if r == rank and t:
                return t
    hinted = [t for r, t in texts if r == 2 and t]
    return max(hinted, key=lambda t: len(t.replace(" ", ""))) if hinted else texts[0][1]


def visible_text(page: Column) -> Column:
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(visible_text_of, na_action=None)

    return F.pandas_udf(of, "string")(page)


class _Rows(HTMLParser):
    """Links with the row (tr, else li) they stand in: text, link, date."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.row: list[dict] = []
        self.link: dict | None = None
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        if tag in ("tr", "li"):
            self.row.append({"kind": "table" if tag == "tr" else "list", "text": [], "links": []})
        if tag == "a" and a.get("href"):
            self.link = {"url": a["href"], "title": []}

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "a" and self.link:
            link = {"url": self.link["url"], "title": " ".join("".join(self.link["title"]).split())}
            if self.row:
                self.row[-1]["links"].append(link)
            self.rows.append({"kind": "link", "text": [link["title"]], "links": [link]})
            self.link = None
        if tag in ("tr", "li") and self.row:
            self.rows.append(self.row.pop())

    def handle_data(self, data):
        if self.skip:
            return
        if self.link:
            self.link["title"].append(data)
        for r in self.row:
            r["text"].append(data)


def list_rows_of(page: str | None) -> list[tuple[str, str, str | None]]:
    """(title, url, date) of a list page: table rows, else list items, else plain links; the first kind with rows wins."""
    scan = _Rows()
    scan.feed(page or "")
    scan.close()
    for kind in ("table", "list", "link"):
        out = []
        for r in scan.rows:
            links = [x for x in r["links"] if x["title"]] if r["kind"] == kind else []
            if links:
                best = max(links, key=lambda x: len(x["title"]))
                date = _DATE.search(" ".join(r["text"]))
                out.append((best["title"], best["url"], date[0] if date else None))
        if out:
            return out
    return []


def list_rows(page: Column) -> Column:
    """array<struct<title, url, date>> of list pages."""

    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: [{"title": t, "url": u, "date": d} for t, u, d in list_rows_of(p)], na_action=None)

    return F.pandas_udf(of, "array<struct<title: string, url: string, date: string>>")(page)


def decode_page(content: bytes | None, header_charset: str | None = None) -> str:
    """Bytes to text: byte order mark, then meta charset, then the header's, then UTF-8."""
    content = content or b""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    meta = re.search(rb"<meta[^>]{0,500}charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", content[:4096], re.I)
    for name in ((meta[1].decode("ascii") if meta else None), header_charset, "utf-8"):
        if name:
            try:
                return content.decode(name, "replace")
            except LookupError:
                continue
    return content.decode("utf-8", "replace")


def decoded(content: Column, header_charset: Column) -> Column:
    return F.pandas_udf(_decode_series, "string")(content, header_charset)


def _decode_series(raw: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([decode_page(b, n) for b, n in zip(raw, name)], dtype=object)


def page_links(pages: DataFrame, id_col: str, page: str) -> DataFrame:
    """A row per list row of each page: (id, pos, title, url, date)."""
    return pages.select(id_col, F.posexplode(list_rows(F.col(page))).alias("pos", "r")).select(id_col, "pos", "r.title", "r.url", "r.date")
