"""List pages read by rows of a site configuration, as a table function that SQL can call.

A configuration row says for a site where its items are (``item``), and in an item where title, link,
date and author are, as nested simple selectors (``td.subject a``); which group of the link (or of its ``onclick``) is the
item's id (``id_pattern``); and the page's address that links are relative to (``base``). Null or empty selectors give null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boundaries import Element, date_and_label_of, select, selected, tree

CONFIG = "source string, host string, item string, title string, link string, date string, author string, id_pattern string, base string"
ITEMS = "pos int, source_id string, title string, url string, date string, label string, author string"


def _first(item: Element, selector: str | None) -> Element | None:
    return next(selected(item, selector), None) if selector else None


def items_of(page: str | None, item: str | None, title: str | None, link: str | None, date: str | None, author: str | None, id_pattern: str | None, base: str | None) -> Iterator[tuple]:
    """An item without title or link is none; where the link leads nowhere (``#``, ``javascript:``) the page's address stands for it."""
    pos = 0
    for found in select(tree(page), item) if item else ():
        named, linked = _first(found, title), _first(found, link or title)
        text = named.text() if named is not None else ""
        if not text or linked is None:
            continue
        href, call = linked.attrs.get("href", ""), linked.attrs.get("onclick", "")
        source_id = None
        for said in (href, call) if id_pattern else ():
            if hit := re.search(id_pattern, said):
                source_id = hit[hit.re.groups and 1]
                break
        dead = not href or href.startswith("#") or href.lower().startswith("javascript:")
        url = (base or "") if dead else urljoin(base or "", href)
        dated = _first(found, date) if date else found
        when, label = date_and_label_of(dated) if dated is not None else ("", "")
        by = _first(found, author)
        yield pos, source_id, text, url, when or None, label or None, by.text() if by is not None else None
        pos += 1


@F.udtf(returnType=ITEMS)
class ListItems:
    """``list_items(html, item, title, link, date, author, id_pattern, base)``: a row per item of a list page."""

    def eval(self, html: str, item: str, title: str, link: str, date: str, author: str, id_pattern: str, base: str):
        yield from items_of(html, item, title, link, date, author, id_pattern, base)


def register(spark: SparkSession) -> None:
    """Make ``list_items`` known to the session's SQL."""
    spark.udtf.register("list_items", ListItems)


def site_items(pages: DataFrame, sites: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """Items of all pages whose host has a configuration row: ``(id, source, pos, source_id, title, url, date, label, author)``.

    The configuration goes to the pages, a row per site: dealt out by hosts, all pages of a site would be one task's.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col(id_col).alias("_id"), F.lower(F.parse_url(F.col(url), F.lit("HOST"))).alias("_host"), F.col(html).alias("_html"))
    return spark.sql(
        "SELECT /*+ BROADCAST(c) */ p._id AS id, c.source, i.* FROM {rows} p JOIN {sites} c ON p._host = lower(c.host), "
        "LATERAL list_items(p._html, c.item, c.title, c.link, c.date, c.author, c.id_pattern, c.base) i",
        rows=rows,
        sites=sites,
    ).withColumnRenamed("id", id_col)
