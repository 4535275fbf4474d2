"""Readers of REST JSON envelopes, feeds and form files into announcement columns."""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import api_period, pub_date
from ..functions.text import blank, clean_text, short_hash, summary_of_parts

ITEM_FIELDS = ("source_id", "title", "url", "summary", "author", "category", "target", "period")


def envelope_items(body: Column, path: str = "response.body.items", item: str = "item", ok_code: tuple[str, str] | None = None) -> Column:
    """The items of a JSON envelope as JSON texts: a list, {item: list}, {item: object} or one object.

    ``ok_code`` (path, value) guards the envelope; a body that fails it or can't be read has none.
    """
    found = F.get_json_object(body, f"$.{path}")
    inner = F.get_json_object(found, f"$.{item}")
    chosen = F.when(found.startswith("["), found).when(inner.isNotNull(), inner).otherwise(found)
    listed = F.when(chosen.startswith("["), F.from_json(chosen, "array<string>")).when(chosen.startswith("{"), F.array(chosen))
    good = F.lit(True) if ok_code is None else F.coalesce(F.get_json_object(body, f"$.{ok_code[0]}") == ok_code[1], F.lit(False))
    return F.when(good, F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))


def json_announcements(bodies: DataFrame, body: str, source: str, fields: Mapping[str, str | Sequence[str]], url_template: str | None = None, **envelope) -> DataFrame:
    """Announcement rows of envelopes: ``fields`` maps columns to JSON keys (several: joined by '-').

    Rows without a title, or with neither id nor url, are dropped; a missing url comes from the template.
    """
    items = bodies.select(F.explode(envelope_items(F.col(body), **envelope)).alias("item"))

    def value(name: str) -> Column:
        keys = fields.get(name, ())
        keys = [keys] if isinstance(keys, str) else list(keys)
        got = [clean_text(F.get_json_object("item", f"$.{k}")) for k in keys]
        if not got:
            return F.lit("")
        return got[0] if len(got) == 1 else F.concat_ws("-", *[F.nullif(g, F.lit("")) for g in got])

    rows = items.select(*[value(n).alias(n) for n in ITEM_FIELDS], F.col("item").alias("raw_data"))
    if url_template:
        made = F.when(F.col("source_id") != "", F.concat(F.lit(url_template.split("{}")[0]), F.col("source_id"), F.lit(url_template.split("{}")[1]))).otherwise("")
        rows = rows.withColumn("url", F.when(F.col("url") == "", made).otherwise(F.col("url")))
    rows = rows.where((F.col("title") != "") & ((F.col("source_id") != "") | (F.col("url") != "")))
    start, end = api_period(F.col("period"))
    return rows.select(F.lit(source).alias("source"), F.when(F.col("source_id") == "", short_hash(F.col("url"))).otherwise(F.col("source_id")).alias("source_id"), "title", "url", "summary", "author", "category", "target", start.alias("period_start"), end.alias("period_end"), "raw_data")


FEED = "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string, author: string, category: array<string>, guid: struct<_VALUE: string, _isPermaLink: string>, `dc:date`: string, `dc:creator`: string>>>, entry array<struct<title: string, link: struct<_href: string>, summary: string, published: string, updated: string, id: string>>"


def unescaped(c: Column) -> Column:
    """Character references decoded once more than the XML reader does: what is left may be markup."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.pandas_udf(of, "string")(c)


def feed_announcements(feeds: DataFrame, xml: str, source: str, kind: str = "gonggo") -> DataFrame:
    """Announcement rows of RSS 2.0 and Atom documents, a row per entry with a title.

    A guid that is no permanent link isn't used as the url; dates keep their own calendar day.
    """
    parsed = feeds.select(F.from_xml(F.col(xml), FEED, {"mode": "PERMISSIVE"}).alias("f"))
    rss = parsed.select(F.explode("f.channel.item").alias("i")).select(
        F.col("i.title").alias("title"),
        F.coalesce(F.nullif(F.trim("i.link"), F.lit("")), F.when(F.coalesce(F.lower("i.guid._isPermaLink"), F.lit("true")) != "false", F.col("i.guid._VALUE"))).alias("url"),
        F.col("i.description").alias("summary"),
        F.coalesce("i.pubDate", "i.dc:date").alias("posted"),
        F.coalesce("i.author", "i.dc:creator").alias("author"),
        F.array_join(F.col("i.category"), " | ").alias("category"),
        F.col("i.guid._VALUE").alias("guid"),
    )
    atom = parsed.select(F.explode("f.entry").alias("i")).select(F.col("i.title").alias("title"), F.col("i.link._href").alias("url"), F.col("i.summary").alias("summary"), F.coalesce("i.published", "i.updated").alias("posted"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("category"), F.col("i.id").alias("guid"))
    rows = rss.unionByName(atom).where(clean_text(F.col("title")) != "")
    plain = F.substring(F.trim(F.regexp_replace(F.regexp_replace(unescaped(blank(F.col("summary"))), r"<[^>]*>", " "), r"(?U)\s+", " ")), 1, 200)
    link = clean_text(F.col("url"))
    source_id = F.coalesce(F.nullif(F.regexp_extract(link, r"[?&](?:idxno|no|nttId)=(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(link, r"/(\d{5,})", 1), F.lit("")), short_hash(F.coalesce(F.nullif(link, F.lit("")), F.col("guid"), F.col("title"))))
    return rows.select(F.lit(source).alias("source"), source_id.alias("source_id"), clean_text(F.col("title")).alias("title"), link.alias("url"), plain.alias("summary"), clean_text(F.col("author")).alias("author"), clean_text(F.col("category")).alias("category"), F.lit(kind).alias("kind"), pub_date(F.col("posted")).alias("posted"))


def form_responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A form's CSV (UTF-8, with or without mark) as (company, news in file order) and (opinion, policy).

    Rows of one file only; a file's rows are numbered by where they stand in it.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8")
    rows = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns]).withColumn("_pos", F.monotonically_increasing_id())
    kind, company, content = (F.trim(blank(F.col(c))) for c in ("유형", "회원사", "내용"))
    news = rows.where((kind == "소식") & (company != "") & (content != "")).groupBy(company.alias("company")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", content.alias("v")))), lambda x: x["v"]).alias("contents"))
    opinions = rows.where((kind == "의견") & (content != "")).select("_pos", content.alias("opinion"), F.trim(blank(F.col("관련정책"))).alias("policy"))
    return news, opinions


def first_board_with_rows(rows: DataFrame, board: str, page: str) -> DataFrame:
    """Of each page's boards (numbered), the rows of the first that has any."""
    first = rows.groupBy(page).agg(F.min(board).alias("_b"))
    return rows.join(first, page).where(F.col(board) == F.col("_b")).drop("_b")


def union_boards(rows: DataFrame, board: str, id_col: str) -> DataFrame:
    """All boards' rows, a repeated id only from its first board."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(id_col).orderBy(board))).where("_rn = 1").drop("_rn")
