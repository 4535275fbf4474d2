"""Links of texts against the pieces that the texts are sent in: whole, split or lost, counted by occurrence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_URL = re.compile(r"https?://[^\s<>\"'()\[\]{}]+")


def url_spans(text: Column) -> Column:
    """array<struct<url, begin, end>> of the links of a text, by code points from 0."""

    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"url": m[0], "begin": m.start(), "end": m.end()} for m in _URL.finditer(t or "")])

    return F.pandas_udf(of, "array<struct<url: string, begin: int, end: int>>")(text)


def link_fates(texts: DataFrame, pieces: DataFrame, id_col: str, text: str, width: int = 4096) -> DataFrame:
    """``(id, url, begin, end, fate)`` of every link: ``whole`` in one piece, ``split`` over some, or ``lost``.

    ``pieces(id, begin, end)``: the stretches of a text that its pieces have, without overlap. An interval join: a piece is
    entered under each multiple of ``width`` that it reaches, a link under that of each end, so a long text's links meet only pieces near them.
    """
    spans = texts.select(id_col, F.explode(url_spans(F.col(text))).alias("u")).select(id_col, "u.url", "u.begin", "u.end")
    slots = pieces.where("end > begin").select(F.col(id_col).alias("_id"), F.col("begin").alias("_begin"), F.col("end").alias("_end"))
    slots = slots.withColumn("_slot", F.explode(F.expr(f"sequence(_begin div {width}, (_end - 1) div {width})")))
    asked = spans.withColumn("_slot", F.explode(F.expr(f"array_distinct(array(begin div {width}, (end - 1) div {width}))")))
    met = asked.join(slots, (F.col(id_col) == F.col("_id")) & (asked["_slot"] == slots["_slot"]) & (F.col("_begin") < F.col("end")) & (F.col("_end") > F.col("begin")), "left")
    whole = F.coalesce(F.max((F.col("_begin") <= F.col("begin")) & (F.col("_end") >= F.col("end"))), F.lit(False))
    return met.groupBy(id_col, "url", "begin", "end").agg(F.when(whole, "whole").when(F.count("_begin") > 0, "split").otherwise("lost").alias("fate"))


def link_counts(texts: DataFrame, sent: DataFrame, id_col: str, text: str, piece: str) -> DataFrame:
    """``(id, url, in_text, in_pieces)`` of links that the pieces (a row each) have more or less often than the text."""

    def counted(df: DataFrame, column: str, name: str) -> DataFrame:
        return df.select(id_col, F.explode(url_spans(F.col(column))).alias("u")).groupBy(id_col, F.col("u.url").alias("url")).agg(F.count("*").alias(name))

    both = counted(texts, text, "in_text").join(counted(sent, piece, "in_pieces"), [id_col, "url"], "full_outer").fillna(0, ["in_text", "in_pieces"])
    return both.where("in_text <> in_pieces")
