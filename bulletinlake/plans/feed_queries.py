"""Queries of readers and of small rules: envelopes, feeds, decoding, kinds, stamps, windows and links, written from the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import merge, reconcile, scoring, upkeep
from ..operators import sentences as sentence_ops
from ..session import table
from ..sources import feeds, html
from .catalogue import query


@query("""
SELECT o_orderkey AS source_id, o_orderpriority || ' 공고 ' || o_orderkey AS title, 'https://h.example/view?id=' || o_orderkey AS url,
  strftime(o_orderdate, '%Y-%m-%d') AS period_start, strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') AS period_end
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_orderdate, o_custkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first, o_orderkey AS k FROM orders)
WHERE o_custkey % 4 < 2 OR (o_custkey % 4 = 2 AND k = first)""")
def json_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements from a JSON envelope for each customer: a list, {item: list}, {item: object}, and one whose code says it failed."""
    orders = table(spark, sf_dir, "orders")
    day = lambda n: f"date_format(o_orderdate + interval {n} days, 'yyyyMMdd')"
    item = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("pblancId"), F.concat("o_orderpriority", F.lit(" 공고 "), "o_orderkey").alias("pblancNm"), F.expr(f"{day(0)} || ' ~ ' || {day(9)}").alias("dates")))
    listed = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("j")))).alias("all"))
    many = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("]"))
    kind = F.col("o_custkey") % 4
    items = F.when(kind == 0, many).when(kind == 2, F.concat(F.lit('{"item":'), F.col("all")[0]["j"], F.lit("}"))).otherwise(F.concat(F.lit('{"item":'), many, F.lit("}")))
    code = F.when(kind == 3, "99").otherwise("00")
    body = F.concat(F.lit('{"response":{"header":{"resultCode":"'), code, F.lit('"},"body":{"items":'), items, F.lit("}}}"))
    rows = feeds.json_announcements(listed.select(body.alias("body")), "body", "h", {"source_id": "pblancId", "title": "pblancNm", "period": "dates"}, "https://h.example/view?id={}", ok_code=("response.header.resultCode", "00"))
    return rows.select("source_id", "title", "url", "period_start", "period_end")


@query("""
SELECT CAST(100000 + o_orderkey AS VARCHAR) AS source_id, o_orderpriority || ' ' || o_orderkey AS title, 'https://f.example/news/' || (100000 + o_orderkey) AS url,
  CASE WHEN o_custkey % 2 = 0 THEN '요약 ' || o_orderkey || ' 끝' ELSE '요약 ' || o_orderkey END AS summary, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders""")
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of an RSS (even) or Atom (odd) feed for each customer; summaries hold escaped markup."""
    orders = table(spark, sf_dir, "orders").withColumn("link", F.concat(F.lit("https://f.example/news/"), F.col("o_orderkey") + 100000)).withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rss = F.expr("'<item><title>' || o_orderpriority || ' ' || o_orderkey || '</title><link>' || link || '</link><description>&lt;p&gt;요약 &amp;lt;b&amp;gt;' || o_orderkey || '&amp;lt;/b&amp;gt;&lt;/p&gt; 끝</description><pubDate>' || date_format(o_orderdate, 'EEE, dd MMM yyyy') || ' 23:30:00 +0900</pubDate></item>'")
    atom = F.expr("'<entry><title>' || o_orderpriority || ' ' || o_orderkey || '</title><link href=\"' || link || '\"/><id>x' || o_orderkey || '</id><summary>요약 ' || o_orderkey || '</summary><updated>' || day || 'T23:30:00+09:00</updated></entry>'")
    even = F.col("o_custkey") % 2 == 0
    each = orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(F.when(even, rss).otherwise(atom)), "").alias("items"))
    xml = F.when(even, F.concat(F.lit('<rss version="2.0"><channel><title>t</title>'), "items", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), "items", F.lit("</feed>")))
    return feeds.feed_announcements(each.select(xml.alias("xml")), "xml", "f").select("source_id", "title", "url", "summary", "posted")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from bytes: UTF-8 and UTF-16 with marks, UTF-8 by a meta tag against a wrong header, UTF-8 without either."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    kind = F.col("doc_id") % 4
    meta = '<meta charset="utf-8">'
    raw = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("t", "UTF-8")))
        .when(kind == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("t", "UTF-16LE")))
        .when(kind == 2, F.concat(F.encode(F.lit(meta), "UTF-8"), F.encode("t", "UTF-8")))
        .otherwise(F.encode("t", "UTF-8"))
    )
    got = html.decoded(raw, F.when(kind == 2, "euc-kr"))
    plain = F.when(kind == 2, F.substr(got, F.lit(len(meta) + 1))).otherwise(got)
    return docs.select("doc_id", F.sha2(plain.cast("binary"), 256).alias("text_sha256"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'gonggo' WHEN source IN ('src1', 'src2') THEN 'gonggo' ELSE 'media' END AS kind,
CASE WHEN n_chars % 3 = 0 AND n_chars % 2 = 1 THEN 'error' WHEN n_chars % 2 = 1 THEN 'partial' ELSE 'success' END AS status FROM documents""")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = scoring.source_kind(F.when(F.col("doc_id") % 3 == 0, "gonggo").otherwise(""), {"src1": "gonggo", "src2": "gonggo", "src3": "media", "src4": "odd"}, F.col("source"))
    return docs.select("doc_id", kind.alias("kind"), scoring.crawl_status(F.col("n_chars") % 3, F.col("n_chars") % 2).alias("status"))


@query("""
SELECT user_id, arg_max(event_type, event_id) AS reason, '문의 [email]' AS title, TIMESTAMP '2026-01-01' AS seen_at FROM events GROUP BY user_id
UNION ALL SELECT c_custkey, 'old', 'old', TIMESTAMP '2020-01-01' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def drops_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of dropped rows with this run's written over, stamped, and without contacts."""
    columns = "user_id long, reason string, title string, seen_at timestamp_ntz"
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("old").alias("reason"), F.lit("old").alias("title"), F.expr("timestamp_ntz'2020-01-01'").alias("seen_at"))
    new = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("reason")).withColumn("title", F.concat(F.lit("문의 u"), "user_id", F.lit("@mail.example")))
    return merge.record_drops(old, new, F.expr("timestamp_ntz'2026-01-01'"), ["user_id"]).select(*[c.split()[0] for c in columns.split(", ")])


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN d END AS period_start, CASE WHEN o_orderkey % 3 = 1 THEN d END AS period_end, o_orderkey % 3 = 2 AS changed
FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def periods_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored periods recomputed, blank as null: of a third the end goes."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.col("o_orderkey") % 3
    stored = table(spark, sf_dir, "orders").select("o_orderkey", F.when(kind > 0, day).otherwise("").alias("period_start"), F.when(kind > 0, day).alias("period_end"), day.alias("day"))
    return merge.revalidate(stored, F.when(kind > 0, F.col("day")), F.when(kind == 1, F.col("day"))).select("o_orderkey", "period_start", "period_end", "changed")


@query("""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, substr(coalesce(text, ''), 11, 15) AS a FROM documents),
p AS (SELECT *, CASE WHEN a = '' THEN 1 ELSE length(t) - length(list_last(string_split(t, a))) - length(a) + 1 END AS start FROM t)
SELECT doc_id, substr(t, start, 40) AS "window", length(t) - start + 1 > 40 AS truncated FROM p
WHERE NOT contains(substr(t, start + 1), a) AND len(string_split(t, a)) = 2 OR a = ''""")
def anchored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty characters from a text's own anchor on, for texts that hold it once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    found = docs.withColumn("a", F.substring("t", 11, 15)).withColumn("w", text.anchored_window(F.col("t"), F.col("a"), 40))
    once = (F.col("a") == "") | ~F.contains(F.substring("t", F.position("a", "t") + 1, F.length("t")), F.col("a"))  # nor again where it overlaps itself
    return found.where(once).select("doc_id", "w.window", "w.truncated")


@query("""
SELECT doc_id, 0 AS pos, 'n' || doc_id AS label, 'https://w.example/a_(b)' || doc_id AS url FROM documents
UNION ALL SELECT doc_id, 1, '', 'https://v.example/' || n_chars FROM documents""")
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled link with parentheses and a bare one, written before and after each document."""
    body = F.concat(F.lit("[n"), "doc_id", F.lit("](https://w.example/a_(b)"), "doc_id", F.lit(") "), F.coalesce("text", F.lit("")), F.lit(" (https://v.example/"), "n_chars", F.lit(")."))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(sentence_ops.links(body)).alias("pos", "l")).select("doc_id", "pos", "l.label", "l.url")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
  o_orderkey % 5 = 0 OR o_orderkey % 2 = 1 OR date_diff('hour', date_trunc('day', o_orderdate), TIMESTAMP '1996-06-01') >= 24 AS due,
  o_orderkey % 5 = 0 OR date_diff('second', date_trunc('day', o_orderdate), TIMESTAMP '1996-06-01') > 72 * 3600 AS expired FROM orders""")
def stamp_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact dates; whether a row is to be checked again; whether its stamp has expired or can't be read."""
    key, now = F.col("o_orderkey"), F.lit("1996-06-01").cast("timestamp")
    compact = F.when(key % 3 == 0, F.date_format("o_orderdate", "yyyyMMddHHmm")).when(key % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("1999")
    at = F.when(key % 5 == 0, "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.compact_datetime(compact).alias("day"), dates.recheck_due(F.lit("a"), F.when(key % 2 == 1, "b").otherwise("a"), at, now).alias("due"), reconcile.stamp_expired(at, now, 72).alias("expired")
    )


@query("""
SELECT o_orderkey, sha256('[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_returnflag) || ']') AS signature
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def row_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signature of each order's lines, the same for the same lines in any order of arrival."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return upkeep.signature(lines, "o_orderkey", "l_linenumber", ["l_linenumber", "l_returnflag"])


@query("""
WITH k AS (SELECT p_partkey, trim(regexp_replace(p_name, '[^0-9A-Za-z]', '', 'g')) AS t FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN length(t) = 0 THEN [] WHEN length(t) < 3 THEN [t] ELSE [substr(t, i, 3) FOR i IN range(1, length(t) - 1)] END)), '|') AS grams FROM k""")
def title_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct three-character pieces of the parts' names without blanks."""
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.title_ngrams(F.col("p_name"))), "|").alias("grams"))
