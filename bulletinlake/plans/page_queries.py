"""Queries of pages: boundary text, quotes, dates with their elements, and site-configured lists.

Where the driver's pages hold no such content, pages are written from the rows of ``orders`` by expressions,
one page an order or a customer; the SQL tells from the same rows what must be read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quoting
from ..session import table
from ..sources import boundaries, listings
from .catalogue import query


@query()
def page_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.boundary_rows(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def page_item_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.dates_and_labels(table(spark, sf_dir, "pages"), "page_id", "html")


PERIOD = "date_format(o_orderdate, 'yyyy.MM.dd') || ' ~ ' || date_format(o_orderdate + interval 20 days, 'yyyy.MM.dd')"
NOTICES = (
    "<table><tr><th>접수기간</th><td>' || period || '</td></tr><tr><th>지원대상</th><td>' || o_orderpriority || '</td></tr></table>",
    "<p>□ 신청기간 : ' || period || ' 까지</p><p>교육기간 2020.01.01 ~ 2020.02.01</p><p>지원금액 : ' || price || '원</p>",
    "<table><tr><td>모집기간</td><td><div>1차 ' || period || '</div><div>2차 2030.01.01</div></td></tr></table><script>마감일 : 2000.01.01</script>",
    "<p>공고일 ' || period || '</p><p>지원내용 없음</p>",
    "<table><tr><th>접수기간</th><td>' || period || '<br>교육기간 2020.01.01</td><th>사업규모</th><td><table><tr><td>' || price || '</td></tr></table>원</td></tr></table>",
    "<div>접수기간</div><div>' || period || '</div><div>마감 : ' || period || ' ㅁ 신청자격 ' || o_orderpriority || '</div>",
)


def notice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order, in one of six forms; orders are dealt out first, as pages cost far more to read than a few files of orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    rows = orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey").withColumn("period", F.expr(PERIOD)).withColumn("price", F.expr("cast(cast(o_totalprice as long) as string)"))
    body = F.expr("case o_orderkey % 6 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(NOTICES)) + " end")
    return rows.select("o_orderkey", F.concat(F.lit("<html><body><h1>머리</h1><div class='board_view'>"), body, F.lit("</div><p>꼬리</p></body></html>")).alias("html"))


_ROWS = """WITH o AS (SELECT *, o_orderkey % 6 AS kind, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price,
  strftime(o_orderdate, '%Y.%m.%d') || ' ~ ' || strftime(o_orderdate + INTERVAL 20 DAY, '%Y.%m.%d') AS period FROM orders)"""


@query(
    _ROWS
    + """
SELECT o_orderkey, CAST(unnest(r).r AS INT) AS row, CAST(unnest(r).c AS INT) AS cell, unnest(r).t AS text FROM (
  SELECT o_orderkey, CASE kind
    WHEN 0 THEN [{'r': 0, 'c': 0, 't': '접수기간'}, {'r': 0, 'c': 1, 't': period}, {'r': 1, 'c': 0, 't': '지원대상'}, {'r': 1, 'c': 1, 't': o_orderpriority}]
    WHEN 1 THEN [{'r': 0, 'c': 0, 't': '□ 신청기간 : ' || period || ' 까지'}, {'r': 1, 'c': 0, 't': '교육기간 2020.01.01 ~ 2020.02.01'}, {'r': 2, 'c': 0, 't': '지원금액 : ' || price || '원'}]
    WHEN 2 THEN [{'r': 0, 'c': 0, 't': '모집기간'}, {'r': 0, 'c': 1, 't': '1차 ' || period || ' 2차 2030.01.01'}]
    WHEN 3 THEN [{'r': 0, 'c': 0, 't': '공고일 ' || period}, {'r': 1, 'c': 0, 't': '지원내용 없음'}]
    WHEN 4 THEN [{'r': 0, 'c': 0, 't': '접수기간'}, {'r': 0, 'c': 1, 't': period || ' 교육기간 2020.01.01'}, {'r': 0, 'c': 2, 't': '사업규모'}, {'r': 0, 'c': 3, 't': price || ' 원'}]
    ELSE [{'r': 0, 'c': 0, 't': '접수기간'}, {'r': 1, 'c': 0, 't': period}, {'r': 2, 'c': 0, 't': '마감 : ' || period || ' ㅁ 신청자격 ' || o_orderpriority}] END AS r FROM o)"""
)
def notice_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.boundary_rows(notice_pages(spark, sf_dir), "o_orderkey", "html")


@query(
    _ROWS
    + """
SELECT o_orderkey,
  CASE kind WHEN 0 THEN '접수기간 ' || period WHEN 1 THEN '신청기간 : ' || period || ' 까지' WHEN 2 THEN '모집기간 1차 ' || period || ' 2차 2030.01.01'
    WHEN 4 THEN '접수기간 ' || period WHEN 5 THEN '마감 : ' || period END AS quote_deadline,
  CASE kind WHEN 0 THEN '지원대상 ' || o_orderpriority WHEN 5 THEN '신청자격 ' || o_orderpriority END AS quote_eligibility,
  CASE kind WHEN 1 THEN '지원금액 : ' || price || '원' WHEN 4 THEN '사업규모 ' || price || ' 원' END AS quote_amount
FROM o"""
)
def notice_cut_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the orders' pages: values in cells and paragraphs, several in a cell, a label without a value."""
    cut = quoting.cut_quotes(boundaries.boundary_text(F.col("html")))
    return notice_pages(spark, sf_dir).withColumn("q", cut).select("o_orderkey", "q.quote_deadline", "q.quote_eligibility", "q.quote_amount")


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list page for each customer, an item for each order, in the markup of one of two sites."""
    rows = table(spark, sf_dir, "orders").withColumn("period", F.expr(PERIOD)).withColumn("day", F.expr("date_format(o_orderdate, 'yyyy-MM-dd')"))
    item = F.expr(
        "case when o_custkey % 2 = 0 then '<tr><td class=\"num\">' || o_orderkey || '</td><td class=\"subject\"><a href=\"view?no=' || o_orderkey || '&amp;p=1\">' || o_orderpriority || ' <b>' || o_orderkey || '</b></a></td>"
        "<td class=\"date\"><span>접수기간 <em>' || split(period, ' ~ ')[0] || '</em>(화) ~ <em>' || split(period, ' ~ ')[1] || '</em></span> <i>게시일 2001-01-01</i></td><td>' || o_orderstatus || '</td></tr>' "
        "else '<li class=\"card\"><div><a href=\"#none\" onclick=\"go(\\'' || o_orderkey || '\\')\">글 ' || o_orderkey || '</a></div><p>작성일 : ' || day || '</p></li>' end"
    )
    pages = rows.select("o_custkey", "o_orderkey", item.alias("item")).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))), lambda x: x["item"]), "").alias("items"))
    even = F.col("o_custkey") % 2 == 0
    url = F.concat(F.when(even, "https://even.example.org/list/").otherwise("https://odd.example.org/"), "o_custkey")
    html = F.concat(F.lit("<body><ul><li><a href='/'>Home</a></li></ul>"), F.when(even, "<table>").otherwise("<ul class='cards'>"), "items", F.when(even, "</table>").otherwise("</ul>"), F.lit("</body>"))
    return pages.select("o_custkey", url.alias("url"), html.alias("html"))


SITES = [
    ("even", "even.example.org", "tr", "td.subject a", None, "td.date", None, r"no=(\d+)", "https://even.example.org/list/"),
    ("odd", "odd.example.org", "ul.cards li.card", "a", "a", "p", "p", r"go\('(\d+)'\)", "https://odd.example.org/"),
]


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
  strftime(o_orderdate, '%Y.%m.%d') || ' ~ ' || strftime(o_orderdate + INTERVAL 20 DAY, '%Y.%m.%d') AS period, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT o_custkey, 'even' AS source, CAST(pos AS INT) AS pos, CAST(o_orderkey AS VARCHAR) AS source_id, o_orderpriority || ' ' || o_orderkey AS title,
  'https://even.example.org/list/view?no=' || o_orderkey || '&p=1' AS url, period AS date, '접수기간' AS label, NULL AS author FROM o WHERE o_custkey % 2 = 0
UNION ALL
SELECT o_custkey, 'odd', CAST(pos AS INT), CAST(o_orderkey AS VARCHAR), '글 ' || o_orderkey, 'https://odd.example.org/', day, NULL, '작성일 : ' || day FROM o WHERE o_custkey % 2 = 1""")
def site_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the customers' list pages, by two site-configuration rows and the table function ``list_items``."""
    sites = spark.createDataFrame(SITES, listings.CONFIG)
    return listings.site_items(list_pages(spark, sf_dir), sites, "o_custkey", "url", "html")


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos,
  strftime(o_orderdate, '%Y.%m.%d') || ' ~ ' || strftime(o_orderdate + INTERVAL 20 DAY, '%Y.%m.%d') AS period, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
SELECT DISTINCT o_custkey, 0 AS pos, 'Home' AS text, '' AS date, '' AS label FROM o
UNION ALL SELECT o_custkey, CAST(pos AS INT),
  CASE WHEN o_custkey % 2 = 0 THEN o_orderkey || ' ' || o_orderpriority || ' ' || o_orderkey || ' 접수기간 ' || replace(period, ' ~', ' (화) ~') || ' 게시일 2001-01-01 ' || o_orderstatus ELSE '글 ' || o_orderkey || ' 작성일 : ' || day END,
  CASE WHEN o_custkey % 2 = 0 THEN period ELSE day END, CASE WHEN o_custkey % 2 = 0 THEN '접수기간' ELSE '작성일' END FROM o""")
def list_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and label of every item of the customers' list pages: ranges before single dates, the smallest element."""
    return boundaries.dates_and_labels(list_pages(spark, sf_dir), "o_custkey", "html")
