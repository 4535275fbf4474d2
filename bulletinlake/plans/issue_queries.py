"""Queries of the monthly issue, of links in pieces of text, and of working days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import urls, workdays
from ..session import table
from . import monthly
from .catalogue import query


def issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates of monthly issues, by expressions over their columns and labels."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    n = "(n_chars + doc_id)"
    return docs.selectExpr(
        "doc_id as id", "lang as issue", "source",
        f"case when {n} % 4 = 0 then 'media' else 'gonggo' end as kind",
        f"case {n} % 7 when 0 then '신청하세요' when 1 then '제외' when 2 then '보류' else '알아두세요' end as verdict",
        f"case {n} % 11 when 0 then '노이즈 의심: 채용' when 1 then '참가자 모집(B2C)' when 2 then '협의회 소스 풀 외' end as reason",
        f"case when {n} % 5 = 0 then '2026-09-30' end as deadline", f"case when {n} % 13 = 0 then '마감' else '' end as deadline_cue",
        "quality = 1 as council_match", f"{n} % 3 = 0 as council_only", "toxic = 1 as noise",
        f"case when {n} % 17 = 0 then '보도 노이즈' end as gate", f"date_format(date_add(date'2026-01-01', cast({n} % 90 as int)), 'yyyy-MM-dd') as posted",
        "cast(quality as double) / 2 as council_score", f"{n} % 101 = 0 as pinned",
    )


PRESS = ("src1", "src2", "src3")


@query("""
WITH r AS (SELECT d.doc_id AS id, lang AS issue, source, (n_chars + d.doc_id) AS n, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT *, n % 4 = 0 AS media, coalesce(quality = 1, FALSE) AS matched, source IN ('src1', 'src2', 'src3') AND (coalesce(quality = 1, FALSE) OR n % 3 <> 0) AS press,
  CASE n % 7 WHEN 0 THEN '신청하세요' WHEN 1 THEN '제외' WHEN 2 THEN '보류' ELSE '알아두세요' END AS verdict,
  CASE n % 11 WHEN 0 THEN '노이즈 의심: 채용' WHEN 1 THEN '참가자 모집(B2C)' WHEN 2 THEN '협의회 소스 풀 외' END AS reason,
  CASE WHEN n % 17 = 0 THEN '보도 노이즈' END AS gate FROM r),
ruled AS (SELECT *, CASE WHEN media THEN CASE WHEN matched THEN 'c' END WHEN press THEN 'b' WHEN verdict = '알아두세요' THEN 'a' END AS rule FROM c),
held AS (SELECT *, CASE WHEN verdict = '제외' AND NOT starts_with(coalesce(reason, ''), '노이즈') AND NOT coalesce(toxic = 1, FALSE) AND n % 5 <> 0 AND rule IN ('b', 'c')
    THEN CASE rule WHEN 'c' THEN '월간 편입: 2차 미디어' ELSE '월간 편입: 기관 보도·정책' END END AS rescued,
  CASE WHEN n % 11 IN (0, 1) THEN '월간호 대상 아님 (노이즈·참가자 모집)' WHEN n % 5 = 0 THEN '마감 있음 — 주간호 몫' WHEN n % 13 = 0 THEN '마감 미확인'
    WHEN media AND NOT matched THEN '협의회 어휘 없음 — 2차 미디어 제외' WHEN media THEN gate WHEN verdict = '신청하세요' THEN '행동 대상 — 주간호 몫'
    WHEN rule = 'b' THEN gate WHEN rule = 'a' THEN NULL ELSE '월간 대상 아님' END AS hold FROM ruled),
out AS (SELECT *, CASE WHEN verdict = '제외' AND rescued IS NULL THEN 'excluded' WHEN hold IS NOT NULL THEN 'held' ELSE 'candidate' END AS outcome FROM held),
ranked AS (SELECT *, outcome = 'candidate' AND media AND n % 101 <> 0 AS m,
  row_number() OVER (PARTITION BY issue, outcome = 'candidate' AND media AND n % 101 <> 0 ORDER BY n % 90 DESC, coalesce(quality / 2.0, 0) DESC, id) AS k FROM out)
SELECT issue, id, rule, CASE WHEN m AND k > 2 THEN 'held' ELSE outcome END AS outcome,
  CASE WHEN m AND k > 2 THEN '미디어 상한' WHEN outcome = 'excluded' THEN reason ELSE coalesce(hold, rescued) END AS note FROM ranked""")
def monthly_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages before places are filled: rules, rows taken back, reasons to hold, the cap of media."""
    rows = monthly.media_capped(monthly.staged(issue_rows(spark, sf_dir), PRESS), "issue", 2)
    return rows.select("issue", "id", "rule", "outcome", "note")


@query()
def monthly_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole monthly issue of each language, and why every other document isn't in it."""
    return monthly.monthly_issue(issue_rows(spark, sf_dir), "issue", 5, 2, 2, PRESS)


LINK = "'https://d.example/' || doc_id || '/p'"


def linked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a link after every sentence."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"regexp_replace(text, '[.] ', '. ' || {LINK} || ' ') as text")


@query(f"""
WITH t AS (SELECT doc_id, {LINK} AS url, replace(text, '. ', '. ' || {LINK} || ' ') AS text FROM documents),
p AS (SELECT doc_id, url, length(url) AS n, [length(x) FOR x IN string_split(text, url)] AS parts, length(text) AS total FROM t),
s AS (SELECT doc_id, url, n, total, unnest(range(1, len(parts))) AS k, parts FROM p),
u AS (SELECT doc_id, url, CAST(list_sum(parts[1:k]) + (k - 1) * n AS BIGINT) AS begin, n, total FROM s)
SELECT doc_id, url, CAST(begin AS INT) AS begin, CAST(begin + n AS INT) AS "end",
  CASE WHEN begin // 700 = (begin + n - 1) // 700 THEN CASE WHEN begin // 700 % 5 = 3 THEN 'lost' ELSE 'whole' END
    WHEN begin // 700 % 5 = 3 AND (begin + n - 1) // 700 % 5 = 3 THEN 'lost' ELSE 'split' END AS fate FROM u""")
def link_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the documents against pieces of 700 characters, of which every fifth is missing."""
    texts = linked_texts(spark, sf_dir)
    pieces = texts.select("doc_id", F.explode(F.expr("sequence(0, greatest(0, (length(text) - 1) div 700))")).alias("i"), F.length("text").alias("n"))
    pieces = pieces.where("i % 5 <> 3").selectExpr("doc_id", "cast(i * 700 as int) as begin", "cast(least(n, (i + 1) * 700) as int) as end")
    return urls.link_fates(texts, pieces, "doc_id", "text", 512)


@query(f"""
WITH t AS (SELECT doc_id, {LINK} AS url, replace(text, '. ', '. ' || {LINK} || ' ') AS text FROM documents),
c AS (SELECT doc_id, unnest([substr(text, i * 700 + 1, 700) FOR i IN range(0, (length(text) + 699) // 700)]) AS piece FROM t),
a AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s<>"''()\\[\\]{{}}]+')) AS url FROM t),
b AS (SELECT doc_id, unnest(regexp_extract_all(piece, 'https?://[^\\s<>"''()\\[\\]{{}}]+')) AS url FROM c),
x AS (SELECT doc_id, url, count(*) AS n FROM a GROUP BY ALL), y AS (SELECT doc_id, url, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, url, coalesce(x.n, 0) AS in_text, coalesce(y.n, 0) AS in_pieces FROM x FULL JOIN y USING (doc_id, url) WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that pieces of 700 characters have more or less often than the documents."""
    texts = linked_texts(spark, sf_dir)
    sent = texts.select("doc_id", F.explode(F.expr("transform(sequence(0, greatest(0, (length(text) - 1) div 700)), i -> substring(text, i * 700 + 1, 700))")).alias("piece"))
    return urls.link_counts(texts, sent, "doc_id", "text", "piece")


@query("""
WITH b AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) + 400 AS hi FROM orders),
d AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b),
w AS (SELECT day, isodow(day) < 6 AND NOT (month(day) = 12 AND dayofmonth(day) BETWEEN 24 AND 31) AND NOT (month(day) = 1 AND dayofmonth(day) <= 2) AS working FROM d),
n AS (SELECT *, sum(CAST(working AS INT)) OVER (ORDER BY day) AS number FROM w),
due AS (SELECT number, day FROM n WHERE working)
SELECT o_orderkey, CAST(x.number AS INT) AS number, due.day AS due, CAST(s.number - x.number AS INT) AS worked
FROM orders JOIN n x ON CAST(o_orderdate AS DATE) = x.day LEFT JOIN due ON due.number = x.number + 10
LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS ship FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey LEFT JOIN n s ON s.day = ship""")
def working_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's tenth working day after it, and the working days up to its last shipment; holidays from Christmas Eve to 2 January."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lo, hi = orders.agg(F.to_date(F.min("o_orderdate")).cast("string"), F.date_add(F.to_date(F.max("o_orderdate")), 400).cast("string")).first()
    years = spark.range(int(lo[:4]) - 1, int(hi[:4]) + 1).selectExpr("make_date(cast(id as int), 12, 24) as begin", "make_date(cast(id as int) + 1, 1, 2) as end")
    days = workdays.calendar(spark, lo, hi, years, off=(6, 7))
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("ship"))
    out = workdays.ahead(workdays.numbered(orders, days, "o_orderdate", "number"), days, "o_orderdate", 10, "due")
    out = workdays.numbered(out.join(shipped, "o_orderkey", "left"), days, "ship", "_shipped")
    return out.select("o_orderkey", "number", "due", (F.col("_shipped") - F.col("number")).alias("worked"))
