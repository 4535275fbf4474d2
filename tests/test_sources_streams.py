"""Readers on inline documents, and streams against their batch forms."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bulletinlake.operators import vectors
from bulletinlake.sources import feeds, html
from bulletinlake.streaming import ingest


def test_envelopes(spark):
    bodies = [
        '{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":[{"no":"1","ord":"2","nm":"A","per":"20260401 ~ 20260430"},{"no":"2","nm":""}]}}}}',
        '{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":{"no":"3","nm":"B"}}}}}',
        '{"response":{"header":{"resultCode":"00"},"body":{"items":[{"nm":"null","no":"5"},{"nm":"E","link":"https://e"}]}}}',
        '{"response":{"header":{"resultCode":"99"},"body":{"items":[{"no":"4","nm":"C"}]}}}',
        "not json",
        None,
    ]
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    got = feeds.json_announcements(df, "body", "src", {"source_id": ["no", "ord"], "title": "nm", "url": "link", "period": "per"}, "https://x/{}/v", ok_code=("response.header.resultCode", "00")).collect()
    assert sorted((r["source_id"], r["title"], r["url"], r["period_start"], r["period_end"]) for r in got)[:2] == [("1-2", "A", "https://x/1-2/v", "2026-04-01", "2026-04-30"), ("3", "B", "https://x/3/v", None, None)]
    assert len(got) == 3 and {r["title"] for r in got} == {"A", "B", "E"}


def test_feeds(spark):
    rss = '<rss><channel><item><title>T1</title><link>https://a/news?idxno=77</link><description>&lt;p&gt;hello  x&lt;/p&gt;</description><pubDate>Tue, 3 Feb 2026 23:00:00 +0900</pubDate></item><item><title>T2</title><guid isPermaLink="false">g2</guid></item><item><title>T3</title><guid>https://a/55555</guid></item><item><title></title></item></channel></rss>'
    atom = '<feed><entry><title>A1</title><link href="https://b/12345"/><summary>s</summary><updated>2026-02-04T00:00:00Z</updated></entry></feed>'
    got = {r["title"]: r for r in feeds.feed_announcements(spark.createDataFrame([(rss,), (atom,), ("<broken",), (None,)], "x string"), "x", "src", "media").collect()}
    assert (got["T1"]["source_id"], got["T1"]["summary"], got["T1"]["posted"]) == ("77", "hello x", "2026-02-03")
    assert got["T2"]["url"] == "" and got["T3"]["url"] == "https://a/55555" and got["T3"]["source_id"] == "55555"
    assert got["A1"]["source_id"] == "12345" and set(got) == {"T1", "T2", "T3", "A1"} and got["T1"]["kind"] == "media"


def test_forms(spark, tmp_path):
    path = tmp_path / "responses.csv"
    path.write_text("﻿접수일,회원사,유형,내용,관련정책\n2026-01-01,가,소식,첫째,\n2026-01-02,가,소식,\"둘\n째\",\n2026-01-02,나,의견,의견 하나,정책\n2026-01-03,다,소식,,\n", encoding="utf-8")
    news, opinions = feeds.form_responses(spark, str(path))
    assert [tuple(r) for r in news.collect()] == [("가", ["첫째", "둘\n째"])]
    assert [(r["opinion"], r["policy"]) for r in opinions.collect()] == [("의견 하나", "정책")]


def test_visible_text():
    page = '<body><nav>m</nav><div id="content">9월 <b>22</b>일 10<sup>4</sup>㎡ <span style="display:/**/none">x</span><p>a<p>b</div><footer>f</footer></body>'
    assert html.visible_text_of(page) == "9월 22일 10￼㎡ a b"
    assert html.visible_text_of("<article></article><main>main</main>") == "main"
    assert html.visible_text_of(None) == "" and html.visible_text_of("<p hidden>x</p>y") == "y"
    assert html.visible_text_of("<div>" * 2000 + "deep") == "deep"


def test_lists(spark):
    page = '<ul><li><a href="/m">menu</a></li></ul><table><tr><td><a href="/1">제목 하나</a></td><td>2026.3.4</td></tr><tr><td>no link</td></tr></table>'
    assert html.list_rows_of(page) == [("제목 하나", "/1", "2026.3.4")]
    assert html.list_rows_of('<ul><li><a href="/m">menu</a> 2026-01-02</li></ul>') == [("menu", "/m", "2026-01-02")]
    assert html.list_rows_of('<p><a href="/x">only</a>') == [("only", "/x", None)] and html.list_rows_of(None) == []
    rows = spark.createDataFrame([(1, 2, "a"), (1, 1, "b"), (1, 1, "c"), (2, 3, "a")], "page int, board int, id string")
    assert sorted(r["id"] for r in feeds.first_board_with_rows(rows, "board", "page").collect()) == ["a", "b", "c"]
    assert sorted((r["board"], r["id"]) for r in feeds.union_boards(rows, "board", "id").collect()) == [(1, "b"), (1, "c"), (2, "a")]


def test_decoding(spark):
    pages = [("한글".encode("euc-kr"), "euc-kr"), (b"\xef\xbb\xbf" + "한글".encode(), "euc-kr"), ('<meta charset="euc-kr">한글'.encode("euc-kr"), None), ("한글".encode(), "no-such"), (None, None)]
    df = spark.createDataFrame(pages, "b binary, h string")
    got = [r[0] for r in df.select(html.decoded(F.col("b"), F.col("h"))).collect()]
    assert got == ["한글", "한글", '<meta charset="euc-kr">한글', "한글", ""]


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "id long, v array<float>")
    assert [r["id"] for r in vectors.similar_to_row(df, "id", "v", 1, 2).collect()] == [2, 3]
    assert [r["id"] for r in vectors.similar_to(df, "id", "v", [0.0, 0.9], 1, "l2").collect()] == [3]
    assert vectors.similar_to_row(df, "id", "v", 9, 2).count() == 0
    assert df.where("id = 1").select(vectors.vector_literal(F.col("v"))).first()[0] == "[1.0,0.0]"


def test_upsert_stream_runs_again_the_same(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.createDataFrame([], "key string, score int, only int").schema
    sink = ingest.upsert_sink(out, schema, ["key"], "pos", ["score"], ratchet=["only"])
    for n, rows in enumerate(([("a", 1, 1, 1), ("a", 2, 0, 2), ("b", 5, 1, 3)], [("a", 9, 1, 4), ("c", 7, 1, 5)])):
        spark.createDataFrame(rows, "key string, score int, only int, pos int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key string, score int, only int, pos int").parquet(source)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    want = [("a", 9, 0), ("b", 5, 1), ("c", 7, 1)]
    assert sorted(map(tuple, ingest.latest(spark, out, schema).collect())) == want
    sink(spark.createDataFrame([("a", 9, 1, 4), ("c", 7, 1, 5)], "key string, score int, only int, pos int"), 1)
    assert sorted(map(tuple, ingest.latest(spark, out, schema).collect())) == want


def test_recheck_stream(spark, tmp_path):
    rows = [("a", "h1", dt.datetime(2026, 1, 1)), ("a", "h1", dt.datetime(2026, 1, 1, 5)), ("a", "h2", dt.datetime(2026, 1, 1, 6)), ("a", "h2", dt.datetime(2026, 1, 2, 7)), ("b", "x", dt.datetime(2026, 1, 1))]
    spark.createDataFrame(rows, "key string, h string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, h string, at timestamp").parquet(str(tmp_path / "in"))
    run = ingest.recheck_due(stream, "key", "h", "at").writeStream.format("memory").queryName("rechecks").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted((r["key"], r["hash"], r["due"]) for r in spark.table("rechecks").collect()) == [("a", "h1", False), ("a", "h1", True), ("a", "h2", True), ("a", "h2", True), ("b", "x", True)]
