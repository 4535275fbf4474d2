"""Text and date functions on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bulletinlake.functions import dates, text


@pytest.fixture(scope="module")
def one(spark):
    row = spark.range(1)
    return lambda *columns: tuple(row.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


L = F.lit


def test_titles(one):
    got = one(
        text.sanitise_title(L("## [모집](https://x.y/(a)) 산림 <https://a.b> — 제도")),
        text.sanitise_title(L("1. 첫째")),
        text.merge_title_key(L(" 최대 1.5억원　지원 ")),
        text.dedup_key(L("[경기] 2026.9.1 ~ 9.30 모집 3차!")),
        text.strip_brackets(L("사업 (안내 (서울)) 모집")),
        text.prefix_signature(L("[모집] (경기) 사업 [강원]")),
        text.round_tokens(L("03차 상시 2차 3 차")),
        text.normalise_title(L(None).cast("string")),
    )
    assert got == ("＃＃ 모집 산림 https://a.b – 제도", "1． 첫째", "최대1.5억원지원", "경기 모집", "사업 모집", "[모집][경기]", "2차|3차|상시", "")


def test_council_text(one):
    keys, tokens, inside, apart = one(
        text.council_key(L("(예비) 사회적기업")),
        text.council_tokens(L("인사·발령, [결과]")),
        text.token_sequence_in(F.split(L("a b c"), " "), F.split(L("b c"), " ")),
        text.token_sequence_in(F.split(L("a bb c"), " "), F.split(L("b c"), " ")),
    )
    assert (keys, tokens, inside, apart) == ("예비사회적기업", ["인사", "발령", "결과"], True, False)


def test_keywords(one):
    assert one(*[text.keyword_match(L(t), "AI") for t in ("ai융합", "fair", "an ai.", "x ai")]) == (True, False, True, True)
    assert one(text.holds_any(L("x"), []), text.holds_any(L("x"), [], True), text.hits(L("b a"), ["a", "c", "b"])) == (False, True, ["a", "b"])


def test_ngrams(one):
    got = one(text.ngrams(L("abcab"), 3), text.ngrams(L("ab"), 3), text.ngrams(L(""), 3), text.jaccard(F.array(L("a"), L("b")), F.array(L("b"))))
    assert got == (["abc", "bca", "cab"], ["ab"], [], 0.5)


def test_hash_and_masks(one):
    import hashlib

    got = one(text.content_hash(L("a"), L(None), L("c")), text.mask_contacts(L("mail a.b@c.kr or 010-1234-5678")), text.redact(L("u?serviceKey=abc&x=1")))
    assert got == (hashlib.sha256(b"a\0\0c").hexdigest(), "mail [email] or [phone]", "u?serviceKey=***&x=1")


def test_anchored_window(one):
    window = lambda t, a, n: text.anchored_window(L(t), L(a), n)
    got = one(window("x key a key b", "key", 5), window("abc", "zz", 2), window("start of anchor text", "start of anchor text that is cut", 100))
    assert [tuple(g) for g in got] == [("key b", False), ("ab", True), ("start of anchor text", False)]


def test_json(one):
    patch = F.create_map(L("b"), L("z"), L("c"), L(""), L("x"), L("no"))
    got = one(text.json_map(L("[1]")), text.json_map(L("{bad")), text.json_patch(L('{"a":"1","d":"old"}'), patch, ["b", "c"], {"b": ["d"]}), text.json_submap(L('{"detail_a":"x","detail_b":""}'), "detail_"))
    assert got == ({}, {}, '{"a":"1","b":"z"}', {"detail_a": "x"})


def test_dates(one):
    d = dt.date
    assert one(*[dates.parse_deadline(L(t)) for t in ("2026.9.3(목)", "26-02-28", "2026-02-30", "soon", "2026년 3월 4일")]) == (d(2026, 9, 3), d(2026, 2, 28), None, None, d(2026, 3, 4))
    assert one(dates.date_parse_failed(L("soon")), dates.date_parse_failed(L("")), dates.effective_deadline(L("2026-01-01"), L("2026-01-01"))) == (True, False, None)
    assert one(*[dates.kst_date(L(t)) for t in ("2026-09-06T15:30:00+00:00", "2026-09-06T15:30:00", "2026-09-06T23:00:00Z", "x")]) == (d(2026, 9, 7), d(2026, 9, 6), d(2026, 9, 7), None)
    assert one(*dates.week_range(L("2026-W13")), *dates.month_range(L("2026-M12"))) == (d(2026, 3, 23), d(2026, 3, 29), d(2026, 12, 1), d(2026, 12, 31))
    assert one(*[dates.issue_kind(L(k)) for k in ("2026-W53", "2026-W54", "2026-M12", "2026-M13")]) == ("weekly", None, "monthly", None)
    assert one(*dates.api_period(L("20260401 ~ 20260430")), *dates.api_period(L("20260401"))) == ("2026-04-01", "2026-04-30", "2026-04-01", "2026-04-01")
    assert one(dates.normalise_date(L("2026.2.31")), dates.normalise_date(L("20261301")), dates.compact_datetime(L("202603041200"))) == ("2026-02-31", None, "2026-03-04")
    assert one(dates.pub_date(L("Tue, 3 Feb 2026 09:00:00 +0900")), dates.pub_date(L("2026-02-03T00:00:00Z"))) == ("2026-02-03", "2026-02-03")


def test_ranges(one):
    got = one(*[dates.range_only(L(t)) for t in ("2026.9.3 ~ 10.5", "2026.9.3 ~ 2026.9.1", "접수 2026.9.3 ~ 10.5", "2026.9.3 ~ 2.30")])
    assert [g and tuple(g) for g in got] == [("2026-09-03", "2026-10-05"), None, None, None]


def test_labels(one):
    day = lambda s: L(s).cast("date")
    today = day("2026-03-10")
    got = one(*[dates.deadline_label(day(e) if e else L(None).cast("date"), day(p), today) for e, p in (("2026-03-12", "2026-01-01"), ("2026-03-10", "2026-01-01"), (None, "2026-03-05"), (None, "2026-01-01"))])
    assert got == ("D-2", "D-day", "새 소식", "상시")


def test_recheck(one):
    now = L("2026-01-02 00:00:00").cast("timestamp")
    got = one(*[dates.recheck_due(L("a"), L(h), L(t), now) for h, t in (("a", "2026-01-01T00:00:00"), ("a", "2026-01-01T00:30:00"), ("b", "2026-01-01T23:00:00"), ("a", "bad"))])
    assert got == (True, False, True, True)
