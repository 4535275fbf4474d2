"""Korean rules on hand-made rows: regions, tags, verdicts, periods, quotes, sentences."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bulletinlake.functions import evidence, notices
from bulletinlake.operators import sentences


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_regions(spark):
    got = values(
        spark,
        notices.infer_region,
        "[모집] 지원사업 [경기]",
        "경기침체 대응 지원",
        "경기센터 모집",
        "[세종대전충청센터] 모집",
        "지원사업 (설명회 장소: 서울) 강원",
        "사업 [경기에서 사업하는 기업] 모집",
        "서울 부산 공동",
        "경기에너지 사업",
        "전라남도 지원",
        None,
    )
    assert got == ["경기", None, "경기", "충청", "강원", "경기", None, None, "전남", None]


def test_tags(spark):
    got = values(spark, notices.target_tags, "사회적협동조합 모집", "협동조합과 사회적협동조합", "소셜벤처 임업", "사회적경제 포럼", "없음")
    assert got == [["사협"], ["사협", "협동조합"], ["사회적기업", "산림사업자"], ["전체"], []]


@pytest.mark.parametrize(
    "title, source, verdict, reason",
    [
        ("농기계 지원사업 모집", "smartfarm", "exclude", "협의회 소스 풀 외"),
        ("사회적기업 지원사업 모집", "smartfarm", "apply", "기회: 모집"),
        ("산림 분야 직원 채용 공고", "kofpi", "hold", "노이즈 의심: 채용"),
        ("직원 채용", "kofpi", "exclude", "노이즈: 채용"),
        ("일반 안내", "kofpi", "exclude", "관련성 없음"),
        ("산지관리법 시행령 개정 입법예고 공고", "lawmaking", "notice", "제도: 입법예고"),
        ("나눔의 숲 캠프 모집", "fowi", "hold", "참가자 모집(B2C): 캠프"),
        ("산림 기업 캠프 모집", "fowi", "apply", "기회: 모집"),
        ("임업 기본계획 발표", "forest_press", "notice", "제도: 기본계획"),
        ("산림 이야기", "forest_press", "hold", "섹션 판정 불명"),
        ("자활기업 모집", "seis", "hold", "대상 태그 없음"),
    ],
)
def test_verdicts(spark, title, source, verdict, reason):
    row = spark.createDataFrame([(title, "", source)], "t string, s string, src string")
    got = row.select(notices.classify(F.col("t"), F.col("s"), F.col("src"))).first()[0]
    assert (got["verdict"], got["reason"]) == (verdict, reason)


def test_quoted(spark):
    assert values(spark, lambda c: notices.quoted(c, notices.AMOUNT_QUOTES), "최대 3억 원 지원", "없음") == ["최대 3억 원", "원문 확인"]


GOLDEN = [
    ("ㅇ 접수기간 : 2026. 9. 7. ~ 9. 28. 18:00까지 ㅇ 문의처 02-1", None, False, 1, "", ("2026-09-07", "2026-09-28", None)),
    ("모집기간: ~ 안내 예정", None, False, 1, "", (None, None, "형태 불일치")),
    ("접수기간 : 2026. 9. 7. ~ 9. 28. ○ 9월 30일까지", None, False, 1, "", (None, None, "근거 충돌")),
    ("접수기간 2026.9.7 까지 신청기간 2026.9.9 까지", None, False, 2, "", (None, None, "라벨 중복")),
    ("접수기간 : 2026. 9. 14. 까지", None, False, 1, "", (None, "2026-09-14", None)),
    ("접수기간 : 2026. 2. 1. ~ 2. 30.", None, False, 1, "", (None, None, None)),
    ("접수기간 : 2026. 9. 28. ~ 9. 7.", None, False, 1, "", (None, None, None)),
    ("접수기간 : 2026. 9. 7. ~ 9. 28.", None, False, 1, "연장", (None, None, "근거 충돌")),
    ("접수기간 : 2026. 9. 7. ~ 9. 28.", None, True, 1, "", (None, None, "근거 절단")),
    ("", "2026-09-15", False, 0, "", (None, None, "근거 소실")),
    (None, None, False, None, None, (None, None, "근거 없음")),
    ("접수기간 : ’26. 9. 7. ~ ’26. 9. 28.", None, False, 1, "", ("2026-09-07", "2026-09-28", None)),
]


def test_detail_periods(spark):
    df = spark.createDataFrame([(i, *g[:5]) for i, g in enumerate(GOLDEN)], "i int, t string, f string, cut boolean, n int, cue string")
    got = df.orderBy("i").select(evidence.detail_period(*map(F.col, ("t", "f", "cut", "n", "cue")))).collect()
    assert [tuple(r[0]) for r in got] == [g[5] for g in GOLDEN]


def test_labels_and_cues(spark):
    assert values(spark, evidence.count_period_labels, "사업기간 접수기간 신청 기간", "접수기간 이전글 접수기간") == [2, 1]
    assert values(spark, evidence.conflict_cue, "기간 연장 변경", "본문 다음글 연장") == ["연장", ""]


QUOTES = [
    ("접수기간 2026.09.01 ~ 9.30 18:00까지", "2026-09-10", ("2026-09-01", "2026-09-30", False, False)),
    ("2026.12.20 ~ 1.10", "2026-09-10", ("2026-12-20", "2027-01-10", False, False)),
    ("12.20~2027.1.10", "2026-01-01", ("2026-12-20", "2027-01-10", False, False)),
    ("1차 2026.1.01~1.31 2차 2.01~2.28", "2026-02-10", ("2026-02-01", "2026-02-28", False, False)),
    ("1차 2026.1.01~1.31 2차 2.01~2.28", "2026-05-10", ("2026-02-01", "2026-02-28", False, False)),
    ("2026.09.01부터 예산 소진 시까지", "2026-01-01", ("2026-09-01", None, False, False)),
    ("2026.09.30까지, 예산 소진 시 조기마감", "2026-01-01", (None, "2026-09-30", False, True)),
    ("마감: 2026-10-02", "2026-01-01", (None, "2026-10-02", False, False)),
    ("상시 접수", "2026-01-01", (None, None, True, False)),
    ("2026.09.01", "2026-01-01", (None, None, False, False)),
    (None, "2026-01-01", (None, None, False, False)),
]


def test_quote_periods(spark):
    df = spark.createDataFrame([(i, q, dt.date.fromisoformat(t)) for i, (q, t, _) in enumerate(QUOTES)], "i int, q string, today date")
    got = df.orderBy("i").select(evidence.quote_period(F.col("q"), F.col("today"))).collect()
    assert [tuple(r[0]) for r in got] == [q[2] for q in QUOTES]


def test_quotes(spark):
    got = values(spark, evidence.quotes, "접수기간 : 2026.9.1 ~ 9.30\n교육기간 2026.10.1\n○ 지원대상: 사회적기업 문의처 02-111", "신청자격\n협동조합\n지원금액 최대 3억원 ○ 기타", "없음")
    assert [tuple(q) for q in got] == [("접수기간 : 2026.9.1 ~ 9.30", "지원대상: 사회적기업", None), (None, "신청자격 협동조합", "지원금액 최대 3억원"), (None, None, None)]


def test_sentences():
    text = "첫 문장입니다. 둘째 문장!\n1. 목록 항목\n가. 다음 항목\n시행일은 2026. 9. 1. 부터입니다. (붙임.) 끝"
    assert sentences.split_sentences(text) == ["첫 문장입니다.", "둘째 문장!", "1. 목록 항목", "가. 다음 항목", "시행일은 2026. 9. 1. 부터입니다.", "(붙임.) 끝"]
    assert sentences.split_sentences(None) == [] and sentences.split_sentences(" \n ") == []


def test_candidates(spark):
    rows = [(1, "사업 안내 제목입니다.\n사업 안내 제목입니다.\n신청 대상은 사회적기업 전체입니다.\n신청 대상은 사회적기업 전체입니다.\n123,456\n많은 참여 부탁드립니다.\n[링크](http://x) 를 보세요 여러분.", "사업 안내 제목입니다."), (2, None, "제목")]
    df = spark.createDataFrame(rows, "id long, text string, title string")
    assert [tuple(r) for r in sentences.candidates(df, "id", "text", "title").collect()] == [(1, 1, "신청 대상은 사회적기업 전체입니다.")]


def test_links_and_chunks():
    assert sentences.find_links("[a](https://x/(y)z) 그리고 (https://b.c/d). [no](mailto:x)") == [("a", "https://x/(y)z"), ("", "https://b.c/d")]
    text = "one two\nthree four five\n" + "x" * 25
    parts = sentences.chunk_lines(text, 12)
    assert all(len(p) <= 12 for p in parts) and "".join(parts).replace("\n", "").replace(" ", "") == text.replace("\n", "").replace(" ", "")
    assert sentences.chunk_lines(None, 5) == []


def test_digest_blocks(spark):
    text = "# 주간\n머리말\n## 신청하세요\n- [D-9] 제목 하나 — 설명 (원문: https://a/1)\n<!-- 보류 -->\n## 알아두세요\n- [새 소식] 둘"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = [tuple(r)[2:] for r in sentences.digest_blocks(df, "id", "text").orderBy("pos").collect()]
    assert [g[1] for g in got] == ["section", "prose", "section", "item", "comment", "section", "item"]
    assert got[3] == ("신청하세요", "item", "D-9", "제목 하나", "https://a/1") and got[6][0] == "알아두세요" and got[6][4] is None
    dead = spark.createDataFrame([("https://a/1",)], "url string")
    assert sentences.prune_dead(sentences.digest_blocks(df, "id", "text"), dead, "id", "url").count() == 6
