"""Ingest and digest from end to end on hand-made rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bulletinlake import schemas
from bulletinlake.plans import digest, ingest

NOW = "2026-09-10 09:00:00"
PROFILE = {"sources": ["kofpi", "lifein"], "must_match": ["임업"], "exclude": ["인사"], "eligibility": {}, "region": {}}
DOMAINS = {"forest": {"primary": ["임업"], "secondary": ["숲"]}, "farm": {"primary": ["스마트팜"], "secondary": []}}


def fetch(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, source_id string, title string, kind string, pos int")
    scored = ingest.scored(df, ["스마트팜"], {"임업": 1.0}, ["채용"], PROFILE, DOMAINS, F.lit(NOW))
    return scored.join(df.select("source", "source_id", "title", "pos"), ["source", "source_id", "title"])


def test_ingest(spark):
    stored = spark.createDataFrame([], schemas.ANNOUNCEMENTS)
    rows = [("bizinfo", "1", "스마트팜 임업 지원", "gonggo"), ("kofpi", "2", "임업 교육 모집", "gonggo"), ("kofpi", "3", "일반 안내", "gonggo"), ("lifein", "4", "임업 기사", "media"), ("bizinfo", "5", "스마트팜 채용", "gonggo")]
    snapshot, new, dropped = ingest.ingest(stored, fetch(spark, rows), "pos")
    got = {r["source_id"]: (r["relevance_score"], r["council_match"], r["council_only"], r["business_domain"]) for r in snapshot.collect()}
    assert got == {"1": (0.55, 0, 0, "farm"), "2": (0.05, 1, 1, "forest"), "4": (0.0, 1, 1, "forest")}
    assert new.count() == 3 and sorted(r["source_id"] for r in dropped.collect()) == ["3", "5"]
    again, new, _ = ingest.ingest(snapshot, fetch(spark, [("kofpi", "2", "스마트팜 임업 교육 모집", "gonggo"), *rows[3:4]]), "pos")
    got = {r["source_id"]: (r["title"], r["council_only"]) for r in again.collect()}
    assert got["2"] == ("임업 교육 모집", 0) and got["4"][1] == 1 and new.count() == 0
    assert [r["source_id"] for r in ingest.to_notify(again, F.lit("2026-09-10")).collect()] == ["1", "2"]
    assert [r["source_id"] for r in ingest.search(again, "임업").collect()] == ["1", "2"]


def announcements(spark, rows):
    out = [(i, s, t, "", f"https://x/{i}", start, end, created, "{}") for i, s, t, start, end, created in rows]
    df = spark.createDataFrame(out, "id long, source string, title string, summary string, url string, period_start string, period_end string, created_at string, raw_data string")
    return df


def test_digest(spark):
    day = "2026-09-08T10:00:00"
    rows = [
        (1, "kofpi", "임업 지원사업 모집", None, "2026-09-20", day),
        (2, "kofpi", "임업 지원사업  모집", None, "2026-09-20", day),
        (3, "kofpi", "임산물 사업자 공모", None, "2026-09-18", day),
        (4, "kofpi", "목재 기업 모집", None, "2026-09-30", day),
        (5, "seis", "사회적기업 모집", None, "2026-09-01", day),
        (6, "lawmaking", "산지관리법 개정 입법예고", None, None, day),
        (7, "fowi", "나눔의 숲 캠프 모집", None, None, day),
        (8, "smartfarm", "농기계 모집", None, None, day),
        (9, "kofpi", "지난주 임업 모집", None, None, "2026-08-30T10:00:00"),
        (10, "seis", "마을기업 모집", "2026-09-07", "2026-09-07", "2026-09-06T15:30:00+00:00"),
    ]
    got = digest.compose(announcements(spark, rows), "2026-09-07", "2026-09-13", "2026-09-10", pins=[7]).cache()
    by = {r["id"]: r for r in got.collect()}
    assert set(by) == {1, 3, 4, 5, 6, 7, 8, 10}
    assert by[1]["merged_ids"] == [1, 2] and by[5]["outcome"] == "마감 경과" and by[8]["outcome"] == "협의회 소스 풀 외"
    chosen = sorted((r["section"], r["position"], r["id"]) for r in by.values() if r["position"])
    assert chosen == [("apply", 1, 7), ("apply", 2, 3), ("apply", 3, 1), ("apply", 4, 10), ("notice", 1, 6)]
    assert by[4]["outcome"] == "diversity" and by[10]["label"] == "새 소식" and by[3]["label"] == "D-8"
    page = digest.markdown(got).first()["markdown"].split("\n")
    assert page[0] == "## 신청하세요" and page[5] == "## 알아두세요" and page[2] == "- [D-8] 임산물 사업자 공모 — 산림사업자 (원문: https://x/3)"
