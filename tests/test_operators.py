"""Operators against sequential models and golden rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from bulletinlake import schemas
from bulletinlake.operators import linkage, merge, ranking, reconcile, reports, scoring


def sequential_topk(rows, cap, per):
    """(id, source, score, pin) in order; what a loop over the sorted list chooses and why."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    out, used, n = {}, {}, 0
    for i, s, _, pin in rows:
        if pin:
            if n < cap:
                n += 1
                used[s] = used.get(s, 0) + 1
                out[i] = "selected"
            else:
                out[i] = "pin_cap"
    for i, s, _, pin in rows:
        if pin:
            continue
        if n >= cap:
            out[i] = "cap"
        elif used.get(s, 0) >= per:
            out[i] = "diversity"
        else:
            n += 1
            used[s] = used.get(s, 0) + 1
            out[i] = "selected"
    return out


def test_capped_topk_equals_a_loop(spark):
    rng = random.Random(3)
    for case in range(6):
        n, cap = rng.randint(0, 60), rng.randint(1, 12)
        rows = [(i, f"s{rng.randint(0, 4)}", rng.randint(0, 9), rng.random() < (0, 0.1, 0.5)[case % 3]) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, source string, score int, pin boolean")
        got = {r["id"]: r["reason"] for r in ranking.capped_topk(df, "id", "source", [("score", True), ("id", False)], cap, 2, "pin").collect()}
        assert got == sequential_topk(rows, cap, 2), (case, cap)


def test_round_robin_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, "w1" if i % 2 else "w2", rng.choice("abcx"), f"s{rng.randint(0, 3)}", rng.randint(0, 50)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, issue string, rule string, source string, score int")
    got = {}
    for r in ranking.round_robin(df, "issue", "rule", "source", "id", [("score", True), ("id", False)], ["a", "b", "c"], 7, 2).orderBy("issue", "position").collect():
        got.setdefault(r["issue"], []).append(r["id"])
    for issue in ("w1", "w2"):
        queues = {q: sorted((r for r in rows if r[1] == issue and r[2] == q), key=lambda r: (-r[4], r[0])) for q in "abc"}
        used, want = {}, []
        while len(want) < 7 and any(queues.values()):
            for q in "abc":
                while queues[q] and len(want) < 7:
                    r = queues[q].pop(0)
                    if used.get(r[3], 0) < 2:
                        used[r[3]] = used.get(r[3], 0) + 1
                        want.append(r[0])
                        break
        assert got[issue] == want


def test_merge_same(spark):
    rows = [(1, "k", "x", False, False), (2, "k", "x", False, True), (3, "k", "y", False, False), (4, "k", "x", True, False), (5, "j", "x", True, False), (6, "j", "x", False, False)]
    df = spark.createDataFrame(rows, "id long, key string, sig string, renewal boolean, b2b boolean")
    got = sorted((r["id"], r["merged_ids"]) for r in linkage.merge_same(df, ["key"], ["sig"], "id", "id", "renewal", "b2b").collect())
    assert got == [(2, [1, 2]), (3, [3]), (4, [4]), (5, [5]), (6, [6])]


def test_duplicate_plan(spark):
    rows = [(1, "seis", "p1", "t", "a", "", "2026-01-01", 5), (2, "seis", "p2", "t", "a", "", "2026-01-01", 9), (3, "seis", "p3", "u", "", "1차", None, 1), (4, "seis", "p4", "u", "b", "1차", None, 1), (5, "seis", "p5", "u", "b", "2차", None, 1)]
    df = spark.createDataFrame(rows, "id long, source string, source_id string, title_key string, subjects string, rounds string, deadline string, rank int")
    merged = spark.createDataFrame([(3, "p4"), (3, "p5")], "id long, merged_id string")
    plan = linkage.plan_duplicates(df, merged)
    assert sorted(tuple(r) for r in plan.select("id", "keeper", "rule").collect()) == [(1, 2, "B"), (4, 3, "A")]
    assert linkage.plan_violations(plan, df).count() == 0
    assert linkage.plan_violations(plan.unionByName(spark.createDataFrame([(2, 99, "B")], "id long, keeper long, rule string").select(*plan.columns)), df).count() == 2


def test_similar_pairs_equal_all_pairs(spark):
    rng = random.Random(7)
    sets = [(i, [f"t{rng.randint(0, 12)}" for _ in range(rng.randint(0, 8))]) for i in range(60)]
    got = {(r["left_id"], r["right_id"]): round(r["similarity"], 9) for r in linkage.similar_pairs(spark.createDataFrame(sets, "id long, items array<string>"), "id", "items", 0.5).collect()}
    want, same = {}, {}
    for i, a in sets:
        if a:
            same.setdefault(frozenset(a), []).append(i)
    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and set(a) != set(b) and (s := len(set(a) & set(b)) / len(set(a) | set(b))) >= 0.5:
                want[i, j] = round(s, 9)
    want |= {(g[0], i): 1.0 for g in same.values() for i in g[1:]}
    assert got == want


def test_upsert_ratchets_and_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1, 0.5, "x", 1), ("b", 1, 0.1, None, 0), ("c", 0, 0.9, "z", 1)], "key string, sent int, score double, tags string, only int")
    new = spark.createDataFrame([("a", 0, 0.7, None, 0), ("b", 0, 0.2, "y", 1), ("d", 0, 0.3, "n", 1)], "key string, sent int, score double, tags string, only int")
    once = merge.upsert(old, new, ["key"], ["score"], ["tags"], ["only"])
    want = [("a", 1, 0.7, "x", 0), ("b", 1, 0.2, "y", 0), ("c", 0, 0.9, "z", 1), ("d", 0, 0.3, "n", 1)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, merge.upsert(once, new, ["key"], ["score"], ["tags"], ["only"]).collect())) == want


def test_fold_batch_keeps_the_last_and_the_lowest(spark):
    rows = [("a", 1, "first", 1), ("a", 2, "second", 0), ("a", 3, "third", 1)]
    got = merge.fold_batch(spark.createDataFrame(rows, "key string, pos int, v string, only int"), ["key"], "pos", ["only"]).first()
    assert (got["v"], got["only"]) == ("third", 0)


def test_carry_forward_needs_the_same_url(spark):
    now = spark.createDataFrame([("a", "u1", None), ("b", "u2", None), ("c", "u3", "own")], "key string, url string, evidence string")
    before = spark.createDataFrame([("a", "u1", "kept"), ("b", "moved", "lost"), ("c", "u3", "old")], "key string, url string, evidence string")
    assert sorted(map(tuple, merge.carry_forward(now, before, ["key"], "url", "evidence").collect())) == [("a", "u1", "kept"), ("b", "u2", None), ("c", "u3", "own")]


def test_relevance(spark):
    df = spark.createDataFrame([("스마트팜 지원", "청년농 AI"), ("스마트팜 채용", ""), ("없음", None)], "title string, summary string")
    r = scoring.keyword_relevance([F.col("title"), F.col("summary")], ["스마트팜"], {"청년농": 1.0, "ai": 20.0}, ["채용"])
    got = [tuple(x[0]) for x in df.select(r).collect()]
    assert got == [(1.0, "필수 키워드 매칭 + 추가 키워드 2개", ["스마트팜", "청년농", "ai"]), (0.0, "제외 키워드 발견", ["채용"]), (0.0, "관련 키워드 없음", [])]


PROFILE = {"sources": ["kofpi"], "must_match": ["사회적기업", "임업"], "exclude": ["인사"], "eligibility": {"예비": ["예비사회적기업"]}, "region": {"경기": ["경기", "경기도"]}}


def test_council(spark):
    rows = [("kofpi", "(예비) 사회적기업 모집", "경기도", "gonggo"), ("kofpi", "공고", "임업", "media"), ("kofpi", "인사·발령 임업", "", "gonggo"), ("other", "임업", "", "gonggo"), ("kofpi", "인사이동 임업", "", "gonggo")]
    df = spark.createDataFrame(rows, "source string, title string, summary string, kind string")
    got = [x[0] for x in df.select(scoring.council_score(F.col("source"), [F.col("title"), F.col("summary")], F.col("kind"), PROFILE)).collect()]
    assert [(g["score"], g["match"]) for g in got] == [(0.6, 1), (0.0, 0), (0.0, 0), (0.0, 0), (0.5, 1)]
    assert got[2]["reason"] == "제외 키워드: 인사" and got[3]["reason"] == "협의회 소스 아님" and got[0]["reason"] == "협의회 어휘 1개 + 태그 2개"


def test_domains_ties_go_to_the_first(spark):
    domains = {"one": {"primary": ["가"], "secondary": []}, "two": {"primary": ["나"], "secondary": []}}
    df = spark.createDataFrame([("가 나",), ("없음",)], "t string")
    assert [tuple(r[0]) for r in df.select(scoring.best_domain(F.col("t"), domains)).collect()] == [("one", 1.0), ("", 0.0)]


def test_health(spark):
    rows = [(None, "timeout", None, None, 0), (500, None, None, None, 0), (200, None, 0, None, 3), (200, None, 5, "2026-01-01", 3), (200, None, 5, "2026-05-01", 0), (200, None, 5, "2026-05-01", 3)]
    df = spark.createDataFrame(rows, "status int, error string, parsed int, latest string, n int")
    v = scoring.health_verdict(F.col("status"), F.col("error"), F.col("parsed"), F.to_date("latest"), F.lit("2026-05-10").cast("date"), F.col("n"))
    assert [r[0]["verdict"] for r in df.select(v).collect()] == ["unreachable", "unreachable", "parse_fail", "stale", "empty", "ok"]


def test_reconcile(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "id long, v string")
    right = spark.createDataFrame([(1, "x"), (2, "b"), (3, None), (4, "d")], "id long, v string")
    assert sorted(map(tuple, reconcile.reconcile(left, right, "id", ["v"]).collect())) == [(1, "v differs"), (2, "repeated"), (4, "extra")]


def test_exact_batch(spark):
    want = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "batch string, n int")
    got = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "batch string, n int")
    assert {r["batch"]: r["accepted"] for r in reconcile.exact_batch(want, got, "batch", "n").collect()} == {"a": True, "b": False, "c": False}


def test_can_send_stops_at_the_first_problem(spark):
    rows = [("approved", "h", "h", True, 3, None), ("approved", "h", "g", False, 3, None), ("draft", "h", "h", True, 3, None), ("approved", "h", "h", True, 3, "2026-W20"), ("approved", None, None, True, 3, None)]
    df = spark.createDataFrame(rows, "status string, a string, b string, ok boolean, n int, newer string")
    got = [r[0]["reason"] for r in df.select(reconcile.can_send(*map(F.col, ("status", "a", "b", "ok", "n", "newer")))).collect()]
    assert got == [None, "body changed since approval", "not approved", "a newer issue is open", "body changed since approval"]


def test_histogram_has_zero_rows(spark):
    df = spark.createDataFrame([("ok",), ("ok",), ("stale",)], "verdict string")
    assert [tuple(r) for r in reports.histogram(df, "verdict", ["ok", "empty", "stale"]).orderBy("position").collect()] == [(0, "ok", 2), (1, "empty", 0), (2, "stale", 1)]


def test_markdown_and_ordered_lists(spark):
    df = spark.createDataFrame([("b", 2), ("a", None)], "name string, n int")
    assert reports.markdown_table(df, ["name", "n"], [F.col("name")]).first()[0] == "| name | n |\n|---|---|\n| a |  |\n| b | 2 |"
    rows = spark.createDataFrame([("x", 2, "second"), ("x", 1, "first")], "g string, pos int, v string")
    assert reports.ordered_list(rows, "g", "pos", "v", "vs").first()["vs"] == ["first", "second"]


def test_defaults(spark):
    got = schemas.with_defaults(spark.createDataFrame([(1, "s")], "id long, source string"), schemas.ANNOUNCEMENTS).first()
    assert (got["kind"], got["council_only"], got["council_match"], got["is_notified"]) == ("gonggo", 0, None, 0)


def test_gap_and_rotation(spark):
    df = spark.createDataFrame([("a", f"2026-01-{d:02d}") for d in (1, 2, 3, 4, 6, 9)], "g string, day string")
    assert sorted(str(r["day"])[-2:] for r in ranking.gap_select(df, "g", "day", 2).collect()) == ["01", "03", "06", "09"]
    cand = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, pos int")
    prior = spark.createDataFrame([("a", "2026-01-02"), ("b", "2026-01-01")], "key string, at string")
    assert [r["key"] for r in ranking.fair_rotation(cand, prior, "key", "at", "pos", 2).orderBy("turn").collect()] == ["c", "b"]
