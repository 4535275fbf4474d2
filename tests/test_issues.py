"""The monthly issue, links in pieces and working days against plain loops."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import numpy as np
import pytest

from bulletinlake.operators import urls, workdays
from bulletinlake.plans import monthly

ROW = "id long, issue string, source string, kind string, verdict string, reason string, deadline string, deadline_cue string, council_match boolean, council_only boolean, noise boolean, gate string, posted string, council_score double, pinned boolean"


def plain_rule(r):
    if r["kind"] == "media":
        return "c" if r["council_match"] else None
    if r["source"] in monthly.PRESS_SOURCES and (r["council_match"] or not r["council_only"]):
        return "b"
    return "a" if r["verdict"] == monthly.NOTICE else None


def plain_issue(rows, limit, per_source, media_limit):
    out, left = {}, []
    for r in rows:
        r["rule"] = plain_rule(r)
        note = None
        if r["verdict"] == monthly.EXCLUDED:
            if (r["reason"] or "").startswith("노이즈") or r["noise"] or r["deadline"] or r["rule"] not in ("b", "c"):
                out[r["id"]] = ("excluded", None, r["reason"])
                continue
            note = monthly.RESCUED_MEDIA if r["rule"] == "c" else monthly.RESCUED_PRESS
        hold = None
        if (r["reason"] or "").startswith(monthly.HELD_PREFIXES):
            hold = monthly.NOT_MONTHLY
        elif r["deadline"]:
            hold = monthly.HAS_DEADLINE
        elif r["deadline_cue"]:
            hold = monthly.UNKNOWN_DEADLINE
        elif r["kind"] == "media":
            hold = r["gate"] if r["council_match"] else monthly.NO_MATCH
        elif r["verdict"] == monthly.APPLY:
            hold = monthly.ACTIONABLE
        elif r["rule"] == "b":
            hold = r["gate"]
        elif r["rule"] is None:
            hold = monthly.NOT_ELIGIBLE
        if hold:
            out[r["id"]] = ("held", None, hold)
        else:
            left.append((r, note))
    newest = lambda r: (tuple(-ord(c) for c in (r["posted"] or "").ljust(10, "\0")), -(r["council_score"] or 0.0), r["id"])
    media = sorted((r for r, _ in left if r["kind"] == "media" and not r["pinned"]), key=newest)
    for r in media[media_limit:]:
        out[r["id"]] = ("held", None, monthly.MEDIA_CAP)
    left = [(r, n) for r, n in left if r["id"] not in out]

    def choose(honor):
        pins = sorted((r for r, _ in left if honor and r["pinned"]), key=lambda r: (r["rule"], newest(r)))
        queues = {k: sorted((r for r, _ in left if r["rule"] == k and not (honor and r["pinned"])), key=newest) for k in "abc"}
        chosen, used, skipped = pins[:limit], Counter(r["source"] for r in pins[:limit]), []
        while len(chosen) < limit:
            n = len(chosen)
            for k in "abc":
                while queues[k] and len(chosen) < limit:
                    r = queues[k].pop(0)
                    if used[r["source"]] >= per_source:
                        skipped.append(r["id"])
                        continue
                    used[r["source"]] += 1
                    chosen.append(r)
                    break
            if len(chosen) == n:
                break
        return [r["id"] for r in chosen], skipped

    chosen, skipped = choose(True)
    plain = choose(False)[0]
    for r, note in left:
        i = r["id"]
        if i in chosen:
            out[i] = ("selected", chosen.index(i) + 1, note)
        elif r["pinned"]:
            out[i] = ("held", None, monthly.PIN_CAP)
        else:
            out[i] = ("held", None, monthly.BUMPED if i in plain else monthly.DIVERSITY if i in skipped else monthly.SECTION_CAP)
    return out


@pytest.mark.parametrize("seed, n, pins", [(1, 60, 0.0), (2, 250, 0.02), (3, 250, 0.1), (4, 12, 0.0)])
def test_monthly_issue_equals_a_loop(spark, seed, n, pins):
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(0, len(xs)))]
    rows = []
    for i in range(n):
        rows.append({
            "id": i, "issue": pick("05", "06"), "source": pick("coop", "mafra", "x", "y", "z"), "kind": pick("media", "gonggo", "gonggo", None), "verdict": pick(monthly.APPLY, monthly.NOTICE, monthly.NOTICE, monthly.NOTICE, monthly.EXCLUDED, "보류"),
            "reason": pick(None, None, None, "노이즈 의심: x", "노이즈", "참가자 모집(B2C)"), "deadline": pick(None, None, "", "2026-01-01"), "deadline_cue": pick(None, "", "", "", "마감"), "council_match": pick(True, True, False, None), "council_only": pick(True, False, None),
            "noise": pick(None, False, False, True), "gate": pick(None, None, None, "보도 노이즈"), "posted": pick(None, "2026-05-01", "2026-05-02", "2026-05-03"), "council_score": pick(None, 0.5, 0.9), "pinned": bool(rng.random() < pins),
        })
    names = [c.split()[0] for c in ROW.split(", ")]
    got = monthly.monthly_issue(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ROW), "issue", 5, 2, 2).collect()
    want = {}
    for issue in ("05", "06"):
        want |= plain_issue([dict(r) for r in rows if r["issue"] == issue], 5, 2, 2)
    assert {r["id"]: (r["outcome"], r["position"], r["note"]) for r in got} == want and len(got) == n


def test_link_fates(spark):
    rng = np.random.default_rng(2)
    texts, pieces, want = [], [], set()
    for i in range(60):
        text, spans = "", []
        for _ in range(int(rng.integers(0, 25))):
            text += "말 " * int(rng.integers(0, 9))
            url = f"https://a.example/{int(rng.integers(0, 5))}"
            spans.append((url, len(text), len(text) + len(url)))
            text += url + " "
        cuts = sorted(set(rng.integers(0, len(text) + 1, 6).tolist()))
        own = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        texts.append((i, text or None))
        pieces += [(i, a, b) for a, b in own]
        for url, a, b in spans:
            whole = any(p <= a and b <= q for p, q in own)
            want.add((i, url, a, b, "whole" if whole else "split" if any(p < b and a < q for p, q in own) else "lost"))
    t = spark.createDataFrame(texts, "id long, text string")
    p = spark.createDataFrame(pieces, "id long, begin int, end int")
    for width in (7, 64, 4096):
        assert {tuple(r) for r in urls.link_fates(t, p, "id", "text", width).collect()} == want
    assert urls.link_fates(t.limit(0), p, "id", "text").count() == 0


def test_link_counts(spark):
    t = spark.createDataFrame([(1, "https://a/1 https://a/1 https://a/2"), (2, None), (3, "https://b")], "id long, text string")
    sent = spark.createDataFrame([(1, "https://a/1"), (1, "https://a/2"), (1, "https://a/"), (3, "https://b")], "id long, piece string")
    assert {tuple(r) for r in urls.link_counts(t, sent, "id", "text", "piece").collect()} == {(1, "https://a/1", 2, 1), (1, "https://a/", 0, 1)}


def test_working_days(spark):
    free = spark.createDataFrame([(dt.date(2026, 1, 1), dt.date(2026, 1, 2)), (dt.date(2025, 12, 20), dt.date(2026, 1, 1)), (dt.date(2026, 2, 28), dt.date(2027, 1, 1)), (dt.date(2020, 1, 1), dt.date(2020, 1, 2))], "begin date, end date")
    days = workdays.calendar(spark, "2025-12-29", "2026-03-31", free, off=(6, 7)).cache()
    plain, n = {}, 0
    day = dt.date(2025, 12, 29)
    while day <= dt.date(2026, 3, 31):
        worked = day.isoweekday() < 6 and not any(r["begin"] <= day <= r["end"] for r in free.collect())
        n += worked
        plain[day] = (worked, n)
        day += dt.timedelta(1)
    assert {r["day"]: (r["working"], r["number"]) for r in days.collect()} == plain
    rows = spark.createDataFrame([(1, dt.date(2026, 1, 3)), (2, dt.date(2026, 1, 30)), (3, dt.date(2030, 1, 1)), (4, None)], "id long, day date")
    worked = sorted(d for d, (w, _) in plain.items() if w)
    got = {r["id"]: r["due"] for r in workdays.ahead(rows, days, "day", 3, "due").collect()}
    later = lambda d: [x for x in worked if x > d][2]
    assert got == {1: later(dt.date(2026, 1, 3)), 2: later(dt.date(2026, 1, 30)), 3: None, 4: None}
    some = workdays.schedule(days, "2026-01-05", "2026-01-12").orderBy("no").collect()
    assert [(r["no"], r["day"]) for r in some] == [(i + 1, d) for i, d in enumerate(x for x in worked if dt.date(2026, 1, 5) <= x <= dt.date(2026, 1, 12))]
    assert workdays.calendar(spark, "2026-01-01", "2026-01-03", free.limit(0)).where("working").count() == 3
