"""Boundary text, quotes, dates and lists against plain recursive and regex versions."""

from __future__ import annotations

import re

import numpy as np
import pytest

from bulletinlake.functions import quoting
from bulletinlake.sources import boundaries as b
from bulletinlake.sources import listings

MARKS = b.ROW + b.CELL + b.INNER


def plain_boundary_text(page):
    """By recursion, with marks collapsed by hand."""

    def walk(node, in_cell):
        if isinstance(node, str):
            return node
        if node.tag in b.SKIPPED:
            return ""
        cell = node.tag in b.CELL_TAGS
        out = "".join(walk(k, in_cell or cell) for k in node.kids)
        if node.tag in b.ROW_TAGS | b.CELL_TAGS | b.INNER_TAGS:
            out += b.INNER if in_cell else b.CELL if cell else b.ROW
        return out

    root = b.tree(page)
    nodes = list(root.walk())
    top = next((n for s in b.CONTAINERS for n in nodes if b.matches(n, s)), None) or next((n for n in nodes if n.tag == "body"), root)
    text = walk(top, False) if top.tag not in b.CELL_TAGS else "".join(walk(k, True) for k in top.kids)
    pieces, mark = [], ""
    for piece in re.split(f"([{MARKS}])", re.sub(r"\s+", " ", text.replace("\xa0", " "))):
        if piece in MARKS and piece:
            mark = min(mark + piece)
        elif piece.strip(" "):
            pieces.append((mark, piece))
            mark = ""
    out = ""
    for mark, piece in pieces:
        out = (out[:-1] if mark and out.endswith(" ") else out) + mark + (piece.lstrip(" ") if mark else piece)
    return out.strip(f" {MARKS}")


def random_page(rng, depth=0):
    if depth > 4 or rng.random() < 0.25:
        return str(rng.choice(["글 ", " 값", "2026.09.01", "\n", "&nbsp;", "a&amp;b", "접수기간 ", "<!-- 마감 : 1 -->", "<br>", "<script>마감</script>"]))
    tag = str(rng.choice(["table", "tr", "td", "th", "div", "p", "span", "li", "b", "section"]))
    inner = "".join(random_page(rng, depth + 1) for _ in range(int(rng.integers(0, 5))))
    return f"<{tag}>{inner}" + (f"</{tag}>" if rng.random() < 0.9 else "") + ("</p>" if rng.random() < 0.1 else "")


def test_boundary_text_equals_a_recursive_walk(spark, sf):
    rng = np.random.default_rng(3)
    pages = ["".join(random_page(rng) for _ in range(5)) for _ in range(400)]
    pages += [None, "", "text", '<td class="content">x<p>y</p></td>', '<div id="contents"><div>a</div></div><div class="contents">b</div>', "<table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table>"]
    pages += [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    for page in pages:
        assert b.boundary_text_of(page) == plain_boundary_text(page), page
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert b.boundary_text_of(deep) == "x" and b.date_and_label_of(b.tree("<li>" * 300 + "2026.01.02")) == ("2026.01.02", "")
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id long, html string")
    got = {(r["id"], r["row"], r["cell"]): r["text"] for r in b.boundary_rows(rows, "id", "html").collect()}
    want = {(i, r, c): quoting.flat(cell) for i, p in enumerate(pages) for r, row in enumerate(plain_boundary_text(p).split(b.ROW)) for c, cell in enumerate(row.split(b.CELL))}
    assert got == want


def test_nested_tables_stay_in_their_cell():
    page = "<table><tr><th>사업규모</th><td><table><tr><td>1억</td><td>2억</td></tr></table>원</td></tr><tr><td>끝</td></tr></table>"
    assert b.boundary_text_of(page) == f"사업규모{b.CELL}1억{b.INNER}2억{b.INNER}원{b.ROW}끝"


def plain_quotes(text):
    """A regex for each label, each rule in turn."""
    gap = f"[\\s{MARKS}]"
    every = {**{w: "" for w in quoting.FOREIGN}}
    out = dict.fromkeys(quoting.LABELS)
    for key, labels in quoting.LABELS.items():
        foreign = {*every, *(w for k, ls in quoting.LABELS.items() if k != key for w, _ in ls)}
        for label, strict in labels:
            at = None
            if m := re.search(rf"[{re.escape(quoting.BULLETS + quoting.OPENERS)}]\s*\(?\s*({label})", text):
                at = m.start(1)
            elif m := re.search(rf"{label}\s*[:：]", text):
                at = m.start()
            elif m := re.search(rf"{label}{gap}+({label})", text):
                at = m.start(1)
            elif not strict and label in text:
                at = text.index(label)
            if at is None:
                continue
            begin = at + len(label)
            limit = end = min(len(text), at + quoting.LONGEST)
            value, cells = "", 0
            for i in range(begin, limit):
                cells += text[i] == b.CELL
                if text[i] in quoting.BULLETS + b.ROW or (text[i] == b.CELL and (value or cells == 2)):
                    end = i
                    break
                value += "" if text[i] in MARKS + quoting.EMPTY or text[i].isspace() else text[i]
            if end == limit < len(text) and text[end] in quoting.DATE_CHARS:
                tail = re.search(r"[0-9.\-/년월일~∼〜 ]*$", text[begin:end])
                end = begin + tail.start() if tail.start() else end
            starts = []
            for word in foreign:
                if word in label or label in word:
                    continue
                for m in re.finditer(word, text[begin:end]):
                    before = text[begin : begin + m.start()]
                    kept = before.rstrip(quoting.DECORATION)
                    if re.sub(rf"[\s{MARKS}{re.escape(quoting.DECORATION)}]", "", before) and (not kept or kept[-1] in MARKS + quoting.BULLETS):
                        starts.append(begin + m.start())
            end = min([end, *starts])
            if m := quoting.REPEATED.search(text[begin:end]):
                end = begin + m.start()
            if m := re.search(r"<\s*/?\s*[A-Za-z]", text[begin:end]):
                end = begin + m.start()
            quote = " ".join(re.split(rf"{gap}+", text[at:end])).strip()
            if len(quote) > len(label) + 2:
                out[key] = quote
                break
    return out


def test_quotes_equal_a_regex_for_each_label():
    rng = np.random.default_rng(8)
    words = [w for labels in quoting.LABELS.values() for w, _ in labels] + list(quoting.FOREIGN)
    other = ["2026.09.01", "~", "09.30", "까지", "□", "ㅁ", "(", ")", ":", "예산 소진", "1억원", "제한", "<b>", "값 값", b.ROW, b.CELL, b.INNER, b.CELL, "가나다라" * 20, " - ", "2026. 9. 1."]
    for _ in range(4000):
        n = int(rng.integers(1, 30))
        parts = [str(rng.choice(words) if rng.random() < 0.35 else rng.choice(other)) for _ in range(n)]
        text = "".join(p + (" " if rng.random() < 0.7 else "") for p in parts).strip()
        assert quoting.quotes_of(text) == plain_quotes(text), text


@pytest.mark.parametrize(
    "text, want",
    [
        (f"접수기간{b.ROW}2026.09.01", None),
        (f"접수기간{b.CELL}2026.09.01 ~ 09.30{b.CELL}교육기간", "접수기간 2026.09.01 ~ 09.30"),
        (f"접수기간 2026.09.01{b.INNER}(교육기간) 2026.10.01", "접수기간 2026.09.01 ("),
        ("접수기간 (제출서류 완비 기준) 2026.09.01", "접수기간 (제출서류 완비 기준) 2026.09.01"),
        ("접수기간 " + "가" * 288 + " 2026.09.30", "접수기간 " + "가" * 288),
        ("신청기간 신청기간 2026.09.01 ~", "신청기간 2026.09.01 ~"),
        ("접수기간 2026.09.01 &lt;b", "접수기간 2026.09.01 &lt;b"),
        ("오늘 마감 합니다", None),
        (None, None),
    ],
)
def test_deadline_quotes(text, want):
    assert quoting.quotes_of(text)["quote_deadline"] == want


def plain_date(top):
    found = {"r": [], "s": []}
    for node in top.walk():
        text = node.text()
        clean = b.NOTE.sub(" ", text)
        if b.RANGE_DATE.search(clean):
            found["r"].append(text)
        elif b.SINGLE_DATE.search(clean):
            found["s"].append(text)
    pool = found["r"] or found["s"]
    text = b.NOTE.sub(" ", min(pool, key=len) if pool else top.text())
    text = " ".join(text.split()) if pool else text
    m = b.RANGE_DATE.search(text) or b.SINGLE_DATE.search(text)
    return (m[0].strip() if m else "", text[: m.start()].strip(b.LABEL_EDGES) if m and pool else "")


def test_date_of_the_smallest_element():
    rng = np.random.default_rng(5)
    words = ["2026.09.01", "2026-9-3", "~", " ~ ", "(화)", "접수기간", "게시일 :", "2026년 9월 1일", "부터", "제목", " - ", "(1차)"]

    def page(depth=0):
        inner = "".join(str(rng.choice(words)) if depth > 3 or rng.random() < 0.5 else page(depth + 1) for _ in range(int(rng.integers(1, 4))))
        return f"<span>{inner}</span>"

    for _ in range(1500):
        top = b.tree(f"<li>{page()}{page()}</li>").kids[0]
        assert b.date_and_label_of(top) == plain_date(top)


def test_list_items(spark):
    page = '<ul><li class="row"><a href="view?no=7">하나</a> <em>2026.01.02</em><b>기관</b></li><li class="row"><a href="javascript:x" onclick="go(8)">둘</a></li><li class="row"><a href="/z"></a></li><li><a href="q">남</a></li></ul>'
    config = ("li.row", "a", None, "em", "b", r"(?:no=|go\()(\d+)", "https://h.example/list/")
    assert list(listings.items_of(page, *config)) == [(0, "7", "하나", "https://h.example/list/view?no=7", "2026.01.02", None, "기관"), (1, "8", "둘", "https://h.example/list/", None, None, None)]
    assert list(listings.items_of(None, *config)) == [] and list(listings.items_of(page, None, *config[1:])) == []
    listings.register(spark)
    got = spark.sql("SELECT id, i.source_id FROM VALUES (1, '<p class=\"x\"><a href=\"a5\">t</a></p>'), (2, NULL) AS p(id, html), LATERAL list_items(html, 'p.x', 'a', NULL, NULL, NULL, 'a(\\\\d)', 'https://h/') i").collect()
    assert [tuple(r) for r in got] == [(1, "5")]
