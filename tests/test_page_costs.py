"""What pages cost: items in portions, sites sent to the pages, plain tags read at once."""

from __future__ import annotations

from html.parser import HTMLParser

from bulletinlake.plans import page_queries
from bulletinlake.sources import boundaries, listings


def test_site_items_deal_no_pages_out_by_host(spark, sf):
    plan = page_queries.site_items(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_items_go_on_in_portions(spark, monkeypatch):
    page = "<ul>" + "".join(f"<li>접수기간 : <b>2026.01.{i % 28 + 1:02}</b></li>" for i in range(8000)) + "</ul>"
    assert [s.stop - s.start for s in boundaries._portions([page, "", None, page, "x"])] == [1, 2, 1, 1]
    assert list(boundaries._portions([])) == []
    pages = [(i, page if i % 3 == 0 else None if i % 3 == 1 else f"<li>{i}</li>") for i in range(12)]
    out = boundaries.dates_and_labels(spark.createDataFrame(pages, "id long, html string").coalesce(1), "id", "html")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    want = [(i, *x.values()) for i, p in pages for x in boundaries.dated_items(p)]
    assert sorted(map(tuple, out.collect())) == sorted(want)


class _Slow(boundaries._Tree):
    updatepos, parse_starttag, parse_endtag = HTMLParser.updatepos, HTMLParser.parse_starttag, HTMLParser.parse_endtag


def _outline(cls, page):
    parser = cls()
    parser.feed(page)
    parser.close()
    return [(n.tag, n.attrs, [k if isinstance(k, str) else k.tag for k in n.kids]) for n in (parser.root, *parser.root.walk())]


def test_plain_tags_are_read_at_once_as_the_parser_reads_them(monkeypatch):
    odd = ["<p a='1'b=2>x</p >", "<script>if (a<b) '</p>'</script>t", "<TD Class=x>y</TD>", '<a href="a&amp;b" href="c">z</a>', "<br/><p", "<a b='\"' c=\"'\">q</a><!-- <p> --></q>", "<title><b>t</b></title><textarea><i></textarea>"]
    for page in odd:
        assert _outline(boundaries._Tree, page) == _outline(_Slow, page)
    page = "<table><tr><td class=\"date\"><a onclick='go(1)' href=\"#\">1</a></td></tr></table>"
    want = _outline(_Slow, page)
    monkeypatch.setattr(HTMLParser, "check_for_whole_start_tag", None)
    assert _outline(boundaries._Tree, page) == want
    assert listings.items_of(page, "tr", "a", None, "td.date", None, None, None).__next__()[2] == "1"
