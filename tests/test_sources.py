"""Scans of landed files written by the tests, chart extraction, fetch outcomes."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from gleaner.operators.items import community_items, feed_items, listing_items
from gleaner.sources.charts import chart_items, html_items
from gleaner.sources.files import parse_feed_files, read_feeds, read_listings, read_notes
from gleaner.sources.registry import classify_fetch, enabled_sources, fetch_result

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/">
<channel><title>Feed</title>
<item><title>First &amp; best</title><link>https://a.example/1</link>
  <description><![CDATA[<p>Hello   <b>world</b></p>]]></description>
  <pubDate>Mon, 02 Jun 2025 10:00:00 +0000</pubDate>
  <category>Tech</category><category></category><category>Scene</category></item>
<item><title>Dup</title><link>https://a.example/1</link><description>again</description></item>
<item><title>No link</title><description>skip me</description></item>
<item><link>https://a.example/2</link><description></description>
  <content:encoded><![CDATA[<div>Only content</div>]]></content:encoded></item>
</channel></rss>"""

ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>r/techno</title>
<entry><title>T1</title><link href="https://www.reddit.com/r/techno/comments/1/"/>
  <updated>2025-06-01T10:00:00+00:00</updated><author><name>u1</name></author>
  <content type="html">&lt;a href="https://news.example.com/x"&gt;[link]&lt;/a&gt;</content>
  <category term="techno"/><category term="Deep House"/></entry>
<entry><title>T2</title><link href="https://www.reddit.com/r/techno/comments/2/"/>
  <updated>2025-06-02T10:00:00+00:00</updated></entry>
</feed>"""


def test_rss_file_scan(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "rss")
    os.makedirs(d)
    open(os.path.join(d, "musicfeed.xml"), "w").write(RSS)
    open(os.path.join(d, "broken.xml"), "w").write("<rss><channel><item>")
    entries, bad = read_feeds(spark, d)
    assert [r.path.endswith("broken.xml") for r in bad.collect()] == [True]
    items = {r.source_url: r for r in feed_items(entries, "2024-01-01").collect()}
    assert set(items) == {"https://a.example/1", "https://a.example/2"}
    first = items["https://a.example/1"]
    assert (first.title, first.body, str(first.published_date)) == ("First & best", "Hello world", "2025-06-02")
    assert first.raw_tags == ["Tech", "Scene"] and first.source == "musicfeed"
    second = items["https://a.example/2"]
    assert second.title == "(no title)" and second.body == "Only content"


def test_one_broken_entry_of_ten(spark):
    """Nine rows and one quarantine row; tags inside CDATA and comments are no entries."""
    entry = "<item><title><![CDATA[T{i} </item> <item>]]></title><link>https://a.example/{i}</link><!-- <item></item> --></item>"
    texts = [entry.format(i=i) for i in range(10)]
    texts[3] = "<item><title>A & <b>B</title></item>"
    texts[7] = "<item><title>open</title><link>https://a.example/7</link>"       # ends where the next one starts
    feed = "<?xml version='1.0'?><rss><channel><title>F</title>" + "\n".join(texts) + "</channel></rss>"
    rows = [("a.xml", feed, "a", 0), ("empty.xml", "<rss><channel></channel></rss>", "e", 0), ("html.xml", "<html>no</html>", "h", 0),
            ("null.xml", None, "n", 0), ("cut.xml", "<rss><channel><item><title>x</ti", "c", 0)]
    entries, bad = parse_feed_files(spark.createDataFrame(rows, "path string, value string, feed string, feed_ord int"))
    got = {r.pos: (r.title, r.link) for r in entries.collect()}
    assert got == {i: (f"T{i} </item> <item>", f"https://a.example/{i}") for i in range(10) if i not in (3, 7)}
    assert sorted((r.path, r.error_kind, r.pos) for r in bad.collect() if r.path != "a.xml") == [
        ("cut.xml", "unparsable_entry", 0), ("html.xml", "unparsable_feed", None), ("null.xml", "unparsable_feed", None)]
    assert {r.pos: r.payload.strip() for r in bad.collect() if r.path == "a.xml"} == {3: texts[3], 7: texts[7]}


def test_long_entries_do_not_overflow(spark):
    body = "word <b>x</b> " * 40_000
    feed = f"<feed><entry><title>big</title><content><![CDATA[{body}]]></content></entry><entry><title>t</title></entry></feed>"
    entries, bad = parse_feed_files(spark.createDataFrame([("p", feed, "f", 0)], "path string, value string, feed string, feed_ord int"), "atom")
    assert entries.count() == 2 and bad.count() == 0
    assert abs(entries.where("pos = 0").selectExpr("length(content)").first()[0] - len(body)) <= 1


def test_atom_community_scan(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "atom")
    os.makedirs(d)
    open(os.path.join(d, "techno.xml"), "w").write(ATOM)
    entries, bad = read_feeds(spark, d, kind="atom")
    items = community_items(entries, "2024-01-01", top_n=1).collect()
    assert len(items) == 1
    it = items[0]
    assert it.title == "T1" and it.source == "Reddit/r/techno" and it.raw_tags == ["techno", "deep-house"]
    assert (it.wire.domain, it.wire.is_self, it.wire.permalink) == ("news.example.com", False, "/r/techno/comments/1/")


def test_listing_scan(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "listing")
    os.makedirs(d)
    doc = {"data": {"children": [
        {"data": {"permalink": "/r/aves/comments/9/", "title": "Pinned", "stickied": True, "score": 5}},
        {"data": {"permalink": "/r/aves/comments/1/", "title": "Post", "selftext": "", "score": 42,
                  "num_comments": 7, "upvote_ratio": 0.8, "created_utc": 1717200000.0,
                  "link_flair_text": "Gear Talk", "is_self": False, "domain": "i.redd.it"}}]}}
    open(os.path.join(d, "aves.json"), "w").write(json.dumps(doc))
    items = listing_items(read_listings(spark, d), "2024-01-01").collect()
    assert len(items) == 1
    it = items[0]
    assert it.body == "Posted in r/aves with 42 upvotes." and it.raw_tags == ["aves", "gear-talk"]
    assert str(it.published_date) == "2024-06-01" and it.wire.metrics_available


def test_read_notes_recursive(spark, tmpdir_path):
    os.makedirs(os.path.join(tmpdir_path, "Archived"))
    open(os.path.join(tmpdir_path, "Archived", "a.md"), "w").write("---\nstatus: archived\n---\nx")
    open(os.path.join(tmpdir_path, "skip.txt"), "w").write("no")
    rows = read_notes(spark, tmpdir_path).collect()
    assert len(rows) == 1 and rows[0].path.endswith("Archived/a.md")


def _page(url, html, ord_=0):
    return (url, "Techno", "techno", ord_, html)


CHART_PAGE = "url string, genre string, slug string, ord int, html string"


def _titles(spark, *pages, n=10):
    df = spark.createDataFrame([_page(f"https://c/{i}", h, i) for i, h in enumerate(pages)], CHART_PAGE)
    return sorted((r.source_url[-1], r.chart_pos, r.title) for r in html_items(df, "2024-01-01", n).collect())


def test_chart_rows_by_class_skip_the_menu_and_keep_every_artist(spark):
    menu = "<ul>" + "".join(f"<li><a>Menu {i}</a></li>" for i in range(12)) + "</ul>"
    rows = ('<li class="row bucket-item"><p class="artists"><a>Ann</a>, <a>Ben</a></p><b class="title">Up <i>mix</i></b></li>'
            '<li class="item bucket-item-x"><b class="title">no row</b></li>'
            '<li class="my-track"><span class="name">Plain</span></li>')
    assert _titles(spark, menu + rows) == [("0", 0, "Ann,Ben — Upmix"), ("0", 1, "Plain")]


def test_chart_row_divisions_and_lists_without_row_classes(spark):
    div = ('<div class="track-row"><div class="c"><span class="track-artists">Ann</span></div>'
           '<div class="track-title">One</div></div><div class="track-row"><div class="title">Two</div></div>')
    ol = ('<ul><li><b class="title">menu</b></li></ul><ol class="bucket-items"><li><b class="title">T</b>'
          '<b class="subtitle">S</b></li></ol>')
    assert _titles(spark, div, ol, "", "<ul><li>x</li></ul>", None) == [
        ("0", 0, "Ann — One"), ("0", 1, "Two"), ("1", 0, "T")]


def test_chart_json_skips_empty_lists_and_lists_of_other_things(spark):
    blob = json.dumps({"props": {"pageProps": {"chart": {"tracks": []}, "tracks": [{"id": 1}]}},
                       "items": [{"name": "Found"}]})
    page = _page("https://c/1", f'<script id="__NEXT_DATA__" type="application/json">{blob}</script>', 0)
    rows = chart_items(spark.createDataFrame([page], CHART_PAGE), "2024-01-01").collect()
    assert [(r.title, r.via) for r in rows] == [("Found", "json")]


def test_chart_html_then_json_fallback(spark):
    li = lambda a, t: f'<li class="track"><span class="artists">{a}</span><span class="title">{t}</span></li>'
    html1 = "<ol>" + li("A", "One") + li("a", "one") + li("", "Solo") + li("", "") + li("B", "Two") + "</ol>"
    blob = json.dumps({"props": {"pageProps": {"tracks": [
        {"name": "X", "artists": [{"name": "P"}, {"name": "Q"}]}, {"title": "Y", "artists": []}, {"artists": [{}]}]}}})
    html2 = f'<div><script id="__NEXT_DATA__" type="application/json">{blob}</script></div>'
    pages = spark.createDataFrame([_page("https://c/1", html1, 0), _page("https://c/2", html2, 1)],
                                  "url string, genre string, slug string, ord int, html string")
    rows = chart_items(pages, "2024-01-01", top_n=4).collect()
    by = sorted((r.source_url, r.chart_pos, r.title) for r in rows)
    # top 4 rows cut before dedup: 'a — one' repeats 'A — One' (case-insensitive), '' has neither
    assert by == [("https://c/1", 0, "A — One"), ("https://c/1", 2, "Solo"),
                  ("https://c/2", 0, "P, Q — X"), ("https://c/2", 1, "Y")]
    assert rows[0].body == "Track charting in Beatport Techno Top 100." and rows[0].raw_tags == ["techno", "chart", "beatport"]


def test_registry_and_fetch(spark):
    reg = spark.createDataFrame([("rss", "A", "", "https://a", True), ("rss", "B", "", "", True),
                                 ("rss", "C", "", "https://c", False), ("beatport", "D", "techno", "", True)],
                                "adapter string, name string, slug string, url string, enabled boolean")
    assert sorted(r.name for r in enabled_sources(reg).collect()) == ["A", "D"]
    resp = spark.createDataFrame([
        ("u1", 0, 429, ""), ("u1", 1, 200, "<feed/>"),
        ("u2", 0, 200, "  <!DOCTYPE html><html>challenge"), ("u2", 1, 200, "<html>"), ("u2", 2, 503, ""), ("u2", 3, 500, ""),
        ("u3", 0, 403, "denied"), ("u3", 1, 200, "<feed/>")], "url string, attempt int, status int, body string")
    out = {(r.url, r.attempt): r.outcome for r in classify_fetch(resp).collect()}
    assert out[("u1", 0)] == "retry" and out[("u1", 1)] == "ok" and out[("u2", 0)] == "retry"
    assert out[("u3", 0)] == "give_up"
    res = {r.url: (r.outcome, r.body) for r in fetch_result(resp).collect()}
    assert res == {"u1": ("ok", "<feed/>"), "u2": ("exhausted", None), "u3": ("give_up", None)}
