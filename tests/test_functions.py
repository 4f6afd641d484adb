"""Column functions: text, replies, lenses, metadata, frontmatter, render."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.functions import frontmatter as FM
from gleaner.functions import replies as R
from gleaner.functions import text as T
from gleaner.functions.dates import item_date, time_sensitivity
from gleaner.functions.links import community_tags, link_meta
from gleaner.functions.metadata import build_metadata, derive_relevance


def one(spark, col, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("o")).first().o


def test_strip_html_unicode_whitespace(spark):
    assert one(spark, T.strip_html("v", 9), "<p>a  b</p>\n\n<b>cde</b> fgh") == "a b cde f"


def test_slugify_and_note_id(spark):
    assert one(spark, T.slugify("v"), "  Resident Advisor!! ") == "resident-advisor"
    assert one(spark, T.slugify("v"), "!!!") == "src"
    row = spark.createDataFrame([("2024-05-01", "Music Ally News", "https://x/y")], "d string, s string, u string")
    nid = row.select(T.note_id("d", "s", "u").alias("n")).first().n
    import hashlib
    assert nid == "2024-05-01-music-al-" + hashlib.md5(b"https://x/y").hexdigest()[:4]


def test_yaml_quote(spark):
    assert one(spark, T.yaml_quote("v"), "") == '""'
    assert one(spark, T.yaml_quote("v"), ' a "b"\r\nc\\ ') == '"a \\"b\\" c\\\\"'


def test_sentences_and_first_sentence(spark):
    assert one(spark, T.sentences("v"), "One. Two!  Three?\nFour") == ["One.", "Two!", "Three?", "Four"]
    assert one(spark, T.first_sentence("v"), "# Head\n## Sub\n  Body starts here. Next one.") == "Body starts here."


def test_clean_list(spark):
    assert one(spark, T.clean_list("v"), [" a ", "", "  ", "b"], "v array<string>") == ["a", "b"]
    assert one(spark, T.clean_list("v"), None, "v array<string>") == []


def test_observation_text(spark):
    body = "\n## Observation\n\nThe text.\n\n**Source:** [s](u)\n\n## Questions\n### L\n- q"
    assert one(spark, T.observation_text("v"), body) == "The text."


def test_url_segment(spark):
    assert one(spark, T.url_segment("v"), "https://www.reddit.com/r/techno/comments/1/") == "techno"
    assert one(spark, T.url_segment("v"), "https://www.reddit.com/r/techno") == ""


def test_link_meta(spark):
    html = ('<a href="https://www.reddit.com/r/x/comments/1/">[comments]</a>'
            '<a href="https://news.example.com:8080/a">[link]</a>')
    m = one(spark, link_meta("v"), html)
    assert (m.is_self, m.domain) == (False, "news.example.com:8080")
    m = one(spark, link_meta("v"), '<a href="https://old.reddit.com/r/x/">x</a>')
    assert (m.is_self, m.domain) == (True, "")
    m = one(spark, link_meta("v"), '<a href="/relative">x</a>')
    assert (m.is_self, m.domain) == (None, "")


def test_community_tags(spark):
    df = spark.createDataFrame([("techno", ["Techno", "", "Deep House", "x"])], "s string, c array<string>")
    assert df.select(community_tags("s", "c").alias("t")).first().t == ["techno", "deep-house"]


def test_item_date(spark):
    df = spark.createDataFrame([("Mon, 02 Jun 2025 23:30:00 -0200", None), (None, "2025-06-01T10:00:00Z"),
                                ("garbage", None)], "p string, u string")
    got = [r.d for r in df.select(item_date("p", "u", "2024-01-01").alias("d")).collect()]
    assert got == [dt.date(2025, 6, 3), dt.date(2025, 6, 1), dt.date(2024, 1, 1)]


def test_time_sensitivity_explicit_as_of(spark):
    df = spark.createDataFrame([("2026-07-28",), ("2026-05-01",), ("2024-01-01",), ("bad",), ("2026-09-01",)], "d string")
    got = [r.t for r in df.select(time_sensitivity("d", "2026-08-10").alias("t")).collect()]
    assert got == ["high", "medium", "low", "unknown", "high"]


def test_parse_reply_and_clamp(spark):
    cases = {'```json\n{"k": 7}\n```': 5, '{"k": "2"}': 2, '{"k": "2.5"}': None, '{"k": true}': 1,
             '{"k": null}': None, '{"j": 1}': 1, "[1]": None, "broken": None, '{"k": -3}': 1}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r.v: r.o for r in df.select("v", R.clamp_int(R.parse_reply("v"), "k", 1, 5, 1).alias("o")).collect()}
    assert got == cases


@pytest.mark.parametrize("lenses,names,matched", [
    ('["tide tables"]', ["tide tables"], ["Tide Tables"]),
    ('[{"title": "MAP ROOM"}, "Map Room"]', ["MAP ROOM", "Map Room"], ["Map Room"]),
    ('[{"colour": 3}, false]', [None, None], ["Fallback"]),
    ('[{"name": "unheard of"}, {"lens": "tide tables"}]', ["unheard of", "tide tables"], ["Tide Tables"]),
])
def test_lens_names_and_match(spark, lenses, names, matched):
    from gleaner.operators.lenses import match_lenses
    known = F.create_map(*[F.lit(x) for n in ("Tide Tables", "Map Room") for x in (n.lower(), n)])
    got = R.lens_names(R.parse_reply("v"))
    row = spark.createDataFrame([('{"lenses": %s}' % lenses,)], "v string").select(
        got.alias("names"), match_lenses(got, known, F.lit("Fallback")).alias("matched")).first()
    assert (row.names, row.matched) == (names, matched)


def test_scope_questions(spark):
    df = spark.createDataFrame([('{"questions": {"A": ["q1"], "B": [], "C": ["x"]}}',)], "v string")
    q = df.select(R.scope_questions(R.questions_map(R.parse_reply("v")), F.array(F.lit("A"), F.lit("B"))).alias("q")).first().q
    assert q == {"A": ["q1"]}


def test_derive_relevance_alias_and_substring(spark):
    df = spark.createDataFrame([(["bandcamp", "music-business"],), (["techno"],), (["nothing"],)], "t array<string>")
    got = [r.r for r in df.select(derive_relevance("t").alias("r")).collect()]
    assert got[0] == ["platform_economics"]
    assert got[1] == ["technology"]          # substring: 'tech' in 'techno' (kept as the reference does)
    assert got[2] == ["music_production"]    # default
    tok = df.select(derive_relevance("t", mode="token").alias("r")).collect()[1].r
    assert tok == ["music_production"]


@pytest.mark.parametrize("day,urgency", [("2031-02-27", "high"), ("2030-01-05", "low"), (None, "unknown")])
def test_build_metadata(spark, day, urgency):
    cols = {"t": "Vinyl plant reopens", "s": "Pressing Weekly", "u": "https://plant.invalid/42", "d": day,
            "o": "A pressing plant reopens in spring.", "c": "Waiting times had grown past a year."}
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).withColumn(
        "tags", F.array(F.lit("vinyl")))
    m = df.select(build_metadata(as_of="2031-03-01", title="t", source="s", source_url="u", published_date="d",
                                 raw_tags="tags", p_observation="o", p_expanded_context="c",
                                 p_tags="tags").alias("m")).first().m
    assert (m.publication, m.time_sensitivity) == (cols["s"], urgency)
    assert (m.publication_date or None) == day
    assert any("pressing plant" in c or "Waiting times" in c for c in m.claims)


def test_frontmatter_last_key_wins_and_colons(spark):
    text = '---\ntitle: "A: b"\nstatus: inbox\nstatus: Reacted\nno colon line\ntags: [a, "b", ]\n---\nbody ---'
    df = spark.createDataFrame([(text,)], "v string")
    r = df.select(FM.frontmatter_map("v").alias("m"), FM.note_body("v").alias("b")).first()
    assert r.m["title"] == "A: b" and r.m["status"] == "Reacted" and "no colon line" not in r.m
    assert r.b == "\nbody ---"
    assert df.select(FM.inline_list(FM.fm_get(FM.frontmatter_map("v"), "tags")).alias("t")).first().t == ["a", "b"]
    assert one(spark, FM.frontmatter_map("v"), "no frontmatter") == {}


@pytest.mark.parametrize("content,name,first", [
    ("---\nname: night-shift\n---\nWho is awake when? Ask them.", "night-shift",
     "Who is awake when?"),
    ("---\ntitle: x\n---\n# Head\nNo name here!", "", "No name here!"),
])
def test_lens_file_parse(spark, content, name, first):
    from gleaner.operators.lenses import lens_rows
    df = spark.createDataFrame([("/l/a.md", content)], "path string, value string")
    r = lens_rows(df).first()
    assert (r.name, r.first_sentence) == (name, first)
