"""Deliberate deviations from the reference behaviour, each checked."""

from __future__ import annotations

import os
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import functions as F

from gleaner.operators.infer import FunctionBackend
from gleaner.operators.items import listing_items
from gleaner.operators.notes import note_table
from gleaner.plans.daily import daily_run
from gleaner.sources.charts import html_items

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENSES = [("/v/lenses/01.md", "---\nname: Scene\n---\nHow a scene works.")]
GOOD = ('{"observation": "o", "tags": ["t"], "interest_level": 4, "lenses": ["scene"], '
        '"questions": {"Scene": ["q?"]}, "expanded_context": "c."}')


def _counter():
    d = tempfile.mkdtemp(prefix="gate-calls-")

    def gate(system, user, _d=d):
        import os as _os
        import uuid
        open(_os.path.join(_d, uuid.uuid4().hex), "w").close()
        return '{"reaction_worthiness": 5}'
    return d, gate


def _charts(spark):
    html = '<ol><li class="track"><span class="artist">A</span><span class="title">One</span></li>' \
           '<li class="track"><span class="artist">B</span><span class="title">Two</span></li></ol>'
    pages = spark.createDataFrame([("https://c/top", "Techno", "techno", 0, html)],
                                  "url string, genre string, slug string, ord int, html string")
    return html_items(pages, "2024-01-01", 10)


def _listing(spark):
    rows = [("x", "/r/x/comments/1/", "known post", "", 10, 5, 0.9, 1.7e9, "", False, True, False, "self.x", 0),
            ("x", "/r/x/comments/2/", "new post", "", 10, 5, 0.9, 1.7e9, "", False, True, False, "self.x", 1)]
    ch = spark.createDataFrame(rows, "community string, permalink string, title string, selftext string, score long, "
                                     "num_comments long, upvote_ratio double, created_utc double, link_flair_text string, "
                                     "stickied boolean, is_self boolean, is_video boolean, domain string, rank long")
    return listing_items(ch, "2024-01-01")


def _run(spark, sources, known=None, dedup_keys=("item_key",), gate=None, **more):
    lens = spark.createDataFrame(LENSES, "path string, value string")
    return daily_run(sources, known=known, lens_files=lens,
                     gate_backends=[FunctionBackend("g", gate or (lambda s, u: '{"reaction_worthiness": 5}'))],
                     enrich_backends=[FunctionBackend("e", lambda s, u: GOOD)], as_of="2024-01-10",
                     dedup_keys=dedup_keys, **more)


def test_t1_chart_tracks_survive(spark):
    by_url = _run(spark, [_charts(spark)], dedup_keys=("source_url",)).summary.first()
    assert (by_url.dup_in_run, by_url.written) == (1, 1)     # one per chart URL
    default = _run(spark, [_charts(spark)]).summary.first()
    assert (default.dup_in_run, default.written) == (0, 2)


def test_t1_second_day_writes_only_new_tracks_of_a_stored_chart(spark):
    import gleaner.sinks.notes as N
    root = tempfile.mkdtemp(prefix="notes-")
    out, bad = os.path.join(root, "notes"), os.path.join(root, "bad")
    charts = _charts(spark)
    first = _run(spark, [charts.where("title like 'A%'")], out_path=out, quarantine_path=bad)
    assert first.summary.first().written == 1
    known = N.stored_keys(spark, out, "item_key")
    again = _run(spark, [charts, _listing(spark)], known=known, out_path=out)
    s = again.summary.first()
    assert (s.already_stored, s.written, s.fetched) == (1, 3, 4)
    assert spark.read.parquet(out).count() == 4 and again.notes.count() == 3
    replay = _run(spark, [charts], out_path=out).summary.first()   # no check up front: the sink finds both
    assert (replay.already_stored, replay.written) == (2, 0)
    assert spark.read.parquet(out).count() == 4 and spark.read.parquet(bad).count() == 0


def test_items_with_equal_positions_keep_one_fate_each(spark):
    s = _run(spark, [_listing(spark), _listing(spark).withColumn("source_url", F.concat("source_url", F.lit("b"))),
                     _charts(spark), _charts(spark)])
    fates = {r.fate: r["count"] for r in s.ledger.groupBy("fate").count().collect()}
    assert fates == {"written": 6, "dup_in_run": 2}
    assert s.ledger.select("item_no").distinct().count() == 8


def test_item_without_a_date_gets_the_day_of_the_run(spark):
    undated = _listing(spark).withColumn("published_date", F.lit(None).cast("date"))
    notes = _run(spark, [undated]).notes.collect()
    assert {n.date for n in notes} == {"2024-01-10"} and all("\ndate: 2024-01-10\n" in n.markdown for n in notes)


def test_last_of_a_repeated_reply_key_counts(spark):
    from gleaner.functions.replies import clamp_int, parse_reply
    got = spark.createDataFrame([('{"n": 1, "n": 4}',)], "r string").select(parse_reply("r").alias("v")).select(
        clamp_int(F.col("v"), "n", 1, 5, 1).alias("n")).first()
    assert got.n == 4


def test_t3_stored_urls_never_reach_the_gate(spark):
    d, gate = _counter()
    known = spark.createDataFrame([("https://www.reddit.com/r/x/comments/1/",)], "source_url string")
    s = _run(spark, [_listing(spark)], known=known, gate=gate).summary.first()
    assert s.already_stored == 1 and len(os.listdir(d)) == 1


def test_t17_author_is_carried(spark):
    from gleaner.operators.items import feed_items
    e = spark.createDataFrame([("f", 0, 0, "https://a/1", "T", "<p>b</p>", None, None, None, "Ann", ["x"])],
                              "feed string, feed_ord int, pos int, link string, title string, summary string, "
                              "content string, published string, updated string, author string, categories array<string>")
    notes = _run(spark, [feed_items(e, "2024-01-01")]).notes.collect()
    assert notes[0].meta.author == "Ann" and 'author: "Ann"' in notes[0].markdown


def test_t29_id_is_accepted_as_note_id(spark):
    files = spark.createDataFrame([("/v/Observation Inbox/a.md", "---\nid: 2024-a-1\nstatus: inbox\n---\n")],
                                  "path string, value string")
    assert note_table(files).first().note_id == "2024-a-1"
    assert note_table(files.withColumn("value", F.lit("---\nnote_id: n2\nid: x\n---\n"))).first().note_id == "n2"
