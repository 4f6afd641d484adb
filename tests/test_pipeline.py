"""Pipelines, sinks and streams on the smallest test tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from gleaner import standins as S
from gleaner.plans.backfill import backfill
from gleaner.plans.daily import FATES
from gleaner.plans.funnel import run_funnel
from gleaner.sinks.notes import write_notes
from gleaner.sinks.store import NoteStore
from gleaner.streaming.ingest import ingest_stream, read_stream_parquet

SF = "/root/testdata/sf0.001"


def test_daily_run_every_item_has_one_fate(spark):
    r = E._daily(spark, SF)
    s = r.summary.first().asDict()
    assert s["fetched"] == sum(s[f] for f in FATES)
    assert s["skipped_dedup"] == s["blank_url"] + s["already_stored"] + s["dup_in_run"] + s["rejected"]
    led = r.ledger
    assert led.count() == led.select("seq").distinct().count()  # one fate per item
    assert r.notes.count() == s["written"]
    assert r.quarantine.count() == s["failed"]


def test_note_table_append_is_idempotent(spark, tmpdir_path):
    notes = E._daily(spark, SF).notes.select("item_key", "source_url", "note_id", "markdown", F.col("date"))
    path = os.path.join(tmpdir_path, "notes")
    n1 = write_notes(notes, path)
    first = spark.read.parquet(path).count()
    write_notes(notes, path)
    assert spark.read.parquet(path).count() == first == notes.count()
    assert n1.count() == first
    by_url = os.path.join(tmpdir_path, "by-url")                  # without item_key: one note per URL
    write_notes(notes.drop("item_key"), by_url)
    assert spark.read.parquet(by_url).count() == notes.select("source_url").distinct().count() < first


def test_funnel_disabled_passes_everything_ungated(spark):
    items = E._listing(spark, SF)
    out = run_funnel(items, backends=S.gate_backends(), lens_summary=F.lit("x"), exemplar_block=F.lit(""),
                     enabled=False)
    assert {r.bucket for r in out.select("bucket").distinct().collect()} == {"ungated"}


def test_backfill_counts_and_keeps_author(spark):
    files = spark.createDataFrame([
        ("/v/Observation Inbox/a.md", "---\ntitle: T\nauthor: Ann\nentities: [X]\ndate: 2024-01-01\n---\n## Observation\nOne. Two.\n"),
        ("/v/Archived/b.md", "no frontmatter"),
        ("/v/Other/c.md", "---\ntitle: skip\n---\n"),
    ], "path string, value string")
    rows, counts = backfill(files, "2024-01-10")
    c = counts.first()
    assert (c.candidates, c.eligible, c.changed) == (2, 1, 1)
    m = rows.first().meta
    assert m.author == "Ann" and m.entities == ["X"] and m.claims == ["One.", "Two."]
    rows_over, _ = backfill(files, "2024-01-10", overwrite=True)
    assert rows_over.first().meta.author == ""


def _ingested(spark, sink):
    return NoteStore(spark, sink, key="source_url", partition_by="published_date").rows()


def test_stream_ingest_second_run_adds_nothing(spark, tmpdir_path):
    pages = S.table(spark, SF, "pages")
    sink = os.path.join(tmpdir_path, "sink")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    for _ in range(2):
        stream = read_stream_parquet(spark, f"{SF}/pages*.parquet", pages.schema)
        ingest_stream(stream, sink, ckpt, as_of=S.AS_OF, to_entries=S.pages_as_entries).awaitTermination()
    got = _ingested(spark, sink)
    assert got.count() == got.select("source_url").distinct().count() == pages.select("url").distinct().count()
    # a new checkpoint replays the same files under other batch names: the key index keeps the table unchanged
    stream = read_stream_parquet(spark, f"{SF}/pages*.parquet", pages.schema)
    ingest_stream(stream, sink, ckpt + "2", as_of=S.AS_OF, to_entries=S.pages_as_entries).awaitTermination()
    assert _ingested(spark, sink).count() == got.count()


def test_stream_multi_batch_equals_batch(spark, tmpdir_path):
    from gleaner.operators.dedup import dedup_first
    pages = S.table(spark, SF, "pages")
    landing = os.path.join(tmpdir_path, "landing")
    pages.repartition(4).write.parquet(landing)           # several files -> several micro-batches
    sink = os.path.join(tmpdir_path, "sink2")
    stream = read_stream_parquet(spark, landing, pages.schema, max_files=1)
    q = ingest_stream(stream, sink, os.path.join(tmpdir_path, "ck"), as_of=S.AS_OF, to_entries=S.pages_as_entries)
    q.awaitTermination()
    got = _ingested(spark, sink)
    assert got.select("batch_id").distinct().count() >= 2
    batch = dedup_first(E.feed_items(S.pages_as_entries(pages), S.AS_OF), ["source_url"], ["seq"])
    cols = ["source", "source_url", "title", "body"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_stream_batch_killed_before_its_commit_is_replayed_once(spark, tmpdir_path, monkeypatch):
    pages = S.table(spark, SF, "pages")
    sink, ckpt = os.path.join(tmpdir_path, "sink3"), os.path.join(tmpdir_path, "ck3")

    def run():
        stream = read_stream_parquet(spark, f"{SF}/pages*.parquet", pages.schema)
        ingest_stream(stream, sink, ckpt, as_of=S.AS_OF, to_entries=S.pages_as_entries).awaitTermination()

    def die(self, log, entry):
        raise RuntimeError("killed between write and commit")

    with monkeypatch.context() as m:
        m.setattr(NoteStore, "_commit", die)
        with pytest.raises(Exception, match="killed"):
            run()
    store = NoteStore(spark, sink, key="source_url", partition_by="published_date")
    assert store.rows() is None and os.listdir(os.path.join(sink, "rows"))   # written, but not read
    run()                                                                    # Spark replays the batch
    n = pages.select("url").distinct().count()
    assert store.rows().count() == n == store.rows().select("source_url").distinct().count()
    assert len(store.commits()) == 1
    assert store.vacuum() == 3 and store.rows().count() == n                 # rows, keys and filters of the dead attempt


def test_sinks_quarantine_and_partitioned_notes(spark, tmpdir_path):
    from gleaner.sinks.notes import write_quarantine
    bad = spark.createDataFrame([("u1", "enrich", "unparsable", "x")], "source_url string, stage string, error_kind string, payload string")
    qpath = os.path.join(tmpdir_path, "q")
    write_quarantine(bad, qpath)
    write_quarantine(bad, qpath)
    assert spark.read.parquet(qpath).count() == 2          # an audit log: every failure is kept
    notes = spark.createDataFrame([("u1", "2024-01-01", "m1"), ("u2", "2024-01-02", "m2")],
                                  "source_url string, date string, markdown string")
    npath = os.path.join(tmpdir_path, "n")
    write_notes(notes, npath)
    day = spark.read.parquet(npath).where(F.col("date") == "2024-01-02")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert [r.source_url for r in day.collect()] == ["u2"] and "PartitionFilters" in plan
