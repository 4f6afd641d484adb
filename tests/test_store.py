"""The note store: commits by batch, key index, copy-on-write of partitions."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from gleaner.operators.dedup import known_keys, skip_known
from gleaner.plans.backfill import backfill_merge
from gleaner.session import stage
from gleaner.sinks.notes import write_notes
from gleaner.sinks.store import CommitConflict, NoteStore

SCHEMA = "item_key string, date string, folder string, title string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def store_at(spark, tmp, **kw):
    return NoteStore(spark, os.path.join(tmp, "store"), **{"buckets": 4, **kw})


def keys(df):
    return sorted(r[0] for r in df.collect())


def test_append_by_batch_is_idempotent(spark, tmpdir_path):
    s = store_at(spark, tmpdir_path)
    assert s.rows() is None and keys(s.stored_among(rows(spark, ("a", "d", "f", "t")))) == []
    first = rows(spark, ("a", "2024-01-01", "Inbox", "x"), ("b", "2024-01-02", "Inbox", "y"), ("a", "2024-01-01", "Inbox", "x"))
    assert keys(s.append(first, "day1").select("item_key")) == ["a", "b"]
    assert s.append(first, "day1") is None                                # the batch is known by its name
    assert s.append(first, "day2").count() == 0                           # its rows by their keys
    again = rows(spark, ("c", "2024-01-02", "Inbox", "z"), ("b", "2024-01-05", "Inbox", "new"), (None, "2024-01-02", "Inbox", "no key"))
    s.append(again, "day3")
    got = sorted((r.item_key or "", r.date, r.title) for r in s.rows().collect())
    assert got == [("", "2024-01-02", "no key"), ("a", "2024-01-01", "x"), ("b", "2024-01-02", "y"), ("c", "2024-01-02", "z")]
    assert s.committed("day2") and not s.committed("day4")


def test_index_equals_the_plain_anti_join(spark, tmpdir_path):
    s = store_at(spark, tmpdir_path, buckets=16, words=8)                 # filters far too small: more reads, same answer
    known = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("item_key"), F.lit("2024").alias("date"),
                                           F.when(F.col("id") % 2 == 0, "Inbox").otherwise("Archived").alias("folder"))
    s.append(known.where("item_key < '2'"), "one")
    s.append(known.where("item_key >= '2'"), "two")
    items = spark.range(0, 4000).select(F.col("id").cast("string").alias("item_key"))
    for scope in (None, "Inbox"):
        want = keys(skip_known(items, known, "item_key", scope))
        assert keys(s.skip_known(items, scope)) == want
    s.compact_index()
    assert len(s._index(s.commits())) == 1 and keys(s.skip_known(items)) == keys(skip_known(items, known, "item_key"))
    assert known_keys(known, "item_key", "Archived").count() == 500


def test_look_up_reads_only_the_buckets_it_needs(spark, tmpdir_path):
    s = store_at(spark, tmpdir_path, buckets=64)
    known = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("item_key"), F.lit("2024").alias("date"))
    s.append(known, "load")
    items = spark.createDataFrame([("k5",), ("k77",), ("new1",), ("new2",)], "item_key string")
    found = s.stored_among(items)
    assert keys(found) == ["k5", "k77"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "PartitionFilters" in x and "bucket#" in x]
    own = {r[0] for r in items.where("item_key like 'k%'").select(F.pmod(F.xxhash64("item_key"), F.lit(64))).collect()}
    assert len(own) == 2 and any(re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \((%s)\)" % "|".join(
        f"{a},{b}" for a in own for b in own), x) for x in scans)            # the filters exclude the new items
    files = s._read_index("keys", "key string, folder string, bucket int", s._index(s.commits()), sorted(own)).select(
        F.input_file_name().alias("f")).distinct()
    assert {re.search(r"bucket=(\d+)", r.f)[1] for r in files.collect()} == {str(b) for b in own}


def test_of_two_writers_one_wins(spark, tmpdir_path):
    s = store_at(spark, tmpdir_path)
    s.append(rows(spark, ("a", "2024-01-01", "Inbox", "x")), "one")
    log = s.commits()
    s.append(rows(spark, ("b", "2024-01-01", "Inbox", "x")), "two")
    with pytest.raises(CommitConflict):
        s._commit(log, {"batch": "late", "added": [], "dropped": [], "index": None, "schema": log[-1]["schema"]})
    assert [c["batch"] for c in s.commits()] == ["one", "two"]


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_backfill_merge_rewrites_only_changed_partitions(spark, tmpdir_path):
    old = "---\ntitle: T\ndate: 2024-01-01\nsource: S\nclaims:\n  - stale\n  - older\nmine: kept\n---\n## Observation\nOne. Two.\n"
    notes = spark.createDataFrame([
        ("/v/Observation Inbox/a.md", old, "2024-01"),
        ("/v/Observation Inbox/b.md", "no frontmatter", "2024-01"),
        ("/v/Reaction Queue/c.md", old, "2024-02"),                       # a folder that backfill leaves alone
        ("/v/Archived/d.md", old, "a=b/c"),                               # a value that paths escape
    ], "path string, value string, month string")
    s = store_at(spark, tmpdir_path, key="path", partition_by="month")
    s.append(notes, "load")
    before = _files(s.path)
    february = [f for f in s.partitions() if f.endswith("month=2024-02")]
    assert backfill_merge(s, "2024-01-10") == 2
    got = {r.path: r.value for r in s.rows().collect()}
    assert len(got) == 4 and got["/v/Reaction Queue/c.md"] == old and got["/v/Observation Inbox/b.md"] == "no frontmatter"
    new = got["/v/Observation Inbox/a.md"]
    assert new.endswith("\n---\n## Observation\nOne. Two.\n") and "mine: kept\n" in new and "stale" not in new
    assert 'claims: ["One.", "Two."]\n' in new and "note_id: a\n" in new and new.count("title:") == 1
    assert [f for f in s.partitions() if f.endswith("month=2024-02")] == february
    after = _files(s.path)
    assert all(after[f] == t for f, t in before.items())                  # nothing is changed in place
    assert {r.month for r in s.rows().collect()} == {"2024-01", "2024-02", "a=b/c"}
    # a second run changes nothing and commits nothing; the keys are still known
    n = len(s.commits())
    assert backfill_merge(s, "2024-01-10", batch="again") == 0 and len(s.commits()) == n
    assert s.skip_known(notes.select("path")).count() == 0
    assert s.vacuum() >= 2 and s.rows().count() == 4


def test_write_notes_to_a_table_without_item_key(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "old")
    spark.createDataFrame([("u1", "2024-01-01")], "source_url string, date string").write.partitionBy("date").parquet(path)
    new = spark.createDataFrame([("u1", "u1", "2024-01-02"), ("u2", "u2", "2024-01-02")], "item_key string, source_url string, date string")
    assert [r.source_url for r in write_notes(new, path).collect()] == ["u2"]


def test_backfill_merge_works_out_the_metadata_in_one_pass(spark, tmpdir_path, monkeypatch):
    from gleaner.plans import backfill as B

    note = "---\ntitle: T{i}\ndate: 2024-01-0{i}\nsource: s\nsource_url: u{i}\n---\n\n## Observation\n\nOne. Two!\n"
    files = [(f"/v/Observation Inbox/{i}.md", note.replace("{i}", str(i)), f"2024-0{i}") for i in (1, 2, 3)]
    s = NoteStore(spark, tmpdir_path + "/one-pass", key="path", partition_by="month")
    s.append(spark.createDataFrame(files, "path string, value string, month string"), "load")
    nodes = []

    def names(plan):
        nodes.append(plan.nodeName())
        for i in range(plan.children().size()):
            names(plan.children().apply(i))

    def staged(df, how="table"):
        names(df._jdf.queryExecution().optimizedPlan())
        return stage(df, how)

    monkeypatch.setattr(B, "stage", staged)
    assert backfill_merge(s, "2024-01-10") == 3
    # no join of the table with itself; the only filter is the one on path, folder and frontmatter
    assert nodes.count("Filter") == 1 and not any("Join" in n for n in nodes), nodes
    assert s.rows().where("value like '%claims: [\"One.\", \"Two!\"]%'").count() == 3
