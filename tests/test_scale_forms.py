"""Forms built for large inputs: exact ranks, alias and lens joins, distinct model
calls, budget and deep dive without hot keys, markup scanner, runs that fail open."""

from __future__ import annotations

import os
import random
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as E
from gleaner import standins as S
from gleaner.functions.markup import Selector, elements, first_element
from gleaner.functions.metadata import RELEVANCE_TAXONOMY, TAXONOMY_ALIASES, derive_relevance
from gleaner.operators.aliases import alias_candidates, alias_hits, alias_values
from gleaner.operators.gate import deep_dive, survivor_budget
from gleaner.operators.infer import FunctionBackend, infer_distinct
from gleaner.operators.lenses import lens_table, match_lenses_table
from gleaner.operators.ranks import exact_ranks
from gleaner.plans.daily import daily_run
from gleaner.session import stage
from gleaner.sinks.store import NoteStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SF = "/root/testdata/sf0.001"


# ---- ranks

def test_exact_ranks_one_group_with_all_rows(spark):
    rng = random.Random(1)
    rows = [("all" if i % 10 else None, rng.choice([1.0, 2.0, 3.0]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, s double, seq long").repartition(6)
    got = {r.seq: r["rank"] for r in exact_ranks(df, [F.col("g")], [F.desc("s"), F.col("seq")], partitions=9).collect()}
    want = {}
    for g in ("all", None):
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[r[2]] = i + 1
    assert got == want
    whole = exact_ranks(df, [], [F.col("seq")], "nr", partitions=5)
    assert [r.nr for r in whole.orderBy("seq").collect()] == list(range(1, 701))
    assert exact_ranks(df.where("false"), [F.col("g")], [F.col("seq")]).count() == 0


def test_prerank_plan_has_no_window_over_a_community(spark):
    plan = E.q_wire_prerank(spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window " in x and "windowspecdefinition" in x]
    assert all("__part" in w for w in windows)     # only over the partitions' row counts


# ---- aliases and lenses

def test_alias_hits_equal_contains(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.randint(1, 6))) for _ in range(300)] + ["", None, "techno", "tech"]
    texts = [(i, "".join(rng.choice("aBcé -") for _ in range(rng.randint(0, 40)))) for i in range(120)]
    texts += [(900, None), (901, ""), (902, "Big TECHNO rave"), (903, "a")]
    got = alias_hits(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "alias string"))
    want = {(i, w) for i, t in texts for w in set(words) if w and t and w in t.lower()}
    rows = [tuple(r) for r in got.select("id", "alias").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert alias_hits(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "alias string")).count() == 0


def test_a_text_meets_few_aliases_of_a_large_table(spark):
    # every run of three of these letters is in every text: only longer runs tell the aliases apart
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("abcd") for _ in range(9)) for _ in range(3000)})
    texts = [(i, "".join(rng.choice("abcd") for _ in range(400))) for i in range(40)]
    t = spark.createDataFrame(texts, "id long, text string")
    a = spark.createDataFrame([(w,) for w in words], "alias string")
    hits = alias_hits(t, a).count()
    assert hits == sum(w in x for _, x in texts for w in words)
    near = alias_candidates(t, a)
    assert near.count() <= 20 * hits and alias_candidates(t, a, gram=3).count() > 100 * hits


def test_aliases_outside_the_first_plane_and_over_lines(spark):
    texts = [(1, "x\U0001F3B5y\nline two of it"), (2, "\U0001F3B5\U0001F3B6"), (3, "\U0001F3B6 y")]
    words = ["\U0001F3B5", "\U0001F3B5y", "y\nline two", "\U0001F3B5\U0001F3B6", "\U0001F3B6", "y"]
    got = alias_hits(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(w,) for w in words], "alias string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted((i, w) for i, t in texts for w in words if w in t)


def test_alias_values_equal_the_substring_pass(spark):
    texts = [(1, "techno mixing at the club"), (2, "travel"), (3, "nothing"), (4, "release the label artist")]
    df = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(TAXONOMY_ALIASES)], "alias string, value string, ord int")
    got = {r.id: r["values"] for r in alias_values(df, table, taxonomy=RELEVANCE_TAXONOMY).collect()}
    want = {r.id: r.r for r in df.select("id", derive_relevance(F.array("text"), default="none").alias("r")).collect()}
    assert got == {k: v for k, v in want.items() if v != ["none"]}


def test_match_lenses_against_a_library_of_any_size(spark):
    files = spark.createDataFrame([(f"/l/{i:06d}.md", f"---\nname: Lens {i % 5000}{'x' * 400}\n---\nBody {i}.") for i in range(6000)]
                                  + [("/l/000000a.md", "---\nother: 1\n---\nNameless.")], "path string, value string")
    lib = lens_table(files)
    long = "x" * 400
    df = spark.createDataFrame([(1, [f"LENS 7{long}", "no", f"lens 7{long}", f"Lens 3{long}", f"Lens 1{long}", f"Lens 2{long}"]),
                                (2, []), (3, None), (4, [None, "nope"])], "k long, names array<string>")
    got = {r.k: r.lenses for r in match_lenses_table(df, ["k"], "names", lib).collect()}
    first = [f"Lens 0{long}"]
    assert got == {1: [f"Lens 7{long}", f"Lens 3{long}", f"Lens 1{long}"], 2: first, 3: first, 4: first}
    assert {r.k: r.lenses for r in match_lenses_table(df, ["k"], "names", lib.where("false")).collect()}[1] == []


# ---- model calls

def _counting(folder):
    def gen(system, user):
        import os as _os
        import uuid
        if user == "bad":
            raise RuntimeError("down")
        open(_os.path.join(folder, uuid.uuid4().hex), "w").close()
        return f"{system}:{user}"
    return [FunctionBackend("f", gen)]


def test_each_distinct_prompt_is_called_once_and_remembered(spark, tmpdir_path):
    calls, memory = os.path.join(tmpdir_path, "calls"), os.path.join(tmpdir_path, "memory")
    os.makedirs(calls)
    df = spark.range(60).select("id", F.when(F.col("id") % 10 == 9, "bad").otherwise(F.concat(F.lit("p"), F.col("id") % 7)).alias("text"))
    out = infer_distinct(df, F.lit("sys"), F.col("text"), _counting(calls), partitions=3, memory=memory)
    assert out.columns == ["id", "text", "reply", "backend", "error"]
    got = {r.id: (r.reply, r.error is None) for r in out.collect()}
    assert len(got) == 60 and len(os.listdir(calls)) == 7
    assert all(v == ((None, False) if i % 10 == 9 else (f"sys:p{i % 7}", True)) for i, v in got.items())
    again = infer_distinct(df.unionByName(spark.range(90, 91).select("id", F.lit("new").alias("text"))), F.lit("sys"), F.col("text"),
                           _counting(calls), memory=memory)
    assert again.where("reply is not null").count() == 55 and len(os.listdir(calls)) == 8      # only the new prompt
    assert spark.read.parquet(memory).columns == ["prompt_key", "reply", "backend"]            # no prompt is stored
    other = infer_distinct(df, F.lit("other"), F.col("text"), _counting(calls), memory=memory)
    assert other.where("reply like 'other:%'").count() == 54 and len(os.listdir(calls)) == 15


# ---- gate

def test_three_equal_rows_and_a_budget_of_one(spark):
    rows = [(1, "listing", "c", "u", "t", "survivor", 5, 1.0)] * 3 + [(2, "listing", "c", "v", "t", "maybe", 2, 1.0)]
    df = spark.createDataFrame(rows, "seq long, adapter string, source string, source_url string, title string, "
                                     "bucket string, triage_score int, wire_pre_score double")
    for budget in (0, 1, 2, 5):
        got = survivor_budget(df, budget).collect()
        assert len(got) == 4 and sum(r["bucket"] == "survivor" for r in got) == min(budget, 3)
        assert sum(r["overflow"] for r in got) == 3 - min(budget, 3)


def test_deep_dive_leaves_blank_permalinks_out_of_the_join(spark):
    g = E.triage_gate(E._replied(spark, SF), 3, 1)
    w = F.col("wire")
    blank = g.withColumn("wire", w.withField("permalink", F.when(F.col("seq") % 10 == 0, w["permalink"]).otherwise(F.lit(""))))
    blank = stage(blank, how="table")
    out = deep_dive(blank, S.comments(spark, SF))
    assert out.count() == g.count() and out.where("deep_dived and wire.permalink = ''").count() == 0
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    # both sides of the join, the rows and the permalinks asked for, are filtered below it
    below = plan[plan.index("Join LeftOuter"):]
    assert sum("Filter" in x and "survivor" in x and "permalink" in x for x in below.split("\n")) >= 2


# ---- markup

def test_markup_elements(spark):
    page = ("<!-- <p class=a>no</p> --><script>'<p class=\"a\">'</script>"
            "<div title='x>y' class='a b'>1<div>2</div>3</div><P CLASS=a>up</P><br class='a'/><p class=\"ab\">part</p>"
            "<p data-class='a'>no</p><p class='a'>open <b>end")
    df = spark.createDataFrame([(page,), (None,), ("",), ("no tags < 3",)], "h string")
    got = [r.e for r in df.select(elements("h", [Selector(token="a")]).alias("e")).collect()]
    assert got == [["1<div>2</div>3", "up", "", "open <b>end"], [], [], []]
    part = df.select(elements("h", [Selector(["p"], part="a")], 2).alias("e"), first_element("h", [Selector(token="z"), Selector(part="b")]).alias("f")).first()
    assert part.e == ["up", "part"] and part.f == "1<div>2</div>3"


def test_markup_of_a_long_page(spark):
    page = "<ol class=tracks>" + "".join(f"<li class='n{i}'>{'word ' * 20}</li>" for i in range(3000)) + "</ol>"
    df = spark.createDataFrame([(page,)], "h string")
    e = df.select(elements("h", [Selector(["li"])], 3).alias("e"), F.length(first_element("h", [Selector(token="tracks")])).alias("n")).first()
    assert len(e.e) == 3 and e.n == len(page) - len("<ol class=tracks></ol>")


# ---- fail open

def _sources(spark):
    return E.feed_items(S.feed_entries(spark, SF), S.AS_OF), E._listing(spark, SF)


def _run(spark, sources, **kw):
    args = {"known": None, "lens_files": S.lens_files(spark, SF), "gate_backends": S.gate_backends(),
            "enrich_backends": S.enrich_backends(), "as_of": S.AS_OF, "purpose": "p"}
    return daily_run(sources, **(args | kw))


def _corrupt(spark, df, path):
    df.write.parquet(path)
    for f in os.listdir(path):
        if f.endswith(".parquet"):
            open(os.path.join(path, f), "r+b").write(b"garbage" * 200)
    return spark.read.schema(df.schema).parquet(path)


def test_a_source_that_cannot_be_read_is_left_out(spark, tmpdir_path):
    feed, listing = _sources(spark)

    def raises():
        raise OSError("no such landing")

    r = _run(spark, [_corrupt(spark, feed, os.path.join(tmpdir_path, "feed")), listing, raises], source_names=["feeds", "listing", "charts"])
    assert r.summary.first()["fetched"] == listing.count()
    errors = {q.payload.split(":")[0]: q.error_kind for q in r.quarantine.where("stage = 'adapter'").collect()}
    assert errors == {"feeds": "adapter_error", "charts": "adapter_error"}


def test_a_funnel_that_fails_lets_items_pass_ungated(spark, tmpdir_path):
    listing = _sources(spark)[1]
    comments = _corrupt(spark, S.comments(spark, SF), os.path.join(tmpdir_path, "comments"))
    r = _run(spark, [listing], comments=comments)
    failed = r.quarantine.where("stage = 'funnel'").collect()
    assert [f.error_kind for f in failed] == ["funnel_error"]
    assert {x.bucket for x in r.notes.select("bucket").distinct().collect()} == {"ungated"}
    s, clean = r.summary.first(), _run(spark, [listing], funnel_enabled=False).summary.first()
    assert s == clean and s["rejected"] == 0 and s["fetched"] == listing.count()


def test_daily_run_with_a_store(spark, tmpdir_path):
    feed, listing = _sources(spark)
    store = NoteStore(spark, os.path.join(tmpdir_path, "store"), buckets=4)
    first = _run(spark, [feed], store=store, memory=os.path.join(tmpdir_path, "memory")).summary.first()
    assert first["written"] == store.rows().count() > 0
    second = _run(spark, [feed], store=store, as_of="2024-03-02", memory=os.path.join(tmpdir_path, "memory")).summary.first()
    assert second["already_stored"] == first["written"] and second["written"] == 0
