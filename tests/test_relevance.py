"""Listing scores, the gate, the survivor budget, the deep dive and stored labels."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions.prompts import NEGATIVE_VERDICT, POSITIVE_VERDICT
from gleaner.operators.gate import deep_dive, gate_prompts, survivor_budget, triage_gate
from gleaner.operators.infer import FunctionBackend, infer_batch
from gleaner.operators.notes import exemplar_block, harvest_labels, select_exemplars
from gleaner.operators.score import wire_prerank
from gleaner.schemas import RAW_ITEM

QUIET = {"subreddit": "kites", "score": 0, "num_comments": 0, "upvote_ratio": 0.5, "is_self": False,
         "is_video": False, "domain": "", "flair": "", "metrics_available": True}


def posts(spark, wires):
    """Raw items from {title: fields of ``wire`` that differ from QUIET}."""
    rows = []
    for at, (title, wire) in enumerate(wires.items()):
        link = f"/r/kites/comments/k{at}/"
        rows.append({"seq": at, "adapter": "listing", "source": "kites", "title": title, "body": f"about {title}",
                     "source_url": f"https://forum.invalid{link}",
                     "wire": {**QUIET, "permalink": link, "feed_rank": at, **wire}})
    return spark.createDataFrame(rows, RAW_ITEM)


def gated(spark, replies, **params):
    """Gate decisions by title, the model answering ``replies[title]``; an exception is raised."""

    def answer(system, user):
        reply = replies[json.loads(user)["title"]]
        if isinstance(reply, Exception):
            raise reply
        return reply if isinstance(reply, str) else json.dumps(reply)

    prompts = gate_prompts(wire_prerank(posts(spark, {t: {} for t in replies})), F.lit("angles"), F.lit(""))
    return triage_gate(infer_batch(prompts, [FunctionBackend("scripted", answer)]), **params)


def rated(n):
    return {"reaction_worthiness": n, "best_lens": "wind", "why": f"rated {n}"}


@pytest.mark.parametrize("wire,score", [
    ({}, 0.0),
    ({"upvote_ratio": 0.0}, -1.0),
    ({"score": 90, "num_comments": 50}, 2.5 + 1.959),
    ({"num_comments": 7000}, 5.0),
    ({"is_self": True}, 2.0),
    ({"is_video": True, "domain": "V.redd.it"}, -2.5),
    ({"domain": "paper.invalid"}, 1.0),
    ({"domain": "self.kites"}, 0.0),
    ({"score": -40, "num_comments": -3}, 0.0),
])
def test_terms_of_the_score(spark, wire, score):
    assert wire_prerank(posts(spark, {"calm": wire})).first().wire_pre_score == pytest.approx(score, abs=1e-3)


def test_title_keywords_count_up_to_three(spark):
    titles = ["Rope", "Rope, sail and KEEL", "rope sail keel mast", "none of them"]
    df = wire_prerank(posts(spark, {t: {} for t in titles}), ["rope", "sail", "keel", "mast"])
    assert [r.wire_pre_score for r in df.orderBy("seq").collect()] == [1.5, 4.5, 4.5, 0.0]


def test_prompt_holds_the_item_as_json(spark):
    p = gate_prompts(posts(spark, {'A "quoted"\ntitle': {"score": 12}}), F.lit("- wind: gusts"), F.lit("earlier\n\n")).first()
    assert p.user.startswith("earlier\n\n{") and "- wind: gusts" in p.system
    item = json.loads(p.user.rsplit("\n\n", 1)[1])
    assert (item["title"], item["score"], item["subreddit"]) == ('A "quoted"\ntitle', 12, "kites")


@pytest.mark.parametrize("threshold,band,buckets", [
    (3, 1, ["rejected", "rejected", "maybe", "survivor", "survivor", "survivor"]),
    (4, 2, ["rejected", "rejected", "maybe", "maybe", "survivor", "survivor"]),
    (1, 1, ["maybe", "survivor", "survivor", "survivor", "survivor", "survivor"]),
])
def test_buckets_by_threshold_and_band(spark, threshold, band, buckets):
    g = gated(spark, {f"post {n}": rated(n) for n in range(6)}, threshold=threshold, maybe_band=band)
    assert [r.bucket for r in g.orderBy("seq").collect()] == buckets


@pytest.mark.parametrize("reply,score,why", [
    ('```json\n{"reaction_worthiness": 2, "why": "in a fence"}\n```', 2, "in a fence"),
    ('{"reaction_worthiness": "4", "why": "as text"}', 4, "as text"),
    ('{"reaction_worthiness": 2.9, "why": "cut"}', 2, "cut"),
    ('{"reaction_worthiness": "2.9"}', 0, "unparsable"),
    ('{"reaction_worthiness": 70, "why": "over"}', 5, "over"),
    ('{"reaction_worthiness": -70, "why": "under"}', 0, "under"),
    ('{"why": "no rating"}', 0, "no rating"),
    ("[5, 5]", 0, "unparsable"),
    ("null", 0, "unparsable"),
    ("I would rather not say.", 0, "unparsable"),
])
def test_shapes_of_a_reply(spark, reply, score, why):
    r = gated(spark, {"one": reply, "other": rated(4)}).orderBy("seq").collect()
    assert r[0].triage_score == score and r[0].triage.why == why
    assert r[1].bucket == "survivor"  # a bad reply touches its own row only


def test_failed_call_is_a_maybe(spark):
    r = gated(spark, {"lost": ConnectionError("line cut")}, threshold=4).first()
    assert (r.bucket, r.triage_score) == ("maybe", 3) and "line cut" in r.triage.error


@pytest.mark.parametrize("budget", [0, 1, 5, 9])
def test_budget_keeps_the_best(spark, budget):
    ratings = [3, 5, 4, 1, 5, 3, 4]
    out = survivor_budget(gated(spark, {f"no. {i}": rated(n) for i, n in enumerate(ratings)}), budget).collect()
    best = sorted((i for i, n in enumerate(ratings) if n >= 3), key=lambda i: (-ratings[i], i))
    assert {r.seq for r in out if r.bucket == "survivor"} == set(best[:budget])
    assert {r.seq for r in out if r.overflow} == set(best[budget:])
    assert all(r.bucket == "maybe" for r in out if r.overflow) and len(out) == len(ratings)


def test_comments_reach_survivors_only(spark):
    g = gated(spark, {"storm": rated(5), "drizzle": rated(2), "calm": rated(0)})
    comments = spark.createDataFrame([(f"/r/kites/comments/k{at}/", pos, f"{at}-{pos}") for at in range(3) for pos in (2, 0, 1)],
                                     "permalink string, pos int, text string")
    got = {r.title: (r.deep_dived, r.body) for r in deep_dive(g, comments, k=2).collect()}
    assert got["storm"][0] and got["storm"][1].endswith("0-0 | 0-1")
    assert got["drizzle"] == (False, "about drizzle") and got["calm"] == (False, "about calm")


def note(folder, name, **head):
    lines = "\n".join(f"{k}: {v}" for k, v in head.items())
    return f"/store/{folder}/{name}.md", f"---\n{lines}\n---\ntext of {name}\n"


def stored(spark, notes):
    return spark.createDataFrame(notes, "path string, value string")


def test_labels_of_stored_notes(spark):
    link = "https://www.reddit.com/r/{}/comments/z/".format
    files = stored(spark, [
        note("Inbox", "kite", status="reacted", source_url=link("kites")),
        note("Archived", "pond", status="archived", source_url=link("ponds")),
        note("Inbox", "fresh", status="inbox", source_url=link("fresh")),
        note("Inbox", "none", source_url=link("none")),
        note("Inbox", "essay", status="reacted", source_url="https://essays.invalid/7"),
        note("lenses", "angle", status="reacted", source_url=link("angles")),
    ])
    assert {(r.subreddit, r.positive) for r in harvest_labels(files).collect()} == {("kites", True), ("ponds", False)}
    assert harvest_labels(files, reddit_only=False).count() == 3


def test_floor_holds_for_negatives_only(spark):
    link = "https://www.reddit.com/r/kites/comments/{}/".format
    files = stored(spark, [
        note("Archived", "near", status="archived", source_url=link(1), wire_pre_score=8.25),
        note("Archived", "far", status="archived", source_url=link(2), wire_pre_score=7.75),
        note("Archived", "taken", status="reacted", source_url=link(3), wire_pre_score=0),
    ])
    assert harvest_labels(files).count() == 3
    assert {r.path.rsplit("/", 1)[1] for r in harvest_labels(files, min_score=8.0).collect()} == {"near.md", "taken.md"}


@pytest.mark.parametrize("n_pos,n_neg", [(2, 1), (0, 4), (9, 9)])
def test_latest_labels_become_examples(spark, n_pos, n_neg):
    link = "https://www.reddit.com/r/kites/comments/{}/".format
    days = {"reacted": ["2019-11-03", "2021-04-30", "2020-08-08", "2018-01-19"],
            "archived": ["2022-12-25", "2017-06-11", "2023-09-01"]}
    files = stored(spark, [note("Inbox", f"{s}-{d}", status=s, date=d, title=f"{s} on {d}", source_url=link(f"{s}{d}"))
                           for s, ds in days.items() for d in ds])
    chosen = select_exemplars(harvest_labels(files), n_pos=n_pos, n_neg=n_neg)
    latest = {True: sorted(days["reacted"])[::-1][:n_pos], False: sorted(days["archived"])[::-1][:n_neg]}
    assert {(r.positive, r.date) for r in chosen.collect()} == {(k, d) for k, ds in latest.items() for d in ds}
    block = files.limit(1).select(exemplar_block(chosen).alias("b")).first().b
    assert block.count(POSITIVE_VERDICT) == len(latest[True]) and block.count(NEGATIVE_VERDICT) == len(latest[False])
