"""Triage gate, survivor budget, deep dive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions.prompts import GATE_SYSTEM, GATE_USER, fill, item_json


def gate_prompt_columns(lens_summary: Column, exemplar_block: Column, system_template: str = GATE_SYSTEM,
                        user_template: str = GATE_USER, body_chars: int = 500) -> tuple[Column, Column]:
    """P27 (gate): the ``system`` and ``user`` prompts over item columns; the body
    is cut to ``body_chars``. Templates may use ``{item}`` (all fields as JSON) or
    the single fields; the system prompt is the same for all items."""
    w = F.col("wire")
    fields = {
        "subreddit": F.coalesce(w["subreddit"], F.lit("")),
        "title": F.coalesce(F.col("title"), F.lit("")),
        "body": F.substring(F.coalesce(F.col("body"), F.lit("")), 1, body_chars),
        "score": F.coalesce(w["score"], F.lit(0)),
        "num_comments": F.coalesce(w["num_comments"], F.lit(0)),
        "upvote_ratio": F.coalesce(w["upvote_ratio"], F.lit(0.0)),
    }
    return (fill(system_template, lens_summary=F.coalesce(lens_summary, F.lit("(none)"))),
            fill(user_template, exemplar_block=exemplar_block, item=item_json(**fields), **fields))


def gate_prompts(items: DataFrame, lens_summary: Column, exemplar_block: Column,
                 system_template: str = GATE_SYSTEM, user_template: str = GATE_USER,
                 body_chars: int = 500) -> DataFrame:
    """``items`` with ``system`` and ``user`` prompt columns."""
    system, user = gate_prompt_columns(lens_summary, exemplar_block, system_template, user_template, body_chars)
    return items.withColumns({"system": system, "user": user})


def triage_verdict(v: Column, error: str = "error", threshold: int = 3) -> tuple[Column, Column]:
    """(triage struct, triage_score) from a parsed reply ``v`` and a call error.

    A call error scores ``threshold - 1`` (fail open to maybe); an unparsable
    reply, a non-object reply (T9: a row-level fix, not a funnel failure) or a
    score that is not an integer scores 0; the score is clamped to 0..5.
    """
    rw = R.clamp_int(v, "reaction_worthiness", 0, 5, 0)
    err = F.col(error)
    score = F.when(err.isNotNull(), F.lit(threshold - 1)).otherwise(F.coalesce(rw, F.lit(0))).cast("int")
    usable = rw.isNotNull()
    triage = F.struct(
        score.alias("reaction_worthiness"),
        F.when(err.isNull() & usable, R.get_string(v, "best_lens")).alias("best_lens"),
        F.when(err.isNotNull(), F.lit(None).cast("string"))
         .when(usable, R.get_string(v, "why")).otherwise(F.lit("unparsable")).alias("why"),
        err.alias("error"),
    )
    return triage, score


def triage_gate(replied: DataFrame, threshold: int = 3, maybe_band: int = 1) -> DataFrame:
    """Bucket each replied row: score >= threshold survivor, >= threshold
    - band maybe, else rejected; a call error is always maybe."""
    replied = replied.withColumn("__v", R.parse_reply(F.col("reply")))
    triage, score = triage_verdict(F.col("__v"), threshold=threshold)
    out = replied.withColumns({"triage": triage, "triage_score": score}).drop("__v")
    s = F.col("triage_score")
    bucket = (F.when(F.col("triage.error").isNotNull(), F.lit("maybe"))
              .when(s >= threshold, F.lit("survivor"))
              .when(s >= threshold - maybe_band, F.lit("maybe"))
              .otherwise(F.lit("rejected")))
    return out.withColumns({"bucket": bucket, "overflow": F.lit(False)})


def survivor_order() -> list[Column]:
    """Survivor ranking: triage score desc, then pre-rank order (stable)."""
    return [F.col("triage_score").desc(), F.col("wire_pre_score").desc(), F.col("seq").asc()]


def survivor_budget(gated: DataFrame, max_survivors: int | None, key: str = "seq") -> DataFrame:
    """Keep the top ``max_survivors`` survivors; the rest become maybe
    (``overflow`` = true).

    The top-n is a ``TakeOrderedAndProject`` (each partition keeps n rows,
    then one merge); the chosen rows are found again by the item's
    identity: ``key`` with its run number (``item_no``, where it has one), adapter,
    source, URL and title, because positions start anew in every source. Rows that
    are equal in all of these are numbered, so that as many of them survive as were
    chosen. No global window; only rows with a chosen identity meet in the numbering.
    """
    if max_survivors is None:
        return gated
    named = [c for c in (key, "item_no", "adapter", "source", "source_url", "title") if c in gated.columns]
    marked = gated.withColumn("__item", F.xxhash64(F.to_json(F.struct(*named), {"ignoreNullFields": "false"})))
    top = (marked.where(F.col("bucket") == "survivor").orderBy(*survivor_order())
           .limit(int(max_survivors)).groupBy("__item").agg(F.count(F.lit(1)).alias("__chosen")))
    survives = F.col("bucket") == "survivor"
    equal = Window.partitionBy("__item").orderBy(survives.desc(), *survivor_order())
    met = marked.join(top, "__item").withColumn("__nth", F.row_number().over(equal))
    over = survives & (F.col("__nth") > F.col("__chosen"))
    columns = [c for c in gated.columns if c not in ("bucket", "overflow")]
    bucket = lambda is_over: F.when(is_over, F.lit("maybe")).otherwise(F.col("bucket")).alias("bucket")
    kept = met.select(*columns, bucket(over), over.alias("overflow"))
    rest = marked.join(top, "__item", "left_anti").select(*columns, bucket(survives), survives.alias("overflow"))
    return kept.unionByName(rest).select(*columns, "bucket", "overflow")


def top_comments(comments: DataFrame, k: int = 12, key: str = "permalink") -> DataFrame:
    """The first ``k`` comments per post joined by `` | `` (J4 build side).

    ``row_number() <= k`` plans a partial WindowGroupLimit before the
    shuffle, so a post with a huge thread sends at most k rows per map task;
    the collected list is then bounded by k.
    """
    w = Window.partitionBy(key).orderBy(F.col("pos").asc(), F.col("text").asc())
    top = comments.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return top.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", "text"))), lambda x: x["text"]), " | ")
        .alias("top_comments"))


def deep_dive(gated: DataFrame, comments: DataFrame, k: int = 12, body_chars: int = 1500) -> DataFrame:
    """Survivors with a permalink get their top ``k`` comments appended to
    the body (cut to ``body_chars``) and ``deep_dived`` = true.

    Only those survivors enter the join: all other rows, whose permalink may be
    blank for most, go past it and are never shuffled. Comments are first
    semi-joined to the permalinks so only needed threads are shuffled.
    """
    perm = F.col("wire.permalink")
    asks = F.coalesce((F.col("bucket") == "survivor") & (F.coalesce(perm, F.lit("")) != ""), F.lit(False))
    diving = gated.where(asks).withColumn("__permalink", perm)
    want = diving.select(F.col("__permalink").alias("permalink")).distinct()
    tc = top_comments(comments.join(want, "permalink", "left_semi"), k).withColumnRenamed("permalink", "__permalink")
    j = diving.join(tc, "__permalink", "left")
    hit = F.col("top_comments").isNotNull()
    body = F.substring(F.concat(F.coalesce(F.col("body"), F.lit("")), F.lit("\n\nTop comments: "), F.col("top_comments")),
                       1, body_chars)
    dived = (j.withColumn("body", F.when(hit, body).otherwise(F.col("body")))
             .withColumn("deep_dived", hit).drop("top_comments", "__permalink"))
    return dived.unionByName(gated.where(~asks).withColumn("deep_dived", F.lit(False)))


def run_order() -> list[Column]:
    """Order after the funnel (T30): ungated, survivors, maybe; then triage
    score desc, pre-rank score desc, seq."""
    b = F.col("bucket")
    bo = F.when(b == "ungated", 0).when(b == "survivor", 1).when(b == "maybe", 2).otherwise(3)
    return [bo.asc(), F.coalesce(F.col("triage_score"), F.lit(99)).desc(),
            F.coalesce(F.col("wire_pre_score"), F.lit(0.0)).desc(), F.col("seq").asc()]
