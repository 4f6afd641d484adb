"""Landed entries -> ``raw_item`` rows (S1-S3 row logic, F1, F2, U1s).

The scans in ``gleaner.sources`` read files into entry rows; these functions
turn entry rows of any origin into the one item schema.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_date, item_date
from ..functions.links import community_tags, feed_tags, first_flair, link_meta, listing_tags
from ..functions.text import nonblank, pick_body, strip_html, strip_ws
from ..schemas import RAW_ITEM
from .dedup import dedup_first

BODY_CHARS = 500
COMMUNITY_BASE = "https://www.reddit.com"
ADAPTER_ORDER = {"rss": 0, "reddit": 1, "beatport": 2}


def make_seq(adapter: str, source_ord, pos) -> Column:
    """Run order key: adapter order, then source ordinal, then position."""
    a = ADAPTER_ORDER.get(adapter, 3)
    return (F.lit(a).cast("long") * F.lit(1 << 56)
            + F.coalesce(F.col(source_ord) if isinstance(source_ord, str) else source_ord, F.lit(0)).cast("long") * F.lit(1 << 32)
            + F.coalesce(F.col(pos) if isinstance(pos, str) else pos, F.lit(0)).cast("long"))


def item_key(df: DataFrame) -> Column:
    """What makes an item of ``df`` the same on another day: its URL; for a
    chart track, whose URL is the chart's page, also its title and date."""
    url = F.coalesce(F.col("source_url"), F.lit(""))
    if not {"adapter", "title", "published_date"} <= set(df.columns):
        return url
    track = F.concat_ws("\x1f", url, F.coalesce(F.col("title"), F.lit("")),
                        F.coalesce(F.col("published_date").cast("string"), F.lit("")))
    return F.when(F.col("adapter") == "beatport", track).otherwise(url)


def drop_blank_url(df: DataFrame, col: str = "source_url") -> DataFrame:
    """drop rows whose URL is NULL or empty."""
    return df.where(F.coalesce(F.col(col), F.lit("")) != "")


def feed_items(entries: DataFrame, as_of, body_chars: int = BODY_CHARS) -> DataFrame:
    """S1 row logic: feed entries -> raw items.

    Entries without a link are skipped; within one feed the first entry of a
    link wins (other feeds may repeat it). Body = summary, else content, HTML
    stripped and cut; date = published, else updated, else ``as_of``; tags =
    non-empty category terms; title defaults to ``(no title)``.
    """
    e = drop_blank_url(entries, "link")
    e = dedup_first(e, ["feed", "link"], ["pos"])
    return e.select(
        make_seq("rss", "feed_ord", "pos").alias("seq"),
        F.lit("rss").alias("adapter"),
        F.col("feed").alias("source"),
        F.col("link").alias("source_url"),
        F.coalesce(F.col("title"), F.lit("(no title)")).alias("title"),
        strip_html(pick_body("summary", "content"), body_chars).alias("body"),
        item_date("published", "updated", as_of).alias("published_date"),
        F.col("author"),
        feed_tags("categories").alias("raw_tags"),
        F.lit(None).cast(RAW_ITEM["wire"].dataType).alias("wire"),
    )


def community_items(entries: DataFrame, as_of, top_n: int = 5, body_chars: int = BODY_CHARS,
                    base: str = COMMUNITY_BASE, exact_shared_urls: bool = True) -> DataFrame:
    """Community feed entries (``feed`` = community name, ``feed_ord`` =
    its position in the configured list) -> raw items with a metrics-less wire.

    Keeps the first ``top_n`` entries per community in feed order after
    dropping blank and repeated links. A link kept by an earlier community is
    not kept again, and one cut from an earlier community can still be kept by
    a later one, exactly as a sequential reader would. Without
    ``exact_shared_urls`` the lazy window form is used, which gives the same
    only where every link belongs to one community.
    """
    from .dedup import sequential_top_n, top_n_per_source

    e = drop_blank_url(entries, "link")
    if exact_shared_urls:
        kept = sequential_top_n(e, "feed", "feed_ord", "link", "pos", top_n)
    else:
        kept = top_n_per_source(e, "feed", "feed_ord", "link", "pos", top_n)
    html = F.coalesce(nonblank("content"), nonblank("summary"), F.lit(""))
    meta = link_meta(html)
    sub = F.col("feed")
    body = F.coalesce(nonblank(strip_html(html, body_chars)),
                      F.concat(F.lit("Posted in r/"), sub, F.lit(".")))
    return kept.select(
        make_seq("reddit", "feed_ord", "pos").alias("seq"),
        F.lit("reddit").alias("adapter"),
        F.concat(F.lit("Reddit/r/"), sub).alias("source"),
        F.col("link").alias("source_url"),
        F.coalesce(F.col("title"), F.lit("(no title)")).alias("title"),
        body.alias("body"),
        item_date("published", "updated", as_of).alias("published_date"),
        F.col("author"),
        community_tags(sub, "categories").alias("raw_tags"),
        F.struct(
            sub.alias("subreddit"), F.lit(0).cast("long").alias("score"),
            F.lit(0).cast("long").alias("num_comments"), F.lit(0.0).alias("upvote_ratio"),
            F.lit(False).alias("is_video"), F.coalesce(meta["is_self"], F.lit(False)).alias("is_self"),
            meta["domain"].alias("domain"), first_flair(sub, "categories").alias("flair"),
            F.replace(F.col("link"), F.lit(base), F.lit("")).alias("permalink"),
            F.col("pos").cast("int").alias("feed_rank"), F.lit(False).alias("metrics_available"),
        ).alias("wire"),
    )


def listing_items(children: DataFrame, as_of, body_chars: int = BODY_CHARS,
                  base: str = COMMUNITY_BASE, community_ord: str | None = None) -> DataFrame:
    """S3 row logic: listing children (``community`` plus the listing fields)
    -> raw items with full wire metrics. Stickied children are dropped."""
    c = children.where(~F.coalesce(F.col("stickied"), F.lit(False)))
    sub = F.col("community")
    selftext = strip_ws(F.coalesce(F.col("selftext"), F.lit("")))
    score = F.coalesce(F.col("score"), F.lit(0)).cast("long")
    body = F.when(selftext != "", F.substring(selftext, 1, body_chars)).otherwise(
        F.concat(F.lit("Posted in r/"), sub, F.lit(" with "), score.cast("string"), F.lit(" upvotes.")))
    flair = F.coalesce(F.col("link_flair_text"), F.lit(""))
    ordc = F.col(community_ord) if community_ord else F.lit(0)
    return c.select(
        make_seq("reddit", ordc, F.col("rank")).alias("seq"),
        F.lit("reddit").alias("adapter"),
        F.concat(F.lit("Reddit/r/"), sub).alias("source"),
        F.concat(F.lit(base), F.coalesce(F.col("permalink"), F.lit(""))).alias("source_url"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        body.alias("body"),
        epoch_date(F.col("created_utc"), as_of).alias("published_date"),
        F.lit(None).cast("string").alias("author"),
        listing_tags(sub, flair).alias("raw_tags"),
        F.struct(
            sub.alias("subreddit"), score.alias("score"),
            F.coalesce(F.col("num_comments"), F.lit(0)).cast("long").alias("num_comments"),
            F.coalesce(F.col("upvote_ratio"), F.lit(0.0)).cast("double").alias("upvote_ratio"),
            F.coalesce(F.col("is_video"), F.lit(False)).alias("is_video"),
            F.coalesce(F.col("is_self"), F.lit(False)).alias("is_self"),
            F.coalesce(F.col("domain"), F.lit("")).alias("domain"),
            flair.alias("flair"),
            F.coalesce(F.col("permalink"), F.lit("")).alias("permalink"),
            F.col("rank").cast("int").alias("feed_rank"),
            F.lit(True).alias("metrics_available"),
        ).alias("wire"),
    )


def union_sources(*frames: DataFrame) -> DataFrame:
    """U1s: union adapter outputs by column name (missing columns NULL). A
    failed adapter is simply left out by the caller."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no sources")
    cols = [f.name for f in RAW_ITEM.fields]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*cols)
