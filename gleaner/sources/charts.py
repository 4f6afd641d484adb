"""Chart pages (S4, S5, X2, P11): ranked rows out of landed HTML pages.

Pages are rows (url, genre, slug, ord, html) -- ``ord`` is the chart's place
in the configured list; every step is a column expression
plus ``posexplode``, so a page never leaves its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import replies as R
from ..functions._util import let
from ..functions.markup import Selector, elements, first_element
from ..functions.prompts import fill
from ..functions.text import strip_ws
from ..operators.dedup import dedup_first
from ..operators.items import make_seq



# The class names that mark chart rows, their lists and fields, in the order they are tried.
ROWS = (Selector(["li"], token="bucket-item"), Selector(["li"], part="track"), Selector(["div"], part="track-row"))
LISTS = (Selector(["ol"], token="bucket-items"), Selector(["ul"], token="tracks"))
ARTIST = (Selector(token="artists"), Selector(token="track-artists"), Selector(part="artist"))
TITLE = (Selector(token="title"), Selector(token="track-title"), Selector(part="title"), Selector(["span"], token="name"))
SCRIPT_PATTERN = r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'
# Where a track list may sit inside the embedded JSON, tried in order.
TRACK_PATHS = (
    "$.props.pageProps.chart.tracks",
    "$.props.pageProps.tracks",
    "$.props.pageProps.dehydratedState.queries[0].state.data.results",
    "$.tracks", "$.items", "$.results", "$.data",
)

# Both are part of a note and its id.
CHART_SOURCE = "Beatport Charts"
CHART_BODY = "Track charting in Beatport {genre} Top 100."
DASH = " — "


def chart_label(artist: Column, title: Column) -> Column:
    """``artist — title``, or whichever exists; NULL when neither."""
    a = F.coalesce(artist, F.lit(""))
    t = F.coalesce(title, F.lit(""))
    return (F.when((a != "") & (t != ""), F.concat(a, F.lit(DASH), t))
            .when(a != "", a).when(t != "", t))


def node_text(c: Column) -> Column:
    """Text of a markup fragment with every text piece stripped and the
    pieces joined without a separator (as ``get_text(strip=True)``)."""
    return strip_ws(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s*<[^>]*>\s*", ""))


def _chart_rows(pages: DataFrame, label: Column, pos_col: str, as_of, source_name: str,
                body_template: str, via: str) -> DataFrame:
    body = fill(body_template, genre=F.col("genre"))
    return pages.select(
        make_seq("beatport", F.col("ord"), F.col(pos_col)).alias("seq"),
        F.lit("beatport").alias("adapter"),
        F.lit(source_name).alias("source"),
        F.col("url").alias("source_url"),
        label.alias("title"),
        body.alias("body"),
        F.lit(as_of).cast("date").alias("published_date"),
        F.lit(None).cast("string").alias("author"),
        F.array(F.col("slug"), F.lit("chart"), F.lit("beatport")).alias("raw_tags"),
        F.lit(None).cast("struct<subreddit:string,score:bigint,num_comments:bigint,upvote_ratio:double,"
                         "is_video:boolean,is_self:boolean,domain:string,flair:string,permalink:string,"
                         "feed_rank:int,metrics_available:boolean>").alias("wire"),
        F.col(pos_col).alias("chart_pos"),
        F.lit(via).alias("via"),
    )


def _field(row: str, how: Sequence[Selector] | str) -> Column:
    """Text of the first element that fits (one found empty counts), or of a
    pattern's first group; '' when there is none."""
    if isinstance(how, str):
        return node_text(F.regexp_extract(row, how, 1))
    return node_text(first_element(row, how))


def html_items(pages: DataFrame, as_of, top_n: int = 10, row_pattern: str | None = None,
               artist: Sequence[Selector] | str = ARTIST, title: Sequence[Selector] | str = TITLE,
               source_name: str = CHART_SOURCE, body_template: str = CHART_BODY, rows: Sequence[Selector] = ROWS,
               lists: Sequence[Selector] = LISTS) -> DataFrame:
    """The first ``top_n`` chart rows of each page (cut before dedup, so a
    page may give fewer, T24; without a row by class, the items of its track
    lists), whole text of the artist and title parts, rows with neither dropped,
    first row per page and lower-cased label kept.

    Rows and fields are elements by their classes; pages without classes may give
    a regular expression for rows (``row_pattern``), artist and title instead.
    """
    if row_pattern is not None:
        found = F.regexp_extract_all("html", F.lit(row_pattern), 1)
    else:
        listed = F.flatten(F.transform(elements("html", lists), lambda part: elements(part, [Selector(["li"])], top_n)))
        found = let(elements("html", rows, top_n), lambda r: F.when(F.size(r) > 0, r).otherwise(listed))
    out = pages.select("url", "genre", "slug", "ord", F.posexplode(found).alias("pos", "row"))
    out = out.where(F.col("pos") < top_n)
    out = out.withColumn("label", chart_label(_field("row", artist), _field("row", title)))
    out = out.where(F.col("label").isNotNull())
    out = dedup_first(out.withColumn("__k", F.lower("label")), ["url", "__k"], ["pos"])
    return _chart_rows(out, F.col("label"), "pos", as_of, source_name, body_template, "html")


def _track_label(t: Column) -> Column:
    name = R.get_string(t, "name")
    title = F.when(R.field(t, "name").isNull(), F.coalesce(R.get_string(t, "title"), F.lit(""))).otherwise(
        F.coalesce(name, F.lit("")))
    arts = R.get_array(t, "artists")
    names = F.filter(F.transform(F.coalesce(arts, F.array().cast("array<variant>")),
                                 lambda a: R.get_string(a, "name")), lambda x: F.coalesce(x, F.lit("")) != "")
    artist = F.when(arts.isNotNull(), F.array_join(names, ", ")).otherwise(
        F.coalesce(R.get_string(t, "artists"), F.lit("")))
    return chart_label(artist, title)


def _track_list(v: Column, path: str) -> Column:
    def tracks(a):
        first = F.get(a, 0)
        return F.when(R.field(first, "name").isNotNull() | R.field(first, "title").isNotNull(), a)

    return let(F.try_variant_get(v, path, "array<variant>"), tracks)


def json_items(pages: DataFrame, as_of, top_n: int = 10, script_pattern: str = SCRIPT_PATTERN,
               paths=TRACK_PATHS, source_name: str = CHART_SOURCE, body_template: str = CHART_BODY) -> DataFrame:
    """The track list of the page's embedded JSON (first path, in the given
    order, whose list starts with an object that has a name or title), first ``top_n`` tracks, label per track;
    no dedup on this path (T22)."""
    blob = F.try_parse_json(F.regexp_extract("html", script_pattern, 1))
    p = pages.withColumn("__v", blob)
    tracks = F.coalesce(*[_track_list(F.col("__v"), path) for path in paths])
    rows = p.select("url", "genre", "slug", "ord", F.posexplode(tracks).alias("pos", "t")).where(F.col("pos") < top_n)
    rows = rows.withColumn("label", _track_label(F.col("t"))).where(F.col("label").isNotNull())
    return _chart_rows(rows, F.col("label"), "pos", as_of, source_name, body_template, "json")


def chart_items(pages: DataFrame, as_of, top_n: int = 10, html_kw: dict | None = None,
                json_kw: dict | None = None) -> DataFrame:
    """S4 with S5 as fallback: pages that gave no HTML rows use their JSON
    (``via`` tells which)."""
    h = html_items(pages, as_of, top_n, **(html_kw or {}))
    got = h.select(F.col("source_url").alias("url")).distinct()
    j = json_items(pages.join(got, "url", "left_anti"), as_of, top_n, **(json_kw or {}))
    return h.unionByName(j)
