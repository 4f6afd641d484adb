"""Stand-in inputs built from the provided test tables.

Each builder only reshapes a test table into the row shape an operator
expects (a landed feed entry, a listing child, a note file, a lens file, a
fetched response, a chart page, a comment). None of them does the operator's
work; the operators must be right on any data of that shape.
The DuckDB oracles in ``__spark_entry__`` build the same rows in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-03-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from .sources.tables import read_table
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS-like entries from ``pages``: feed = host, link = url, title =
    ``<title>``, summary = the ``<article>`` markup, content = the whole page,
    categories = the navigation link texts, position = page_id."""
    return pages_as_entries(table(spark, sf_dir, "pages"))


def pages_as_entries(p: DataFrame) -> DataFrame:
    """``feed_entries`` over any (also streaming) frame of ``pages`` rows."""
    return p.select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("feed"),
        F.lit(0).alias("feed_ord"),
        F.col("page_id").cast("int").alias("pos"),
        F.col("url").alias("link"),
        F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1).alias("summary"),
        F.col("html").alias("content"),
        F.lit(None).cast("string").alias("published"),
        F.lit(None).cast("string").alias("updated"),
        F.lit(None).cast("string").alias("author"),
        F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">([^<]*)</a></li>'), 1).alias("categories"),
    )


def dated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with feed-style date strings from ``events``: a purchase has an
    RFC 822 published date, a click an ISO updated date, others none."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_type") == "purchase",
               F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss '+0000'")).alias("published"),
        F.when(F.col("event_type") == "click",
               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("updated"),
    )


def listing_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community listing children from ``events`` grouped by user: score =
    views, comments = clicks, ratio = purchases / (purchases + errors),
    community = user_id % 7, title = first and last event type by time."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "purchase").alias("purchases"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "signup").alias("signups"),
        F.min("event_id").alias("first_event"),
        F.min("ts").alias("first_ts"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )
    sub = F.concat(F.lit("sub"), (F.col("user_id") % 7).cast("string"))
    return g.select(
        sub.alias("community"),
        F.concat(F.lit("/r/"), sub, F.lit("/comments/"), F.col("user_id").cast("string"), F.lit("/")).alias("permalink"),
        F.concat_ws(" ", "first_type", F.lit("then"), "last_type", F.lit("by user"),
                    F.col("user_id").cast("string")).alias("title"),
        F.when(F.col("signups") > F.col("errors"),
               F.concat(F.lit("Signed up "), F.col("signups").cast("string"), F.lit(" times."))).otherwise(F.lit("")).alias("selftext"),
        F.col("views").alias("score"),
        F.col("clicks").alias("num_comments"),
        F.try_divide(F.col("purchases").cast("double"), (F.col("purchases") + F.col("errors")).cast("double")).alias("upvote_ratio"),
        F.unix_timestamp(F.col("first_ts").cast("timestamp")).cast("double").alias("created_utc"),
        F.col("first_type").alias("link_flair_text"),
        ((F.col("user_id") % 11) == 0).alias("stickied"),
        (F.col("signups") > F.col("errors")).alias("is_self"),
        (F.col("errors") > F.col("purchases")).alias("is_video"),
        F.when(F.col("signups") > F.col("errors"), F.concat(F.lit("self."), sub))
         .when(F.col("user_id") % 3 == 0, F.lit("v.redd.it"))
         .when(F.col("user_id") % 3 == 1, F.concat(F.lit("news"), (F.col("user_id") % 5).cast("string"), F.lit(".example.com")))
         .otherwise(F.lit("")).alias("domain"),
        F.col("first_event").alias("rank"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments from ``conversations``: post = conv_id (permalink of that
    community post), position = turn, text; system turns are not comments."""
    c = table(spark, sf_dir, "conversations")
    sub = F.concat(F.lit("sub"), (F.col("conv_id") % 7).cast("string"))
    return c.where(F.col("role") != "system").select(
        F.concat(F.lit("/r/"), sub, F.lit("/comments/"), F.col("conv_id").cast("string"), F.lit("/")).alias("permalink"),
        F.col("turn").cast("int").alias("pos"),
        F.col("text"),
    )


def note_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored-note facts from ``documents`` left join ``labels``: status (no
    label inbox, toxic queued, quality reacted, else archived), folder,
    community-style URL for English documents, a date, a title line."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    status = (F.when(F.col("quality").isNull(), F.lit("inbox"))
              .when(F.col("toxic") == 1, F.lit("queued"))
              .when(F.col("quality") == 1, F.lit("reacted"))
              .otherwise(F.lit("archived")))
    url = (F.when(F.col("lang") == "en",
                  F.concat(F.lit("https://www.reddit.com/r/"), F.col("source"), F.lit("/comments/"),
                           F.col("doc_id").cast("string"), F.lit("/")))
           .otherwise(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/a/"), F.col("doc_id").cast("string"))))
    title = F.regexp_extract("text", r"^([^\n]*)", 1)
    date = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("doc_id") % 500).cast("int")).cast("string")
    folder = F.when(status == "archived", F.lit("Archived")).otherwise(F.lit("Observation Inbox"))
    return j.select("doc_id", "source", "lang", "text", status.alias("status"), url.alias("source_url"),
                    title.alias("title"), date.alias("date"), folder.alias("folder"))


def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown note files (path, value) built from ``note_rows``."""
    r = note_rows(spark, sf_dir)
    value = F.concat(
        F.lit("---\n"),
        F.lit("title: "), F.col("title"), F.lit("\n"),
        F.lit("date: "), F.col("date"), F.lit("\n"),
        F.lit("source: "), F.col("source"), F.lit("\n"),
        F.lit("source_url: "), F.col("source_url"), F.lit("\n"),
        F.lit("tags: ["), F.col("lang"), F.lit(", "), F.col("source"), F.lit("]\n"),
        F.lit("observation: \""), F.col("title"), F.lit("\"\n"),
        F.lit("interest_level: "), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("\n"),
        F.lit("lenses: [NATION_"), (F.col("doc_id") % 25).cast("string"), F.lit("]\n"),
        F.lit("status: "), F.col("status"), F.lit("\n"),
        F.lit("notes: \"\"\n"),
        F.lit("---\n\n## Observation\n\n"), F.col("text"),
        F.lit("\n\n**Source:** ["), F.col("source"), F.lit("]("), F.col("source_url"), F.lit(")\n\n## Questions\n"),
    )
    return r.select(
        F.concat(F.lit("/vault/"), F.col("folder"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        value.alias("value"),
    )


def lens_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lens files (path, value) from ``nation``: name = n_name, one heading,
    a two-sentence description."""
    n = table(spark, sf_dir, "nation")
    value = F.concat(
        F.lit("---\nname: "), F.col("n_name"), F.lit("\n---\n# "), F.col("n_name"),
        F.lit("\nReads an item through region "), F.col("n_regionkey").cast("string"),
        F.lit(". Asks who gains!\n"))
    return n.select(
        F.concat(F.lit("/vault/lenses/"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.lit(".md")).alias("path"),
        value.alias("value"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched responses (url, attempt, status, body) from ``pages``: the status
    cycles through 429 / 503 / 403 / 200 by page_id; a 200 body is either the
    page (an HTML challenge) or a small feed document."""
    p = table(spark, sf_dir, "pages")
    status = (F.when(F.col("page_id") % 10 == 0, F.lit(429))
              .when(F.col("page_id") % 10 == 1, F.lit(503))
              .when(F.col("page_id") % 10 == 2, F.lit(403))
              .otherwise(F.lit(200)))
    body = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(
        F.concat(F.lit('  <?xml version="1.0"?><feed><title>'),
                 F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("</title></feed>")))
    return p.select("url", (F.col("page_id") % 4).cast("int").alias("attempt"), status.alias("status"), body.alias("body"))


def chart_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart pages (url, genre, slug, html) from ``pages``. Odd pages lose their
    list items and carry the tracks as an embedded JSON blob instead."""
    p = table(spark, sf_dir, "pages")
    items = F.regexp_extract_all("html", F.lit(r'<li><a href="/([^"]*)">([^<]*)</a></li>'), 2)
    paths = F.regexp_extract_all("html", F.lit(r'<li><a href="/([^"]*)">([^<]*)</a></li>'), 1)
    tracks = F.to_json(F.transform(F.arrays_zip(paths.alias("a"), items.alias("t")),
                                   lambda z: F.struct(z["t"].alias("name"),
                                                      F.array(F.struct(z["a"].alias("name"))).alias("artists"))))
    blob = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"chart":{"tracks":'),
                    tracks, F.lit("}}}}</script>"))
    odd = F.col("page_id") % 2 == 1
    html = F.when(odd, F.concat(F.regexp_replace("html", "<li>", "<span>"), blob)).otherwise(F.col("html"))
    genre = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return p.select(F.col("url"), genre.alias("genre"),
                    F.regexp_replace(genre, r"[^a-z0-9]+", "-").alias("slug"),
                    F.col("page_id").cast("int").alias("ord"), html.alias("html"))


def marked_chart_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chart_pages`` whose list items are rows marked by class: double-quoted,
    single-quoted behind an attribute with ``>``, or unquoted, by page; each holds
    an artist, a title with a nested element of its own tag, and a list of its own."""
    p = table(spark, sf_dir, "pages")
    names = F.regexp_extract_all("html", F.lit(r'<li><a href="/([^"]*)">([^<]*)</a></li>'), 2)
    paths = F.regexp_extract_all("html", F.lit(r'<li><a href="/([^"]*)">([^<]*)</a></li>'), 1)
    start = (F.when(F.col("page_id") % 3 == 0, F.lit('<li class="bucket-item track">'))
             .when(F.col("page_id") % 3 == 1, F.lit("<li data-of='a>b' class='x bucket-item'>")).otherwise(F.lit("<LI class=bucket-item>")))
    row = F.transform(F.arrays_zip(names.alias("n"), paths.alias("p")), lambda z: F.concat(
        start, F.lit("<ul><li>1</li></ul><!-- <li class=track> --><span class=artists>"), z["p"],
        F.lit("</span><div class='title'><div><b>"), z["n"], F.lit("</b></div> <div>mix</div></div></li>\n")))
    html = F.concat(F.lit("<html><script>'<li class=\"track\">'</script><ol>"), F.array_join(row, ""), F.lit("</ol></html>"))
    genre = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return p.select("url", genre.alias("genre"), F.regexp_replace(genre, r"[^a-z0-9]+", "-").alias("slug"),
                    F.col("page_id").cast("int").alias("ord"), html.alias("html"))


def alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases: the distinct words of seven or more letters in the documents."""
    words = F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")))
    return table(spark, sf_dir, "documents").select(words.alias("alias")).where("length(alias) >= 7").distinct()


# Patterns that find artist and title inside the stand-in chart rows
# (<li><a href="/artist">title</a></li>).
CHART_ROW = r"<li>(.*?)</li>"
CHART_ARTIST = r'href="/([^"]*)"'
CHART_TITLE = r">([^<]*)</a>"


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed RSS files (path, value, feed, feed_ord) from ``pages``: one file per
    page, one entry per list item, with CDATA titles, entries named inside CDATA
    and a comment, and every fifth entry (by page and position) broken."""
    p = table(spark, sf_dir, "pages")
    names = F.regexp_extract_all("html", F.lit(r'<li><a href="/([^"]*)">([^<]*)</a></li>'), 2)

    def entry(name, i):
        link = F.concat(F.col("url"), F.lit("#"), i.cast("string"))
        good = F.concat(F.lit("<item><title><![CDATA["), name, F.lit("]]></title><link>"), F.replace(link, F.lit("&"), F.lit("&amp;")),
                        F.lit("</link><description><![CDATA[<item>no entry</item>]]></description></item><!-- <item> -->\n"))
        return F.when((F.col("page_id") + i) % 5 == 3, F.concat(F.lit("<item><title>"), name, F.lit(" & <b></title></item>\n"))).otherwise(good)

    value = F.concat(F.lit('<?xml version="1.0"?>\n<rss version="2.0"><channel><title>F</title>\n'),
                     F.array_join(F.transform(names, entry), ""), F.lit("</channel></rss>\n"))
    return p.select(F.concat(F.lit("/landing/"), F.col("page_id").cast("string"), F.lit(".xml")).alias("path"), value.alias("value"),
                    F.col("page_id").cast("string").alias("feed"), F.lit(0).alias("feed_ord"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source registry rows (adapter, name, slug, url, enabled) from ``pages``:
    one per page URL; every fourth is disabled, every seventh has no URL."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return p.select(
        F.lit("rss").alias("adapter"),
        host.alias("name"),
        F.col("page_id").cast("string").alias("slug"),
        F.when(F.col("page_id") % 7 == 3, F.lit("")).otherwise(F.col("url")).alias("url"),
        (F.col("page_id") % 4 != 1).alias("enabled"),
    )


def known_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Already-stored URLs: the pages whose id has a label row."""
    p = table(spark, sf_dir, "pages")
    lab = table(spark, sf_dir, "labels")
    return p.join(lab.select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select(
        F.col("url").alias("source_url"))


# Title keywords used as the interest taxonomy on the test tables (frequent
# short words of the generated prose).
TAXONOMY = ("the", "and", "des", "der", "que")


def community_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community feed entries (Atom shape) from the listing stand-in: content
    carries a ``[comments]`` anchor to the post and, unless the post has no
    link, a ``[link]`` anchor (a community page for self posts, an outside
    story otherwise); categories = [community, flair]."""
    c = listing_children(spark, sf_dir)
    link = F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))
    target = (F.when(F.col("domain").startswith("self."),
                     F.concat(F.lit("https://old.reddit.com/r/"), F.col("community"), F.lit("/")))
              .when(F.col("domain") != "", F.concat(F.lit("https://"), F.col("domain"), F.lit("/story/"),
                                                     F.col("rank").cast("string"))))
    content = F.concat(
        F.lit('<div><a href="'), link, F.lit('">[comments]</a>'),
        F.coalesce(F.concat(F.lit(' <a href="'), target, F.lit('">[link]</a>')), F.lit("")),
        F.lit("<p>"), F.col("selftext"), F.lit("</p></div>"))
    return c.select(
        F.col("community").alias("feed"),
        F.substring("community", 4, 3).cast("int").alias("feed_ord"),
        F.col("rank").cast("int").alias("pos"),
        link.alias("link"),
        F.col("title"),
        F.lit("").alias("summary"),
        content.alias("content"),
        F.date_format(F.col("created_utc").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("published"),
        F.lit(None).cast("string").alias("updated"),
        F.lit(None).cast("string").alias("author"),
        F.array(F.col("community"), F.col("link_flair_text")).alias("categories"),
    )


# ---------------------------------------------------------------- model stand-ins
# The model is an external service. For the test tables it is replaced by a
# deterministic backend whose reply depends only on the length n of the
# prompt's title field, cycling through well-formed, fenced, broken,
# list-shaped, string-number, null, out-of-range and failing replies so that
# every parsing branch of the library runs. The oracles reproduce the same
# verdicts from the same title lengths.

import json as _json  # noqa: E402

from .operators.infer import Backend  # noqa: E402

def prompt_title(user: str) -> str:
    """Title of the item, which is the JSON object on the prompt's last line."""
    return _json.loads(user.rstrip("\n").rsplit("\n", 1)[-1]).get("title", "")


def gate_reply(n: int) -> str:
    """Triage reply for title length ``n`` (raises for one residue)."""
    r, s = n % 13, n % 6
    lens = f"NATION_{n % 25}"
    if r == 0:
        raise RuntimeError("model unavailable")
    if r == 1:
        return "```json\n" + _json.dumps({"reaction_worthiness": s, "best_lens": lens, "why": "fenced"}) + "\n```"
    if r == 2:
        return '{"reaction_worthiness": '
    if r == 3:
        return f"[{s}]"
    if r == 4:
        return _json.dumps({"reaction_worthiness": str(s), "best_lens": lens})
    if r == 5:
        return _json.dumps({"reaction_worthiness": f"{s}.5"})
    if r == 6:
        return '{"reaction_worthiness": %d.7, "why": "float"}' % s
    if r == 7:
        return _json.dumps({"best_lens": lens})
    if r == 8:
        return '{"reaction_worthiness": null}'
    if r == 9:
        return '{"reaction_worthiness": 9, "why": "over"}'
    if r == 10:
        return '{"reaction_worthiness": -2}'
    if r == 11:
        return "null"
    return _json.dumps({"reaction_worthiness": s, "best_lens": lens, "why": "plain"})


def enrich_reply(m: int) -> str:
    """Enrichment reply for title length ``m`` (raises for one residue)."""
    r = m % 9
    a, b = f"NATION_{m % 25}", f"NATION_{(m + 1) % 25}"
    full = {
        "observation": f"Item of length {m}.",
        "tags": [f"len-{m % 5}", " Techno Mixing ", "", "bandcamp"],
        "interest_level": m % 6,
        "lenses": [a, {"name": b}],
        "questions": {a: ["Who gains?", "Why now?"], b: []},
        "expanded_context": "First point here. Second point!",
        "claims": [] if m % 2 == 0 else [f"Claim {m}."],
        "entities": [f"E{m % 3}"],
        "time_sensitivity": "" if m % 2 == 0 else "medium",
    }
    if r == 0:
        raise RuntimeError("backend timeout")
    if r == 1:
        return "```json\n" + _json.dumps(full) + "\n```"
    if r == 2:
        return "Sorry, no JSON today."
    if r == 3:
        return "[1, 2]"
    if r == 4:
        return _json.dumps({**full, "observation": None})
    if r == 5:
        return _json.dumps({**full, "interest_level": "high"})
    if r == 6:
        return _json.dumps({**full, "interest_level": 7, "lenses": [{"name": a}, {"lens": b}]})
    if r == 7:
        d = {k: v for k, v in full.items() if k not in ("interest_level", "observation")}
        d["lenses"] = [a.lower(), {"title": b}]
        return _json.dumps(d)
    return _json.dumps({**full, "interest_level": "4", "lenses": [{"x": 1}, 7]})


class TitleRuleModel(Backend):
    """Deterministic stand-in backend (``kind`` = "gate" or "enrich")."""

    def __init__(self, kind: str = "gate", name: str = "rule-model"):
        self.kind = kind
        self.name = name

    def generate(self, system: str, user: str) -> str:
        n = len(prompt_title(user))
        return gate_reply(n) if self.kind == "gate" else enrich_reply(n)


class DownModel(Backend):
    """A backend that is never available (exercises the fallback path)."""

    name = "down"

    def available(self) -> bool:
        return False


def gate_backends():
    return [DownModel(), TitleRuleModel("gate")]


def enrich_backends():
    return [DownModel(), TitleRuleModel("enrich")]


# Title keywords for the listing stand-in (its titles are event-type words).
LISTING_TAXONOMY = ("view", "purchase", "signup", "user 1")
