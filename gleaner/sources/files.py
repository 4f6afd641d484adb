"""Scans of landed files (S1, S3, S6, S7, S10). Fixed schemas, no inference.

Feeds: each file is read whole and cut into its entries (outside CDATA sections
and comments), and each entry is parsed on its own with ``from_xml``: positions are
kept (``posexplode``), and an entry that does not parse goes to quarantine with its
position while the others of its file continue, as other files do (fail open).
Listings: multi-line JSON with an explicit schema, children exploded with
their position. Notes and lenses: whole-text reads with the file path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()

RSS_ITEM = T.StructType([
    T.StructField("title", _S), T.StructField("link", _S), T.StructField("description", _S),
    T.StructField("content:encoded", _S), T.StructField("pubDate", _S), T.StructField("updated", _S),
    T.StructField("author", _S), T.StructField("dc:creator", _S),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_VALUE", _S), T.StructField("_domain", _S)]))),
])
ATOM_ENTRY = T.StructType([
    T.StructField("title", _S),
    T.StructField("link", T.ArrayType(T.StructType([T.StructField("_href", _S), T.StructField("_rel", _S)]))),
    T.StructField("id", _S), T.StructField("published", _S), T.StructField("updated", _S),
    T.StructField("author", T.StructType([T.StructField("name", _S)])),
    T.StructField("content", T.StructType([T.StructField("_VALUE", _S), T.StructField("_type", _S)])),
    T.StructField("summary", _S),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", _S)]))),
])
LISTING_CHILD = T.StructType([
    T.StructField("permalink", _S), T.StructField("title", _S), T.StructField("selftext", _S),
    T.StructField("score", T.LongType()), T.StructField("num_comments", T.LongType()),
    T.StructField("upvote_ratio", T.DoubleType()), T.StructField("created_utc", T.DoubleType()),
    T.StructField("link_flair_text", _S), T.StructField("stickied", T.BooleanType()),
    T.StructField("is_self", T.BooleanType()), T.StructField("is_video", T.BooleanType()),
    T.StructField("domain", _S),
])
LISTING_DOC = T.StructType([T.StructField("data", T.StructType([
    T.StructField("children", T.ArrayType(T.StructType([T.StructField("data", LISTING_CHILD)])))]))])


def read_whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, value) for every file under ``path`` (recursive)."""
    # text()'s own wholetext keyword defaults to False and wins over options
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))


def _file_stem(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


#: Stands for ``<`` inside CDATA while entries are cut; no XML text may hold it.
_MASK = "\u0002"
_BAD = "__bad"


def entry_texts(c, tag: str) -> Column:
    """The ``<tag>`` elements of a feed's text, in order. A start or end tag inside
    a CDATA section or a comment is none; an entry that is not closed ends where
    the next one starts. Comments are left out."""
    pieces = F.regexp_extract_all(c, F.lit(r"(?s)<!\[CDATA\[.*?(?:\]\]>|\z)|<!--.*?(?:-->|\z)|<|[^<]+"), 0)
    shown = F.transform(pieces, lambda p: F.when(p.startswith("<!--"), F.lit(""))
                        .when(p.startswith("<![CDATA["), F.concat(F.lit("<"), F.translate(F.substr(p, F.lit(2)), "<", _MASK)))
                        .otherwise(p))
    # The section's own "<" is masked too, so that only tags are left to cut at.
    masked = F.replace(F.array_join(shown, ""), F.lit("<![CDATA["), F.lit(_MASK + "![CDATA["))
    found = F.regexp_extract_all(masked, F.lit(rf"(?s)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|(?=<{tag}\b)|\z)"), 0)
    return F.transform(found, lambda e: F.replace(e, F.lit(_MASK), F.lit("<")))


def parse_feed_files(files: DataFrame, kind: str = "rss") -> tuple[DataFrame, DataFrame]:
    """(entries, bad) from (path, value, feed, feed_ord) rows.

    ``kind`` is ``rss`` (``<rss><channel><item>``) or ``atom``
    (``<feed><entry>``). Entries carry their position in the file, broken ones
    counted. ``bad`` (path, error_kind, pos, payload) has the entries that do not
    parse (``unparsable_entry``) and, with a null ``pos``, the files that hold no
    entry and are no whole feed either (``unparsable_feed``).
    """
    tag, root, fields = ("item", "rss", RSS_ITEM) if kind == "rss" else ("entry", "feed", ATOM_ENTRY)
    cut = files.withColumn("__entries", entry_texts(F.col("value"), tag))
    whole = F.coalesce(F.col("value"), F.lit("")).rlike(rf"(?s)<{root}\b.*</{root}\s*>\s*\z")
    bad_files = cut.where((F.coalesce(F.size("__entries"), F.lit(0)) == 0) & ~whole).select(
        "path", F.lit("unparsable_feed").alias("error_kind"), F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("string").alias("payload"))
    schema = T.StructType([*fields.fields, T.StructField(_BAD, _S)])
    options = {"mode": "PERMISSIVE", "rowTag": tag, "columnNameOfCorruptRecord": _BAD}
    e = cut.select("path", "feed", "feed_ord", F.posexplode("__entries").alias("pos", "__text"))
    # An entry without its end tag is read leniently by the parser; it is broken all the same.
    e = e.withColumn("e", F.from_xml(F.col("__text"), schema, options))
    broken = F.col("e").isNull() | F.col("e").getField(_BAD).isNotNull() | ~F.col("__text").rlike(rf"</{tag}\s*>\z")
    bad_entries = e.where(broken).select("path", F.lit("unparsable_entry").alias("error_kind"), F.col("pos").cast("int").alias("pos"),
                                         F.col("__text").alias("payload"))
    e = e.where(~broken)
    if kind == "rss":
        out = e.select(
            "feed", "feed_ord", F.col("pos").cast("int").alias("pos"),
            F.col("e.link").alias("link"), F.col("e.title").alias("title"),
            F.col("e.description").alias("summary"), F.col("e").getField("content:encoded").alias("content"),
            F.col("e.pubDate").alias("published"), F.col("e.updated").alias("updated"),
            F.coalesce(F.col("e.author"), F.col("e").getField("dc:creator")).alias("author"),
            F.transform(F.col("e.category"), lambda c: c["_VALUE"]).alias("categories"))
    else:
        alt = F.filter(F.col("e.link"), lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")
        out = e.select(
            "feed", "feed_ord", F.col("pos").cast("int").alias("pos"),
            F.get(alt, 0)["_href"].alias("link"), F.col("e.title").alias("title"),
            F.col("e.summary").alias("summary"), F.col("e.content._VALUE").alias("content"),
            F.col("e.published").alias("published"), F.col("e.updated").alias("updated"),
            F.col("e.author.name").alias("author"),
            F.transform(F.col("e.category"), lambda c: c["_term"]).alias("categories"))
    return out, bad_files.unionByName(bad_entries)


def read_feeds(spark: SparkSession, path: str, registry: DataFrame | None = None, kind: str = "rss",
               glob: str = "*.xml") -> tuple[DataFrame, DataFrame]:
    """Landed feed files -> entries. The feed name is the file stem; with
    a registry (name, ord) the ordinal comes from it, else 0."""
    files = read_whole_files(spark, path, glob).withColumn("feed", _file_stem(F.col("path")))
    if registry is not None:
        files = files.join(registry.select(F.col("name").alias("feed"), F.col("ord").alias("feed_ord")), "feed", "left")
    else:
        files = files.withColumn("feed_ord", F.lit(0))
    return parse_feed_files(files, kind)


def read_listings(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """S3 scan: listing JSON files -> children with ``community`` (file stem)
    and ``rank`` (position); feed into ``operators.items.listing_items``."""
    df = (spark.read.schema(LISTING_DOC).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("pathGlobFilter", glob).json(path))
    df = df.select(_file_stem(F.col("_metadata.file_path")).alias("community"),
                   F.posexplode("data.children").alias("rank", "c"))
    return df.where(F.col("c.data").isNotNull()).select("community", F.col("rank").cast("long").alias("rank"), "c.data.*")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.md`` under the vault root as (path, value)."""
    return read_whole_files(spark, root, "*.md")


def read_lenses(spark: SparkSession, lens_dir: str) -> DataFrame:
    """S7 scan: lens files as (path, value); see ``operators.lenses``."""
    return read_whole_files(spark, lens_dir, "*.md")
