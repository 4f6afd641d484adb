"""Article metadata block (P20-P22) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, empty_str_array, let, lit_of
from .dates import time_sensitivity
from .text import clean_list, sentences, strip_ws

# These must equal the reference's for the same results.
# Relevance taxonomy, in order.
RELEVANCE_TAXONOMY = (
    "dj_culture", "music_production", "music_business", "artist_identity",
    "club_culture", "rave_history", "technology", "platform_economics",
    "promotion", "event_operations", "label_operations",
)
# Topic alias -> taxonomy value, in order (order decides the substring pass).
TAXONOMY_ALIASES = (
    ("dj", "dj_culture"), ("djing", "dj_culture"), ("mixing", "dj_culture"),
    ("dancefloor", "club_culture"), ("club", "club_culture"), ("rave", "rave_history"),
    ("production", "music_production"), ("producer", "music_production"),
    ("technology", "technology"), ("tech", "technology"), ("software", "technology"),
    ("bandcamp", "platform_economics"), ("streaming", "platform_economics"),
    ("platform", "platform_economics"), ("label", "label_operations"),
    ("release", "promotion"), ("marketing", "promotion"), ("booking", "event_operations"),
    ("artist", "artist_identity"), ("identity", "artist_identity"),
)
DEFAULT_RELEVANCE = "music_production"


def _alias_map(aliases) -> Column:
    return F.create_map(*[x for k, v in aliases for x in (F.lit(k), F.lit(v))])


_SEP = "\u0001"


def derive_relevance(topics, aliases=TAXONOMY_ALIASES, taxonomy=RELEVANCE_TAXONOMY,
                     default: str = DEFAULT_RELEVANCE, mode: str = "substring") -> Column:
    """Direct alias per topic (``-`` read as space; unknown topics stay as
    they are), then every alias found in the joined topic text, in alias
    order; keep taxonomy values, distinct in order; ``[default]`` if none.

    ``mode="substring"`` matches aliases anywhere in the text (so ``tech``
    hits ``techno``), as the reference does; ``mode="token"`` matches whole
    words only.
    """
    return relevance_by_mode(topics, aliases, taxonomy, default, (mode,))[mode]


def relevance_by_mode(topics, aliases=TAXONOMY_ALIASES, taxonomy=RELEVANCE_TAXONOMY,
                      default: str = DEFAULT_RELEVANCE, modes=("substring", "token")) -> Column:
    """``derive_relevance`` in several modes at once, a struct with a field per mode.

    The topics are joined and lower-cased once, every alias is looked for with one
    plain substring search, and only for those found is it asked whether one is a
    whole topic (and where) or a whole word; no pattern runs over the text.
    """
    aliases, known = [(k, v) for k, v in aliases], set(taxonomy)
    amap = _alias_map(aliases)
    itself = {k for k, v in dict(aliases).items() if k == v}
    # Topics that are taxonomy values as they stand count too, unless they are aliases of themselves.
    bare = [x for x in taxonomy if x not in itself]
    tax = F.array(*[F.lit(x) for x in taxonomy]).cast("array<string>")

    def hit(k, v, blob, framed, words):
        """(value, place of the first topic that is the alias, whether in the text, whether a word of it)."""
        whole = F.lit(f"{_SEP}{k}{_SEP}")
        inside = F.contains(blob, F.lit(k))
        # An alias with a space may be a topic written with "-", which the text does not contain as it is.
        maybe = inside | F.contains(framed, whole) if " " in k else inside
        return F.when(maybe, F.struct(
            F.lit(v).alias("v"), F.when(F.contains(framed, whole), F.locate(f"{_SEP}{k}{_SEP}", framed)).alias("at"),
            inside.alias("substring"), F.contains(words(), F.lit(f" {k} ")).alias("token")))

    def of_text(t):
        def with_low(low):
            blob = F.replace(low, F.lit(_SEP), F.lit(" "))
            framed = F.concat(F.lit(_SEP), F.replace(low, F.lit("-"), F.lit(" ")), F.lit(_SEP))
            return let(F.struct(blob.alias("blob"), framed.alias("framed")), lambda b: with_hits(low, b["blob"], F.array_compact(
                F.array(*[hit(k, v, b["blob"], b["framed"], lambda: F.concat(
                    F.lit(" "), F.regexp_replace(b["blob"], r"(?U)\s+", " "), F.lit(" "))) for k, v in aliases if v in known]))))

        def with_hits(low, blob, hits):
            by_place = lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)
            mixed = F.filter(F.transform(t, lambda x: F.coalesce(F.try_element_at(amap, F.replace(F.lower(x), F.lit("-"), F.lit(" "))), x)),
                             lambda x: F.array_contains(tax, x))
            some_bare = F.lit(False)
            for x in bare:
                some_bare = some_bare | F.contains(low, F.lit(x.lower()))

            def by_mode(h):
                values = lambda rows: F.transform(rows, lambda r: r["v"])
                # Rare: a taxonomy value among the topics, so each topic is looked at in order.
                direct = F.when(some_bare, mixed).otherwise(values(F.array_sort(F.filter(h, lambda r: r["at"].isNotNull()), by_place)))
                return let(direct, lambda d: F.struct(*[_or_default(F.array_distinct(F.concat(d, values(F.filter(h, lambda r: r[m])))),
                                                                    default).alias(m) for m in modes]))

            return let(hits, by_mode)

        return let(F.lower(F.array_join(t, _SEP)), with_low)

    return let(F.coalesce(col_of(topics), empty_str_array()), of_text)


def _or_default(values: Column, default: str) -> Column:
    return let(values, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(F.lit(default))))


def _truthy_str(c) -> Column:
    c = col_of(c)
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def _truthy_arr(c) -> Column:
    c = col_of(c)
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c)


def first_truthy_str(*cols) -> Column:
    """Python ``a or b or ''`` for strings: NULL and '' count as missing."""
    return F.coalesce(*[_truthy_str(c) for c in cols], F.lit(""))


def first_truthy_arr(*cols) -> Column:
    """Python ``a or b or []`` for lists: NULL and [] count as missing."""
    return F.coalesce(*[_truthy_arr(c) for c in cols], empty_str_array())


def build_metadata(*, as_of, note_id=None, title=None, source=None, source_url=None,
                   published_date=None, author=None, raw_tags=None,
                   p_title=None, p_observation=None, p_expanded_context=None, p_claims=None,
                   p_topics=None, p_tags=None, p_entities=None, p_time_sensitivity=None,
                   aliases=TAXONOMY_ALIASES, taxonomy=RELEVANCE_TAXONOMY) -> Column:
    """The 12-field metadata struct from source facts (plain args) and
    model output (``p_`` args). Arguments are column names or Columns; None
    means absent. "Missing" follows Python truthiness: NULL, '' and [] fall
    through to the next choice.
    """
    def c(x, kind="s"):
        if x is None:
            return F.lit(None).cast("string" if kind == "s" else "array<string>")
        return lit_of(x) if not isinstance(x, str) else F.col(x)

    pub_date = strip_ws(first_truthy_str(c(published_date)))
    context = strip_ws(first_truthy_str(c(p_expanded_context)))
    claims = let(clean_list(c(p_claims, "a")),
                 lambda cl: F.when(F.size(cl) > 0, cl).otherwise(sentences(context)))
    topics_in = let(clean_list(c(p_topics, "a")), lambda tp: F.when(F.size(tp) > 0, tp).otherwise(
        clean_list(first_truthy_arr(c(p_tags, "a"), c(raw_tags, "a")))))
    ts = first_truthy_str(c(p_time_sensitivity))
    # bind the values used more than once
    return let(F.struct(topics_in.alias("topics"), pub_date.alias("pub_date")), lambda b: _meta_struct(
        b["topics"], b["pub_date"], claims, ts, c, note_id, title, p_title, source, source_url, author,
        p_entities, p_observation, aliases, taxonomy, as_of))


def _meta_struct(topics, pub_date, claims, ts, c, note_id, title, p_title, source, source_url, author,
                 p_entities, p_observation, aliases, taxonomy, as_of) -> Column:
    return F.struct(
        strip_ws(first_truthy_str(c(note_id))).alias("note_id"),
        strip_ws(first_truthy_str(c(title), c(p_title))).alias("title"),
        strip_ws(first_truthy_str(c(source))).alias("publication"),
        pub_date.alias("publication_date"),
        strip_ws(first_truthy_str(c(source_url))).alias("source_url"),
        strip_ws(first_truthy_str(c(author))).alias("author"),
        topics.alias("topics"),
        clean_list(c(p_entities, "a")).alias("entities"),
        strip_ws(first_truthy_str(c(p_observation), c(title))).alias("summary"),
        claims.alias("claims"),
        derive_relevance(topics, aliases, taxonomy).alias("relevance"),
        let(ts, lambda t: F.when(t != "", t).otherwise(time_sensitivity(pub_date, as_of))).alias("time_sensitivity"),
    )
