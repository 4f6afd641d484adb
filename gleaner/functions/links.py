"""Tags and link metadata of feed entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, empty_str_array, get0
from .text import host_of

_HREF = r'href="([^"]+)"'


def feed_tags(categories) -> Column:
    """P5, feed form: the non-empty category terms, in order."""
    return F.coalesce(F.filter(col_of(categories), lambda t: F.coalesce(t, F.lit("")) != ""),
                      empty_str_array())


def first_flair(community, categories) -> Column:
    """The first non-empty category term that is not the community name
    (case-insensitive), as written; '' when there is none."""
    sub = F.lower(F.coalesce(col_of(community), F.lit("")))
    terms = F.filter(F.coalesce(col_of(categories), empty_str_array()),
                     lambda t: (F.coalesce(t, F.lit("")) != "") & (F.lower(t) != sub))
    return F.coalesce(get0(terms), F.lit(""))


def community_tags(community, categories) -> Column:
    """P5, community form: [community] + first flair, lower-cased, spaces to '-'."""
    flair = first_flair(community, categories)
    extra = F.when(flair != "", F.array(F.replace(F.lower(flair), F.lit(" "), F.lit("-")))) \
        .otherwise(empty_str_array())
    return F.concat(F.array(col_of(community)), extra)


def listing_tags(community, flair) -> Column:
    """P5, listing form: [community] + flair lower-cased, spaces to '-'."""
    f = F.coalesce(col_of(flair), F.lit(""))
    extra = F.when(f != "", F.array(F.replace(F.lower(f), F.lit(" "), F.lit("-")))) \
        .otherwise(empty_str_array())
    return F.concat(F.array(col_of(community)), extra)


def link_meta(html, self_host_marker: str = "reddit.com") -> Column:
    """struct(is_self, domain) from the first href that is not a
    ``/comments/`` link and has a host: own host -> (true, ''), another host ->
    (false, host); none -> (NULL, '')."""
    hrefs = F.regexp_extract_all(F.coalesce(col_of(html), F.lit("")), F.lit(_HREF), 1)
    cand = F.filter(F.transform(hrefs, lambda h: F.struct(h.alias("h"), host_of(h).alias("host"))),
                    lambda x: (F.instr(x["h"], "/comments/") == 0) & (x["host"] != ""))
    first = get0(cand)
    own = F.instr(first["host"], self_host_marker) > 0
    return F.struct(
        F.when(first.isNull(), F.lit(None).cast("boolean")).otherwise(own).alias("is_self"),
        F.when(first.isNull() | own, F.lit("")).otherwise(first["host"]).alias("domain"),
    )
