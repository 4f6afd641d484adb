"""Text column expressions. All are JVM-side (codegen), no Python per row.

Regex notes: Java's ``\\s`` is ASCII-only, so ``(?U)`` is used wherever the
reference relies on Python's Unicode whitespace. Python's ``str.strip()`` strips
any Unicode whitespace, Spark's ``trim`` only spaces; ``strip_ws`` covers that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, lit_of


# The characters Python's ``str.strip()`` takes off.
_WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace. A trim
    looks at the ends only; a pattern would walk through the whole text."""
    return F.btrim(col_of(c), F.lit(_WHITE))


def squash_ws(c) -> Column:
    """Python ``" ".join(s.split())``: collapse whitespace runs, strip ends."""
    return F.trim(F.regexp_replace(col_of(c), r"(?U)\s+", " "))


def strip_html(c, n: int | None = None) -> Column:
    """Tags to a space, collapse whitespace, cut to ``n`` characters."""
    out = squash_ws(F.regexp_replace(F.coalesce(col_of(c), F.lit("")), "<[^>]+>", " "))
    return truncate(out, n) if n is not None else out


def truncate(c, n: int) -> Column:
    """First ``n`` characters (code points, as Python slicing)."""
    return F.substring(col_of(c), 1, n)


def nonblank(c) -> Column:
    """NULL when the value is NULL or the empty string (Python falsy string)."""
    c = col_of(c)
    return F.when(c != "", c)


def pick_body(*cols, default=None) -> Column:
    """The first non-empty of ``cols``, else ``default``.

    RSS passes (summary, content); community feeds pass (content, summary) with
    default ``concat('Posted in r/', sub, '.')`` applied after stripping.
    """
    parts = [nonblank(c) for c in cols]
    if default is not None:
        parts.append(lit_of(default))
    return F.coalesce(*parts)


def slugify(c) -> Column:
    """Lower, runs of non ``[a-z0-9]`` to ``-``, trim ``-``, default ``src``."""
    s = F.regexp_replace(F.lower(F.coalesce(col_of(c), F.lit(""))), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("src")).otherwise(s)


def note_id(date_col, source_col, url_col) -> Column:
    """``{date}-{slug[:8]}-{md5(url)[:4]}``."""
    return F.concat_ws(
        "-",
        col_of(date_col).cast("string"),
        F.substring(slugify(source_col), 1, 8),
        F.substring(F.md5(F.coalesce(col_of(url_col), F.lit(""))), 1, 4),
    )


def yaml_quote(c) -> Column:
    """P10: blank -> ``""``; drop CR, LF -> space, strip, escape, double-quote."""
    c = col_of(c)
    v = strip_ws(F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")))
    v = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit('""')).otherwise(F.concat(F.lit('"'), v, F.lit('"')))


def clean_list(arr) -> Column:
    """Strip items, drop blanks; NULL (not a list) -> ``[]``.

    A NULL element is kept as the text ``None`` (what ``str(None)`` gives).
    """
    a = col_of(arr)
    items = F.transform(a, lambda x: strip_ws(F.coalesce(x.cast("string"), F.lit("None"))))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


def sentences(c) -> Column:
    """Split after ``.``/``!``/``?`` plus whitespace; strip; drop blanks."""
    parts = F.split(F.coalesce(col_of(c), F.lit("")), r"(?<=[.!?])(?U)\s+")
    return F.filter(F.transform(parts, strip_ws), lambda x: x != "")


def observation_text(body) -> Column:
    """Text after the first ``## Observation``, before ``**Source:**`` and
    ``## Questions``, stripped."""
    b = F.coalesce(col_of(body), F.lit(""))
    marker = "## Observation"
    pos = F.instr(b, marker)
    after = F.when(pos > 0, F.substr(b, pos + F.lit(len(marker)))).otherwise(b)
    after = F.substring_index(after, "**Source:**", 1)
    after = F.substring_index(after, "## Questions", 1)
    return strip_ws(after)


def first_sentence(body) -> Column:
    """P25: drop Markdown heading lines, strip, first ``[^.!?]+[.!?]``."""
    b = F.regexp_replace(F.coalesce(col_of(body), F.lit("")), r"(?md)^#+.*$", "")
    return strip_ws(F.regexp_extract(strip_ws(b), r"^([^.!?]+[.!?])", 1))


def url_segment(url, pattern: str = r"reddit\.com/r/([^/]+)/", marker: str | None = "reddit.com/r/") -> Column:
    """First capture of ``pattern`` in the URL, '' when absent.

    The default is the community name of a community URL (only when a slash
    follows the name).
    """
    u = F.coalesce(col_of(url), F.lit(""))
    got = F.regexp_extract(u, pattern, 1)
    if marker is not None:
        got = F.when(F.instr(u, marker) > 0, got).otherwise(F.lit(""))
    return got


def host_of(url) -> Column:
    """Lower-cased network location (host[:port]) of an absolute or
    scheme-relative URL; '' when there is none (as ``urlparse().netloc``)."""
    return F.lower(F.regexp_extract(F.coalesce(col_of(url), F.lit("")),
                                    r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1))


def contains_any(c, needles) -> Column:
    """Case-insensitive substring match against a list of needles."""
    arr = needles if isinstance(needles, Column) else F.array(*[F.lit(str(n).lower()) for n in needles])
    low = F.lower(F.coalesce(col_of(c), F.lit("")))
    return F.exists(arr, lambda d: F.instr(low, d) > 0)


def url_prefix_key(url, segments: int = 1) -> Column:
    """Dedup key of a URL: lower-cased host plus the first ``segments`` path
    segments (query and fragment dropped), e.g. ``host/a``."""
    u = F.coalesce(col_of(url), F.lit(""))
    seg = r"(?:/[^/?#]*)" + ("{0,%d}" % segments)
    path = F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*(" + seg + ")", 1)
    return F.concat(host_of(u), path)
