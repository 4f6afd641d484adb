"""Markdown note frontmatter (P23) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, let
from .text import strip_ws

# Line breaks Python's ``str.splitlines`` recognises.
_LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def _has_fm(t: Column) -> Column:
    return t.startswith("---") & (F.locate("---", t, 4) > 0)


def frontmatter_text(c) -> Column:
    """Text between the opening ``---`` and the next ``---`` found after
    offset 3 (anywhere, not only at a line start); NULL without frontmatter."""
    t = col_of(c)
    end = F.locate("---", t, 4)
    return F.when(_has_fm(t), F.substr(t, F.lit(4), end - F.lit(4)))


def note_body(c) -> Column:
    """Text after the closing ``---`` (the whole text without frontmatter)."""
    t = col_of(c)
    end = F.locate("---", t, 4)
    return F.when(_has_fm(t), F.substr(t, end + F.lit(3))).otherwise(t)


def _unquote(v: Column) -> Column:
    return F.btrim(F.btrim(strip_ws(v), F.lit('"')), F.lit("'"))


def frontmatter_map(c) -> Column:
    """``map<string,string>`` of ``key: value`` lines (split at the first
    colon; key and value stripped; value unquoted). A later key wins. Empty
    map without frontmatter."""
    fm = frontmatter_text(c)
    lines = F.filter(F.split(F.coalesce(fm, F.lit("")), _LINE_BREAKS), lambda l: F.instr(l, ":") > 0)
    entries = F.transform(lines, lambda l: F.struct(
        strip_ws(F.substring_index(l, ":", 1)).alias("key"),
        _unquote(F.substr(l, F.instr(l, ":") + F.lit(1))).alias("value")))
    return F.map_from_entries(let(entries, last_per_key))


def last_per_key(entries: Column) -> Column:
    """Entries (struct key, value) keeping only the last one of each key, in
    order. ``entries`` must be a bound value (see ``let``)."""
    return F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda x: x["key"] == e["key"]))


def fm_get(m, key: str) -> Column:
    return F.try_element_at(col_of(m), F.lit(key))


def inline_list(c) -> Column:
    """``[a, b]`` -> ``array('a','b')`` (items stripped and unquoted, blanks
    dropped); a plain value -> one-element array; NULL/'' -> empty."""
    v = strip_ws(F.coalesce(col_of(c), F.lit("")))
    inner = F.regexp_extract(v, r"^\[(.*)\]$", 1)
    items = F.transform(F.split(inner, ","), _unquote)
    listed = F.filter(items, lambda x: x != "")
    return (F.when(v.rlike(r"^\[.*\]$"), listed)
            .when(v != "", F.array(_unquote(v)))
            .otherwise(F.array().cast("array<string>")))


def replace_fields(c, fields: dict) -> Column:
    """The text with the frontmatter lines of ``fields`` (name -> rendered value)
    taken out, with the lines that continue them, and written anew at its end in
    the given order. All other lines and the body stay as they are. Text without
    frontmatter is returned unchanged."""
    t = col_of(c)
    names = "|".join(fields)
    kept = F.regexp_replace(frontmatter_text(t), rf"(?m)^(?:{names}):[^\n]*(?:\n[ \t-][^\n]*)*(?:\n|\z)", "")
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in fields.items()])
    new = F.concat(F.lit("---"), F.regexp_replace(kept, r"\n+\z", ""), F.lit("\n"), lines, F.lit("\n---"), note_body(t))
    return F.when(_has_fm(t), new).otherwise(t)


def lens_name(c) -> Column:
    """Lens file name: value of the first frontmatter line starting with
    ``name:`` (stripped, unquoted); '' when none."""
    fm = frontmatter_text(c)
    lines = F.split(F.coalesce(fm, F.lit("")), _LINE_BREAKS)
    first = F.get(F.filter(lines, lambda l: l.startswith("name:")), 0)
    return F.coalesce(_unquote(F.substr(first, F.lit(6))), F.lit(""))


def lens_body(c) -> Column:
    """Lens description text: after the first ``---`` found past offset 3 when
    there is one, else the whole text (frontmatter or not)."""
    t = col_of(c)
    end = F.locate("---", t, 4)
    return F.when(end > 0, F.substr(t, end + F.lit(3))).otherwise(t)
