"""Elements of landed markup as column expressions: a fold over the tags of a page.

The page is cut at ``<`` (comments taken out and scripts emptied first); an element
starts at a piece whose start tag fits and ends where the nesting depth of its own
tag name comes back to zero, so an element inside one of the same name does not end
it. Attributes are read in any order and any quoting. An element that is never
closed reaches to the end of the page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, let

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
_ATTRIBUTES = rf"""(?:\s++[^\s=>"'/]++(?:\s*+=\s*+{_VALUE})?+|\s*+/)*?"""
_START = rf"""(?s)^[A-Za-z][\w:-]*+{_ATTRIBUTES.replace("*?", "*+")}\s*+>"""


def _attribute(piece: Column, name: str) -> Column:
    """Value of an attribute of the start tag that ``piece`` begins with; '' without it."""
    raw = F.regexp_extract(piece, rf"(?is)^[a-z][\w:-]*+{_ATTRIBUTES}\s++{name}\s*+=\s*+({_VALUE})", 1)
    return F.regexp_replace(raw, r"""^["']|["']$""", "")


def _name(piece: Column) -> Column:
    return F.lower(F.regexp_extract(piece, r"^/?([A-Za-z][\w:-]*)", 1))


class Selector:
    """An element by tag names (none: any) and by its class: a whole class name
    (``token``) or a part of the class attribute (``part``)."""

    def __init__(self, tags: Sequence[str] = (), token: str | None = None, part: str | None = None):
        self.tags, self.token, self.part = tuple(tags), token, part

    def fits(self, piece: Column) -> Column:
        out = piece.rlike(r"^[A-Za-z]")
        if self.tags:
            out = out & _name(piece).isin(*self.tags)
        css = _attribute(piece, "class")
        if self.token:
            # Cheap test first: most start tags do not hold the word at all.
            out = out & piece.contains(self.token) & F.array_contains(F.split(css, r"\s+"), self.token)
        if self.part:
            out = out & piece.contains(self.part) & css.contains(self.part)
        return out


def pieces(markup) -> Column:
    """The text cut at ``<``, without comments and with empty scripts and styles."""
    plain = F.regexp_replace(F.coalesce(col_of(markup), F.lit("")), r"(?s)<!--.*?(?:-->|\z)", "")
    return F.split(F.regexp_replace(plain, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>|\z)", "$1$3"), "<")


def _inner(all_pieces: Column, at: Column) -> Column:
    """Markup inside the element whose start tag is piece ``at`` (0-based)."""
    def end_of(own):
        zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("read"))

        def step(state, p):
            starts = (_name(p) == own) & ~p.startswith("/") & ~p.rlike(r"(?s)^[^>]*/>")
            ends = (_name(p) == own) & p.startswith("/")
            depth = state["depth"] + F.when(starts, 1).when(ends, -1).otherwise(0)
            return F.when(state["depth"] == 0, state).otherwise(F.struct(depth.alias("depth"), (state["read"] + 1).alias("read")))

        return F.aggregate(F.slice(all_pieces, at + 2, F.size(all_pieces)), zero, step)

    def text(end):
        # The piece at which the depth came to zero is the end tag itself.
        inside = F.slice(all_pieces, at + 2, end["read"] - F.when(end["depth"] == 0, 1).otherwise(0))
        first = F.regexp_replace(F.get(all_pieces, at), _START, "")
        return F.concat(first, F.when(F.size(inside) > 0, F.concat(F.lit("<"), F.array_join(inside, "<"))).otherwise(F.lit("")))

    start = F.get(all_pieces, at)
    closed = start.rlike(r"(?s)^[^>]*/>")
    return F.when(closed, F.lit("")).otherwise(let(_name(start), lambda own: let(end_of(own), text)))


def _places(p: Column, selectors: Sequence[Selector], limit: int | None) -> Column:
    """Numbers of the pieces that start an element that fits one of ``selectors``."""
    def fits(piece):
        out = selectors[0].fits(piece)
        for s in selectors[1:]:
            out = out | s.fits(piece)
        return out

    hit = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: fits(F.get(p, i)))
    return F.slice(hit, 1, limit) if limit else hit


def elements(markup, selectors: Sequence[Selector], limit: int | None = None) -> Column:
    """Inner markup of the elements that fit one of ``selectors``, in page order,
    at most ``limit``; null markup has none."""
    return let(pieces(markup), lambda p: F.transform(_places(p, selectors, limit), lambda i: _inner(p, i)))


def first_element(markup, selectors: Sequence[Selector]) -> Column:
    """Inner markup of the first element that fits, the selectors tried in their
    order; NULL when none does."""
    def found(p):
        at = F.coalesce(*[F.get(_places(p, [s], 1), 0) for s in selectors])
        return let(at, lambda i: F.when(i.isNotNull(), _inner(p, i)))

    return let(pieces(markup), found)
