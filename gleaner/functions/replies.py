"""Untrusted model replies: fence stripping, JSON parse to VARIANT, typed
field access with Python-``int()``-like coercion (P12-P14, P16).

Everything stays a column expression; a bad reply affects its own row only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, let
from .text import strip_ws


def strip_fences(c) -> Column:
    """Remove a leading ```` ``` ```` / ```` ```json ```` fence and a trailing
    ```` ``` ```` (case-insensitive), stripping whitespace around them."""
    t = strip_ws(F.coalesce(col_of(c), F.lit("")))
    t = F.regexp_replace(t, r"(?i)^```(?:json)?(?U)\s*", "")
    return F.regexp_replace(strip_ws(t), r"(?U)\s*```$", "")


def parse_reply(c) -> Column:
    """Fenced or bare JSON text -> VARIANT; NULL when it does not parse."""
    return F.try_parse_json(strip_fences(c))


def kind(v) -> Column:
    """Top-level JSON kind of a VARIANT: OBJECT, ARRAY, STRING, BIGINT, ...
    (``schema_of_variant`` without the element details); NULL for SQL NULL."""
    return F.regexp_extract(F.schema_of_variant(col_of(v)), r"^([A-Z]+)", 1)


def is_object(v) -> Column:
    return F.coalesce(kind(v) == "OBJECT", F.lit(False))


def field(v, name: str) -> Column:
    """The VARIANT value of key ``name``; SQL NULL when the key is absent
    (a JSON ``null`` value is a VARIANT null, not SQL NULL)."""
    return F.try_variant_get(col_of(v), f"$.{name}", "variant")


def has_field(v, name: str) -> Column:
    return is_object(v) & field(v, name).isNotNull()


def py_int(x) -> Column:
    """Python ``int(x)`` of a VARIANT value, NULL where Python raises.

    Numbers truncate toward zero, booleans are 0/1, strings must be an optional
    sign and digits (surrounding whitespace allowed); null, lists, objects and
    strings like ``"3.7"`` give NULL. Values are kept as double so clamping
    happens before narrowing.
    """
    x = col_of(x)

    def conv(b):
        k, as_num, from_str = b["k"], b["n"], b["s"]
        str_ok = from_str.rlike(r"^(?U)\s*[+-]?\d+\s*$")
        return (F.when(k.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"),
                       F.when(as_num >= 0, F.floor(as_num)).otherwise(F.ceil(as_num)).cast("double"))
                .when((k == "STRING") & str_ok, strip_ws(from_str).cast("double")))

    return let(F.struct(kind(x).alias("k"), F.try_variant_get(x, "$", "double").alias("n"),
                        F.try_variant_get(x, "$", "string").alias("s")), conv)


def clamp_int(v, name: str, lo: int, hi: int, default: int | None) -> Column:
    """``max(lo, min(hi, int(obj.get(name, default))))``.

    Key absent -> ``default`` (clamped); present but unusable -> NULL; ``v`` not
    an object -> NULL.
    """
    f = field(v, name)
    n = F.when(f.isNull(), F.lit(default).cast("double")).otherwise(py_int(f))
    # greatest/least skip NULLs, so an unusable value is kept NULL explicitly
    out = let(n, lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))).cast("int")))
    return F.when(is_object(v), out)


def get_string(v, name: str) -> Column:
    """String value of key ``name`` when it is a JSON string, else NULL."""
    f = field(v, name)
    return F.when(kind(f) == "STRING", F.try_variant_get(f, "$", "string"))


def get_array(v, name: str) -> Column:
    """``array<variant>`` of key ``name`` when it is a JSON array, else NULL."""
    return F.try_variant_get(col_of(v), f"$.{name}", "array<variant>")


def variant_str_list(arr) -> Column:
    """``array<variant>`` -> ``array<string>`` as Python ``str(item)`` would
    give for strings and numbers (JSON text otherwise)."""
    def one(e):
        k = kind(e)
        return (F.when(k == "STRING", F.try_variant_get(e, "$", "string"))
                .when(k == "BOOLEAN", F.when(F.try_variant_get(e, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
                .when(k == "VOID", F.lit("None"))
                .otherwise(F.to_json(e)))
    return F.transform(col_of(arr), one)


_NAME_KEYS = ("name", "lens", "lens_name", "title")


def lens_entry_name(e) -> Column:
    """A lens entry as a name: a string as is; an object's first
    non-blank string among name/lens/lens_name/title; otherwise NULL."""
    e = col_of(e)
    k = kind(e)
    picks = []
    for key in _NAME_KEYS:
        s = get_string(e, key)
        picks.append(F.when(strip_ws(s) != "", s))
    return (F.when(k == "STRING", F.try_variant_get(e, "$", "string"))
            .when(k == "OBJECT", F.coalesce(*picks)))


def lens_names(v, name: str = "lenses") -> Column:
    """The lens entries of a reply as names (NULL for unusable entries)."""
    arr = F.coalesce(get_array(v, name), F.array().cast("array<variant>"))
    return F.transform(arr, lens_entry_name)


def questions_map(v, name: str = "questions") -> Column:
    """``map<string, array<string>>`` of the questions object (non-list values
    dropped); empty map when absent or not an object."""
    m = F.try_variant_get(col_of(v), f"$.{name}", "map<string,variant>")
    m = F.coalesce(m, F.create_map().cast("map<string,variant>"))
    m = F.transform_values(m, lambda k, x: F.try_variant_get(x, "$", "array<string>"))
    return F.map_filter(m, lambda k, x: x.isNotNull())


def scope_questions(questions, lenses) -> Column:
    """Keep the non-empty question lists of the matched lenses, in lens
    order (lookup by exact lens name)."""
    q = col_of(questions)
    entries = F.transform(col_of(lenses), lambda l: F.struct(l.alias("key"), F.try_element_at(q, l).alias("value")))
    entries = F.filter(entries, lambda e: F.coalesce(F.size(e["value"]), F.lit(0)) > 0)
    return F.map_from_entries(entries)
