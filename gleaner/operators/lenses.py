"""Lens library.

The library's summary goes whole into every prompt, so it is folded into ONE
row: the lenses sorted by file path and numbered from 1. That row feeds prompts
and lens matching as scalar subqueries (computed once, no join, no cross join).
Its text is summed first, and a library beyond ``max_chars`` (more than a prompt
can hold) raises before anything is gathered. Names can be matched against a
library of any size by joins (``lens_table``, ``match_lenses_table``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as FM
from ..functions._util import let
from ..functions.text import first_sentence
from .ranks import exact_ranks

#: Characters of names and first sentences, about a quarter million tokens.
MAX_CHARS = 1 << 20
NO_LENSES = "(No lenses available.)"


def lens_rows(files: DataFrame) -> DataFrame:
    """S7 per file: (path, name, first_sentence). ``name`` is '' for a file
    without a ``name:`` line; such files still take a number (T26)."""
    return files.select(
        "path",
        FM.lens_name("value").alias("name"),
        first_sentence(FM.lens_body("value")).alias("first_sentence"),
    )


def lens_library(files: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """One row: ``lenses`` = array<struct<ord, name, first_sentence>> in file
    path order (ord from 1). The job fails when names and first sentences sum
    to more than ``max_chars`` characters (a file counts as one at least)."""
    rows = lens_rows(files)
    size = F.greatest(F.lit(1), F.length(F.concat_ws("", "name", "first_sentence")))
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).scalar()
    fits = F.when(total > max_chars, F.raise_error(F.concat(
        F.lit("lens library of "), total.cast("string"), F.lit(f" characters, more than {max_chars}"))).cast("boolean")
    ).otherwise(F.lit(True))
    rows = rows.where(fits)
    arr = F.array_sort(F.collect_list(F.struct("path", "name", "first_sentence")))
    return rows.agg(F.transform(arr, lambda x, i: F.struct(
        (i + 1).cast("int").alias("ord"), x["name"].alias("name"), x["first_sentence"].alias("first_sentence")
    )).alias("lenses"))


def _named(lenses: Column) -> Column:
    return F.filter(lenses, lambda x: F.coalesce(x["name"], F.lit("")) != "")


def summary_col(lib: DataFrame) -> Column:
    """A5: ``"{ord}. {name}: {first sentence}"`` lines of named lenses, or
    ``(No lenses available.)`` -- as a scalar subquery column."""
    named = _named(F.col("lenses"))
    text = F.array_join(F.transform(named, lambda x: F.concat(
        x["ord"].cast("string"), F.lit(". "), x["name"], F.lit(": "), F.coalesce(x["first_sentence"], F.lit(""))
    )), "\n")
    s = lib.select(F.when(F.size(named) > 0, text).otherwise(F.lit(NO_LENSES)).alias("s"))
    return s.scalar()


def lookup_col(lib: DataFrame) -> Column:
    """``map<lower(name), name>``; with repeated names the last file
    wins -- as a scalar subquery column."""
    entries = F.transform(_named(F.col("lenses")), lambda x: F.struct(F.lower(x["name"]).alias("key"), x["name"].alias("value")))
    return lib.select(F.map_from_entries(let(entries, FM.last_per_key)).alias("m")).scalar()


def first_lens_col(lib: DataFrame) -> Column:
    """The first named lens (fallback when nothing matched)."""
    return lib.select(F.get(_named(F.col("lenses")), 0)["name"].alias("f")).scalar()


def match_lenses(names, lookup: Column, first: Column, max_lenses: int = 3) -> Column:
    """Case-insensitive match of entry names to the library, canonical
    names, distinct in order, at most ``max_lenses``; none matched -> the
    first lens (when the library has one)."""
    n = F.col(names) if isinstance(names, str) else names
    canon = F.filter(F.transform(n, lambda x: F.try_element_at(lookup, F.lower(x))), lambda x: x.isNotNull())
    return let(F.slice(F.array_distinct(canon), 1, max_lenses), lambda got: (
        F.when(F.size(got) > 0, got)
        .when(first.isNotNull(), F.array(first))
        .otherwise(F.array().cast("array<string>"))))


def lens_table(files: DataFrame) -> DataFrame:
    """The library as a table of any size: (ord, name, first_sentence), numbered
    from 1 in file path order like ``lens_library``."""
    return exact_ranks(lens_rows(files), [], [F.col("path")], "ord").select("ord", "name", "first_sentence")


def match_lenses_table(df: DataFrame, key: Sequence[str], names: str, library: DataFrame, max_lenses: int = 3,
                       out: str = "lenses") -> DataFrame:
    """P15 / J2 as joins: ``df`` (rows known by ``key``) with the lenses that its
    array ``names`` names. Every entry is joined with the library on the lower-cased
    name (of equal names the last file wins), the hits come back in entry order,
    distinct, ``max_lenses`` at most; rows without any get the first lens.
    """
    key = list(key)
    named = library.where(F.coalesce(F.col("name"), F.lit("")) != "")
    by_name = named.groupBy(F.lower("name").alias("__lower")).agg(F.max_by("name", "ord").alias("__name"))
    first = named.agg(F.min_by("name", "ord")).scalar()
    entries = df.select(*key, F.posexplode(names).alias("__pos", "__entry")).withColumn("__lower", F.lower("__entry"))
    hits = (entries.where(F.col("__lower").isNotNull()).join(by_name, "__lower")
            .groupBy(*key, "__name").agg(F.min("__pos").alias("__pos")))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("__pos"))
    top = hits.withColumn("__nth", nth).where(F.col("__nth") <= max_lenses)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__nth", "__name"))), lambda x: x["__name"])
    matched = top.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(listed.alias("__hits"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    fallback = F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>"))
    return (df.join(matched, same, "left").withColumn(out, F.coalesce("__hits", fallback))
            .drop("__hits", *[f"__k{i}" for i in range(len(key))]))
