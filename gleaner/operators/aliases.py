"""Aliases as a relation (J3): which aliases of a large table occur in which texts.

"Contains" is no equi join, and comparing every alias with every text is a nested
loop. Here every alias is filed under one of its character grams, the one that the
fewest texts have; a text probes with its distinct grams, and only the aliases filed
under one of them, with the same characters around it, are tested with ``contains``.
Grams are seven characters, so that few aliases share one however many there are, and
travel as hashes (a collision only costs a test). Both joins are equi joins on a gram or an id, which Spark shuffles and
AQE splits where a gram is hot; nothing is broadcast by hint and the alias table may
be of any size. It is staged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import let
from ..session import stage

GRAM = 7


#: Stands in for what lies before and after a text.
_NONE = "\0"


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters, hashed, each with the two characters
    before it and the two after it (null if it occurs among different ones); one
    pass, as substr would start anew at each."""
    runs = F.regexp_extract_all(F.concat(F.lit(_NONE * 2), text, F.lit(_NONE * 2)), F.lit(f"(?s)(?=(.{{{n + 4}}}))"), 1)
    rows = F.array_sort(F.transform(F.array_distinct(runs), lambda r: F.struct(
        F.xxhash64(F.substring(r, 3, n)).alias("gram"),
        F.concat(F.substring(r, 1, 2), F.substring(r, n + 3, 2)).alias("around"))))

    def one_each(found):
        same = lambda x, i: F.coalesce(F.get(found, i)["gram"] == x["gram"], F.lit(False))
        marked = F.transform(found, lambda x, i: F.struct(
            x["gram"].alias("gram"), F.when(~(same(x, i - 1) | same(x, i + 1)), x["around"]).alias("around"), same(x, i - 1).alias("again")))
        return F.transform(F.filter(marked, lambda x: ~x["again"]), lambda x: F.struct(x["gram"].alias("gram"), x["around"].alias("around")))

    return let(rows, one_each)


def _fits(want: Column, around: Column) -> Column:
    """Whether the characters around a gram of a text may be those of the alias."""
    fits = F.lit(True)
    for i in range(1, 5):
        w = F.substring(want, i, 1)
        fits = fits & ((w == _NONE) | (w == F.substring(around, i, 1)))
    return F.coalesce(fits, F.lit(True))


def alias_candidates(t: DataFrame, aliases: DataFrame, gram: int = GRAM) -> DataFrame:
    """(id, alias) of the texts ``t`` (id, text) that hold the rarest gram of an
    alias, with what the alias has around it."""
    size = F.least(F.length("alias"), F.lit(gram))
    sizes = sorted(r[0] for r in aliases.select(size).distinct().collect())  # at most ``gram``
    if not sizes:
        return t.select("id", F.lit("").alias("alias")).where("false")
    own = F.coalesce(*[F.when(size == n, _grams(F.col("alias"), n)) for n in sizes])
    filed = aliases.select("alias", F.inline(own))
    probes = t.select("id", F.inline(F.flatten(F.array_compact(F.array(*[_grams(F.col("text"), n) for n in sizes])))))
    probes = stage(probes.join(filed.select("gram").distinct(), "gram", "left_semi"), how="table")
    seen = probes.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (filed.join(seen, "gram").groupBy("alias").agg(F.min(F.struct("n", "gram", "around")).alias("r"))
              .select("alias", F.col("r.gram").alias("gram"), F.col("r.around").alias("want")))
    return probes.join(rarest, "gram").where(_fits(F.col("want"), F.col("around"))).select("id", "alias")


def alias_hits(texts: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text",
               alias_col: str = "alias", gram: int = GRAM) -> DataFrame:
    """(id, alias) for every alias that the lower-cased text contains.

    Aliases are distinct, blank and null ones match nothing; ids are taken as
    unique. Aliases shorter than ``gram`` are filed under themselves.
    """
    t = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text"))
    a = aliases.select(F.col(alias_col).alias("alias")).where(F.coalesce(F.col("alias"), F.lit("")) != "").distinct()
    near = alias_candidates(t, stage(a, how="table"), gram)
    return near.join(t, "id").where(F.contains("text", "alias")).select("id", "alias")


def alias_values(texts: DataFrame, aliases: DataFrame, id_col: str = "id", text_col: str = "text",
                 taxonomy=None) -> DataFrame:
    """(id, values): the distinct values of the aliases (alias, value, ord) found in
    each text, in alias order, restricted to ``taxonomy`` if given: the substring
    pass of ``derive_relevance`` with the aliases as a table."""
    a = aliases if taxonomy is None else aliases.where(F.col("value").isin(*taxonomy))
    found = alias_hits(texts, a, id_col, text_col).join(a.select("alias", "value", "ord"), "alias")
    first = found.groupBy("id", "value").agg(F.min("ord").alias("ord"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
    return first.groupBy("id").agg(listed.alias("values"))
