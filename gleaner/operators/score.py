"""Wire-metric pre-rank (W1, W2): a pure column expression, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any
from .ranks import exact_ranks

# Domains treated as passive media (substring match), as in the
# reference.
PASSIVE_DOMAINS = ("i.redd.it", "v.redd.it", "i.imgur.com", "imgur.com",
                   "gfycat.com", "youtube.com", "youtu.be")


def wire_score_col(wire: str = "wire", title: str = "title", taxonomy=None,
                   passive=PASSIVE_DOMAINS) -> Column:
    """Density + type + ratio + taxonomy + popularity, 4 decimals.

    density = min(c / (s + 10), 1) * 5; type: self +2, video -1.5, passive
    domain -1, else a non-``self.`` domain +1; ratio = (r - 0.5) * 2;
    taxonomy = min(title hits, 3) * 1.5; popularity = log10(s + 1); s and c
    floored at 0. The terms are added in that order.
    """
    w = F.col(wire)
    s = F.greatest(F.coalesce(w["score"], F.lit(0)).cast("double"), F.lit(0.0))
    c = F.greatest(F.coalesce(w["num_comments"], F.lit(0)).cast("double"), F.lit(0.0))
    r = F.coalesce(w["upvote_ratio"], F.lit(0.0)).cast("double")
    density = F.least(c / (s + F.lit(10.0)), F.lit(1.0)) * F.lit(5.0)
    dom = F.lower(F.coalesce(w["domain"], F.lit("")))
    typ = (F.when(F.coalesce(w["is_self"], F.lit(False)), F.lit(2.0)).otherwise(F.lit(0.0))
           + F.when(F.coalesce(w["is_video"], F.lit(False)), F.lit(-1.5)).otherwise(F.lit(0.0))
           + F.when(contains_any(dom, passive), F.lit(-1.0))
              .when((dom != "") & ~dom.startswith("self."), F.lit(1.0)).otherwise(F.lit(0.0)))
    ratio = (r - F.lit(0.5)) * F.lit(2.0)
    if taxonomy:
        low = F.lower(F.coalesce(F.col(title), F.lit("")))
        kws = F.array(*[F.lit(str(k).lower()) for k in taxonomy])
        hits = F.size(F.filter(kws, lambda k: F.instr(low, k) > 0))
        tax = F.least(hits, F.lit(3)).cast("double") * F.lit(1.5)
    else:
        tax = F.lit(0.0)
    pop = F.log10(s + F.lit(1.0))
    return F.round(density + typ + ratio + tax + pop, 4)


def wire_prerank(items: DataFrame, taxonomy=None, passive=PASSIVE_DOMAINS) -> DataFrame:
    """Attach ``wire_pre_score``. The ranking itself is the order key
    (``wire_pre_score`` desc, ``seq``); no global sort is done here."""
    return items.withColumn("wire_pre_score", wire_score_col("wire", "title", taxonomy, passive))


def prerank_order():
    """The pre-rank order: score descending, then run order."""
    return [F.col("wire_pre_score").desc(), F.col("seq").asc()]


def prerank(items: DataFrame, taxonomy=None, group: str = "wire.subreddit", rank_col: str = "prerank") -> DataFrame:
    """The scored items with their exact rank in the pre-rank order of
    their community. Range partitions and running offsets instead of a window, so
    that a community holding all items is still sorted by many tasks."""
    return exact_ranks(wire_prerank(items, taxonomy), [F.col(group)], prerank_order(), rank_col)
