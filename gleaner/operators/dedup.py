"""Dedup, top-N per source, anti-join against stored keys.

All window forms here filter on ``row_number() <= k`` so Spark plans a
partial ``WindowGroupLimit`` before the shuffle: each map task sends at most
``k`` rows per key, so a key holding a third of all rows does not land whole
on one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

def _order(cols):
    out = []
    for c in cols:
        if isinstance(c, str):
            out.append(F.col(c).asc_nulls_last())
        else:
            out.append(c)
    return out


def first_per_key(df: DataFrame, keys, order, k: int = 1, rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows per key by ``order`` (ties broken by the
    remaining columns only if given in ``order``)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    rn = rank_col or "__rn"
    out = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return out if rank_col else out.drop(rn)


def dedup_first(df: DataFrame, keys, order) -> DataFrame:
    """Keep-first dedup: one row per key, the first by ``order``
    (``dropDuplicates`` would keep an arbitrary one)."""
    return first_per_key(df, keys, order, 1)


def top_n_per_source(entries: DataFrame, source: str, source_ord: str, key: str, pos: str,
                     n: int) -> DataFrame:
    """First ``n`` distinct keys per source in feed order; a key kept by
    several sources stays with the lowest source ordinal.

    Step 1 drops repeats inside a source, step 2 cuts each source to ``n``,
    step 3 keeps the first source per key.
    """
    inside = dedup_first(entries, [source, key], [pos])
    cut = first_per_key(inside, [source], [pos], n)
    return dedup_first(cut, [key], [source_ord, pos])


def sequential_top_n(entries: DataFrame, source: str, source_ord: str, key: str, pos: str,
                     n: int) -> DataFrame:
    """X1, exact for keys shared by sources: as if the sources were visited in
    order (by ordinal, then name), each keeping its first ``n`` keys that no
    earlier source kept.

    Done for all sources at once, in rounds: every source proposes its first
    ``n`` keys, a key several propose stays with the earliest, the others lose
    it for good and propose their next one. All keys rank the sources alike, so
    the rounds end in the sequential result. The number of rounds is that of
    the longest chain of lost keys, whatever the number of sources; each round's
    pool is staged, so the plan stays the same size.
    """
    pool = stage(dedup_first(entries, [source, key], [pos]), how="table")
    while True:
        proposed = stage(first_per_key(pool, [source], [pos, key], n), how="table")
        won = dedup_first(proposed, [key], [source_ord, source])
        lost = _without(proposed, won, [source, key]).select(source, key)
        if not lost.head(1):
            return proposed
        pool = stage(_without(pool, lost, [source, key]), how="table")


def _without(df: DataFrame, other: DataFrame, cols: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``cols`` are not in ``other`` (null equals null)."""
    o = other.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(cols)])
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(cols)]
    return df.join(o, same, "left_anti")


def skip_known(items: DataFrame, known: DataFrame, key: str = "source_url", scope: str | None = None) -> DataFrame:
    """Drop items whose key is already stored (left anti join).

    With ``scope`` only rows of ``known`` in that ``folder`` count as stored: the
    inbox alone, as the reference looks it up, or any other (T4; by default all).
    No broadcast hint: AQE broadcasts ``known`` only when its runtime size is
    under the threshold, otherwise it shuffles both sides; a hot key on the
    item side is split by AQE's skew handling. Items with a NULL key stay, so F1
    runs first. Against a large store use ``NoteStore.skip_known``, which reads
    only the key buckets it needs.
    """
    return items.join(known_keys(known, key, scope), key, "left_anti")


def known_keys(notes: DataFrame, key: str = "source_url", scope: str | None = None) -> DataFrame:
    """The distinct stored keys (non-blank), of one folder if ``scope`` is given."""
    if scope is not None:
        notes = notes.where(F.col("folder") == scope)
    return notes.select(key).where(F.coalesce(F.col(key), F.lit("")) != "").distinct()


def note_collisions(notes: DataFrame, id_col: str = "note_id", url_col: str = "source_url") -> DataFrame:
    """A8 (added): note ids shared by more than one URL, with the URL count.
    Partial aggregation (distinct then count) keeps a hot id cheap."""
    d = notes.select(id_col, url_col).distinct()
    return (d.groupBy(id_col).agg(F.count(url_col).alias("n_urls"))
            .where(F.col("n_urls") > 1))
