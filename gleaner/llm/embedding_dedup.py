"""Embedding near-duplicates by sorted projection passes.

Vectors with equal label and equal components are one class. In each pass every
class gets a key, the signs of its projections on ``KEY_BITS`` random directions
concatenated, and the classes are put in lexicographic order of (label, key). Each
is compared with the ``WINDOW`` before it, and pairs that reach the threshold are
united. The passes have directions of their own, and there are as many as it takes
to find a pair at the threshold with probability ``RECALL`` in the largest label:
a window holds those that agree in about log2(size / window) leading signs.

A window is bounded, so in a dense group a vector's links may reach beyond it, but
the links found connect the group. After the passes all pairs inside each
connected component are therefore compared exactly, in pairs of parts of at most
``PART`` classes: the number of links is whole however dense a group is, and no
pair is written out. A link can be missed only if no chain of found links joins
its ends.

Cases: a vector that is null, empty or zero, or holds a null or non-finite
component, and one without label, links with nothing; so do vectors of different
length; copies are linked with each other; rows that repeat an id are vectors of
their own; a row without id links but names no component (a component without any
id has a null one, and its rows are not kept); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.ranks import exact_ranks

from ._common import connected_components, dropped, staged, table

THRESHOLD = 0.93
WINDOW = 128
KEY_BITS = 62
RECALL = 0.999
#: Rows of a sorted order that one task compares at once, besides the window before them.
BLOCK = 8192
#: Members of a component that are compared with as many others in one task.
PART = 2048
SEED = 20


def passes_needed(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold with probability ``recall`` among ``largest`` vectors."""
    if largest <= window + 1:
        return 1
    agree = 1 - math.acos(threshold) / math.pi
    once = agree ** math.log2(largest / window) if largest > window else 1.0
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(once, 1 - 1e-9))))


def _matrix(col: pa.Array) -> np.ndarray:
    """Unit vectors of rows that hold doubles as bytes, all of one length."""
    x = np.frombuffer(b"".join(col.to_pylist()), dtype=np.float64).reshape(len(col), -1)
    x = x / np.abs(x).max(axis=1)[:, None]  # the squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec): vec holds the components as bytes of doubles, null if the vector links with nothing."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(2):
                x = np.array([np.nan if c is None else c for c in v.as_py() or ()], dtype=np.float64)
                out.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, label string, vec binary")
    return staged(rows.withColumn("vec", F.when(F.col("label").isNotNull(), F.col("vec"))), "vectors")


def _key(classes: DataFrame, n: int, bits: int = KEY_BITS, seed: int = SEED) -> DataFrame:
    """``classes`` with ``key``, the concatenated signs of pass ``n`` as a long, first direction highest."""

    def run(batches):
        directions: dict[int, np.ndarray] = {}
        for b in batches:
            col, key = b.column(b.schema.get_field_index("vec")), np.zeros(b.num_rows, dtype=np.int64)
            size = np.array([len(x.as_py()) for x in col])
            for s in np.unique(size):
                if s not in directions:
                    directions[s] = np.random.default_rng([seed, n, int(s)]).standard_normal((int(s) // 8, bits))
                at = np.flatnonzero(size == s)
                signs = _matrix(col.take(pa.array(at))) @ directions[s] > 0
                key[at] = signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], [*b.schema.names, "key"])

    return classes.mapInArrow(run, "cls long, space string, vec binary, key long")


def _settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member that each of 0..n-1 reaches over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _window_links(threshold: float, window: int, step: int = 512):
    """Pandas function over a block in rank order (``own`` false: the rows before
    it): what the links inside windows connect, as (member, first member) pairs."""

    def run(rows):
        rows = rows.sort_values("rank")
        space, own = rows["space"].to_numpy(), rows["own"].to_numpy()
        a, b = [], []
        for s in np.unique(space):
            at = np.flatnonzero(space == s)
            x = _matrix(pa.array(rows["vec"].to_numpy()[at], pa.binary()))
            for lo in range(0, len(at), step):
                hi, first = min(lo + step, len(at)), max(lo - window, 0)
                i, j = np.nonzero(x[lo:hi] @ x[first:hi].T >= threshold)
                i, j = i + lo, j + first
                good = (i > j) & (i - j <= window) & own[at[i]]
                a.append(at[i[good]])
                b.append(at[j[good]])
        cls = rows["cls"].to_numpy()
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
        root = _settled(len(rows), a, b)
        some = root != np.arange(len(rows))
        return rows.iloc[:0][[]].reindex(range(int(some.sum()))).assign(a=cls[some], b=cls[root[some]])

    return run


def pass_links(classes: DataFrame, n: int, threshold: float, window: int, block: int) -> DataFrame:
    """Pass ``n``: (a, b) pairs of classes that connect what its windows link; its sorted rows are removed."""
    ranked = exact_ranks(_key(classes, n), [], [F.col("space"), F.col("key"), F.col("cls")])
    own = F.expr(f"(rank - 1) div {block}")
    late = F.expr(f"(rank - 1) % {block} >= {block - window}")
    blocks = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = ranked.select("cls", "space", "vec", "rank", F.posexplode(blocks).alias("nth", "block"))
    found = staged(dealt.select("cls", "space", "vec", "rank", "block", (F.col("nth") == 0).alias("own"))
                   .groupBy("block").applyInPandas(_window_links(threshold, window), "a long, b long"), "links")
    dropped(ranked)
    return found


def _part_counts(threshold: float):
    """Arrow function over rows sorted by group, each the members of one or two
    parts of a component: how many vectors of the other part (or, in a part with
    itself, of the same) each member is linked with."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            group = held.column("grp").combine_chunks().to_numpy()
            last = np.flatnonzero(group != group[-1])
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield counts(held.slice(0, done))
                held = held.slice(done).combine_chunks()
        if held is not None and held.num_rows:
            yield counts(held)

    def counts(t):
        group, cls, copies, own, other = (t.column(c).combine_chunks().to_numpy() for c in ("grp", "cls", "copies", "own", "other"))
        root = t.column("root").combine_chunks().to_numpy()
        vec = t.column("vec").combine_chunks()
        linked = np.zeros(t.num_rows, dtype=np.int64)
        order = np.lexsort((own, np.maximum(own, other), np.minimum(own, other), root, group))
        low, high = np.minimum(own, other)[order], np.maximum(own, other)[order]
        new = np.flatnonzero((np.diff(group[order]) != 0) | (np.diff(root[order]) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0))
        cuts = np.concatenate(([0], new + 1, [t.num_rows]))
        for s, e in zip(cuts[:-1], cuts[1:]):
            at = order[s:e]
            x = _matrix(vec.take(pa.array(at)))
            if own[at[0]] == other[at[0]]:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                linked[at] = near @ copies[at]
            else:
                first = own[at] == low[s]
                a, b = at[first], at[~first]
                near = x[first] @ x[~first].T >= threshold
                linked[a], linked[b] = near @ copies[b], near.T @ copies[a]
        return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(linked)], ["cls", "linked"])

    return run


def links_inside(members: DataFrame, threshold: float, part: int) -> DataFrame:
    """(cls, linked) of ``members`` (cls, root, vec, copies): vectors of other
    classes of the same component that the class links with, all pairs compared."""
    sizes = members.groupBy("root").count().where("count > 1").select(
        "root", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    met = (members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")).cast("int"))
           .withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))))
    met = met.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
                     "root", "own", "other", "cls", "copies", "vec")
    return (met.repartition("grp").sortWithinPartitions("grp").mapInArrow(_part_counts(threshold), "cls long, linked long")
            .groupBy("cls").agg(F.sum("linked").alias("linked")))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, passes: int | None = None,
                    block: int = BLOCK, part: int = PART, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    if window > block:
        raise ValueError("a window reaches into the block before it, not further")
    rows = _rows(vectors, id_col, vec_col, label_col)
    space = F.concat_ws(":", F.length("vec").cast("string"), "label")
    classes = staged(rows.where("vec is not null").withColumn("space", space).groupBy("space", "vec")
                     .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
                     .withColumn("cls", F.monotonically_increasing_id()), "classes")
    if passes is None:
        largest = classes.groupBy("space").count().agg(F.max("count")).first()[0] or 0
        passes = passes_needed(largest, threshold, window)
    edges = [pass_links(classes.select("cls", "space", "vec"), n, threshold, window, block) for n in range(passes)]
    pairs = edges[0]
    for e in edges[1:]:
        pairs = pairs.unionByName(e)
    roots = staged(connected_components(pairs), "roots")
    for e in edges:
        dropped(e)
    members = classes.join(roots, classes["cls"] == roots["node"]).select("cls", "root", "vec", "copies", "low")
    counted = links_inside(members.select("cls", "root", "vec", "copies"), threshold, part)
    lowest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    named = members.select("cls", "root").join(lowest, "root").join(counted, "cls", "left").select("cls", "component_id", "linked")
    of = (classes.join(named, "cls", "left")
          .select("space", "vec", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
                  F.when(F.col("linked").isNull() & F.col("component_id").isNull(), F.col("low"))
                  .otherwise(F.col("component_id")).alias("component_id")))
    of = of.withColumnsRenamed({"space": "c_space", "vec": "c_vec"})
    linked = (rows.where("vec is not null").withColumn("space", space)
              .join(of, (F.col("space") == F.col("c_space")) & (F.col("vec") == F.col("c_vec")))
              .select("vec_id", "n_links", "component_id"))
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op12_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label (the passes find all of them where a label fits in a window).
OP12_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding,
         list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN CAST(x AS DOUBLE) ELSE 0 END) AS e
  FROM embeddings),
good AS MATERIALIZED (
  SELECT rid, vec_id, label, len(e) AS n, e FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_aggregate(list_transform(e, lambda x: abs(x)), 'max') > 0),
pairs AS (
  SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.label = b.label AND a.n = b.n AND a.rid <> b.rid
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT rid AS a, rid AS b FROM good
  UNION
  SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT r.a, min(g.vec_id) AS component_id FROM reach r JOIN good g ON g.rid = r.b GROUP BY r.a),
cnt AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(cnt.n_links, 0) AS n_links, CASE WHEN g.rid IS NULL THEN v.vec_id ELSE low.component_id END AS component_id,
       coalesce(v.vec_id = CASE WHEN g.rid IS NULL THEN v.vec_id ELSE low.component_id END, false) AS kept
FROM v LEFT JOIN good g ON g.rid = v.rid LEFT JOIN cnt ON cnt.a = v.rid LEFT JOIN low ON low.a = v.rid
"""
