"""Centroid clustering by Lloyd rounds with ns-bounds.

Every vector keeps, for each centroid, the exact squared distance of its last
evaluation and the round of it. All centroids of all rounds are kept too (rounds
times k rows, on the driver and in the tasks). A stored distance is loosened by
the norm of the centroid's total displacement since that round, not by the sum of
its drifts round by round, so a centroid that moves to and fro loosens nothing. A
centroid whose lower bound is above the upper bound of the vector's own centroid
is skipped; the others are evaluated anew in exact integer arithmetic, the own
centroid first. Bounds are compared with a margin far above the rounding of
doubles, so no skipped centroid could have been nearer or as near.

Vectors and bounds are staged after each round, and the state before is removed;
a round's sums are taken per batch and then by Spark, so that the driver gets
k times ``dims`` sums whatever the input.

Cases: vectors that are null, have another length or hold a null or non-finite
component are left out, as are those with a component of 2**27 or more after
scaling, whose squared distances would not fit in a long; rows that repeat are
vectors of their own; a null id hashes as empty text, and equal hashes are ordered
by the vector's components; fewer kept vectors than ``k`` give as many centroids;
an empty table gives an empty result; a centroid that loses all vectors stays;
ties go to the smaller centroid number; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, staged, table

CENTROIDS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64.0
SEED = "1"
#: Components stay below this in size: 64 squares of twice it fit in a long.
LIMIT = 1 << 27
#: Up to this size sums of 64 products are exact in doubles, and matrix products may be used.
_EXACT = 1 << 22
_MARGIN = 1e-9
_STATE = "vec_id long, v array<int>, cluster int, squared array<long>, round array<byte>, evaluated int"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, dims: int, scale: float) -> DataFrame:
    """(vec_id, v): floor(``scale`` * component) of the vectors that are kept."""
    x = F.col("x")
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
                    & (F.abs(F.floor(c * scale)) < LIMIT))
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    kept = kept.where((F.size(x) == dims) & F.coalesce(fits, F.lit(False)))

    def run(batches):
        for b in batches:
            ints = np.floor(scale * _flat(b.column(1), np.float64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ints.reshape(-1, dims))], ["vec_id", "v"])

    return kept.mapInArrow(run, "vec_id long, v array<int>")


def _flat(col, kind) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.ravel()))


def _squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of matching rows of ``v`` and ``c``."""
    d = v.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def _all_squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``v`` to all of ``c``."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) >= _EXACT:
        return np.stack([_squared(v, x) for x in c], axis=1)
    f, g = v.astype(np.float64), c.astype(np.float64)
    return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)


def _reassigned(v, own, squared, when, history, final: bool):
    """(cluster, squared, round, evaluations) after the last round of ``history``."""
    now, rows = len(history) - 1, np.arange(len(v))
    moved = np.stack([np.sqrt(((history[now] - h).astype(np.float64) ** 2).sum(axis=1)) for h in history])
    k = np.arange(moved.shape[1])
    stored, drift = np.sqrt(squared.astype(np.float64)), moved[when, k]
    low, slack = stored - drift, _MARGIN * (1 + stored + drift)
    upper = stored[rows, own] + drift[rows, own]

    def open_pairs(top, which):
        out = low[which] - slack[which] <= (top + _MARGIN * (1 + top))[:, None]
        out[np.arange(len(which)), own[which]] = False
        return out

    evaluated = np.zeros(len(v), dtype=np.int32)
    loose = open_pairs(upper, rows).any(axis=1)
    at = rows if final else np.flatnonzero(loose)
    squared[at, own[at]] = _squared(v[at], history[now][own[at]])
    when[at, own[at]] = now
    evaluated[at] += 1
    at = np.flatnonzero(loose)
    i, j = np.nonzero(open_pairs(np.sqrt(squared[at, own[at]].astype(np.float64)), at))
    i = at[i]
    squared[i, j] = _squared(v[i], history[now][j])
    when[i, j] = now
    np.add.at(evaluated, i, 1)
    # Exact distances of this round are compared; all others are known to be larger.
    known = np.where(when[at] == now, squared[at], np.iinfo(np.int64).max)
    own = own.copy()
    own[at] = known.argmin(axis=1)
    return own, squared, when, evaluated


def assign(state: DataFrame, history: list[np.ndarray], final: bool = False) -> DataFrame:
    """One assignment of every vector to the nearest centroid of ``history[-1]``.
    ``final`` evaluates the distance to the own centroid in any case."""
    now, k = len(history) - 1, len(history[0])

    def run(batches):
        for b in batches:
            v = _flat(b.column(1), np.int32).reshape(b.num_rows, -1)
            if now == 0:
                squared = _all_squared(v, history[0])
                own, when = squared.argmin(axis=1), np.zeros(squared.shape, dtype=np.int8)
                evaluated = np.full(len(v), k, dtype=np.int32)
            else:
                squared = _flat(b.column(3), np.int64).reshape(-1, k).copy()
                when = _flat(b.column(4), np.int8).reshape(-1, k).copy()
                own, squared, when, more = _reassigned(
                    v, b.column(2).to_numpy(zero_copy_only=False).astype(np.int64), squared, when, history, final)
                evaluated = more + b.column(5).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(own.astype(np.int32)), _lists(squared), _lists(when),
                 pa.array(evaluated.astype(np.int32))],
                ["vec_id", "v", "cluster", "squared", "round", "evaluated"])

    return state.mapInArrow(run, _STATE)


def _means(state: DataFrame, last: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every cluster's components; clusters without vectors keep ``last``."""

    def run(batches):
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            v = _flat(b.column(1), np.int64).reshape(b.num_rows, -1)
            some = np.unique(own)
            sums = np.stack([v[own == c].sum(axis=0) for c in some]) if len(some) else np.zeros((0, 1), dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(np.array([(own == c).sum() for c in some], dtype=np.int64)),
                 _lists(sums)], ["cluster", "n", "sums"])

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = (parts.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
            .groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")))
    new = last.copy()
    for r in sums.collect():  # k times dims rows
        new[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    return new


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, id_col: str = "vec_id",
            vec_col: str = "embedding", dims: int = DIMS, scale: float = SCALE,
            seed: str = SEED) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, cluster, distance, evaluated) of every kept vector, centroids of
    all rounds); ``evaluated`` counts the exact distances that were computed for
    it, of k * (rounds + 1) without bounds."""
    if rounds > 120:
        raise ValueError("rounds are stored in a byte")
    state = staged(integer_vectors(vectors, id_col, vec_col, dims, scale), "cluster-vectors")
    history = [first_centroids(state, k, seed)]
    if not len(history[0]):
        return state.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
                            F.lit(0).alias("evaluated")), history
    for n in range(rounds + 1):
        after = staged(assign(state, history, final=n == rounds), f"cluster-{n}")
        dropped(state)
        state = after
        if n < rounds:
            history.append(_means(state, history[-1]))
    return state.select("vec_id", "cluster", F.element_at("squared", F.col("cluster") + 1).alias("distance"),
                        "evaluated"), history


def op11_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, history = cluster(table(spark, sf_dir, "embeddings"))
    of = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per centroid
    total = sum(r["cluster_inertia"] for r in of)
    named = [(r["cluster"], r["cluster_inertia"], total,
              hashlib.sha256(",".join(map(str, history[-1][r["cluster"]].tolist())).encode()).hexdigest()) for r in of]
    side = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.drop("evaluated").join(F.broadcast(side), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: The same rounds without bounds, one after another.
OP11_SQL = r"""
WITH RECURSIVE kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
vals AS (SELECT rid, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM kept),
seeds AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept
          QUALIFY c < 16),
c0 AS (SELECT c, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM seeds),
""" + "".join(f"""
a{n} AS (
  SELECT rid, c, dist FROM (
    SELECT v.rid, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS dist FROM vals v JOIN c{n} c USING (d) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1),
m{n} AS (SELECT a.c, v.d, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{n} a JOIN vals v USING (rid) GROUP BY 1, 2),
c{n + 1} AS (
  SELECT c.c, c.d, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON c.c = m.c AND c.d = m.d),
""" for n in range(3)) + r"""
a3 AS (
  SELECT rid, c, dist FROM (
    SELECT v.rid, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS dist FROM vals v JOIN c3 c USING (d) GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY dist, c) = 1),
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c3 GROUP BY c)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.dist AS distance,
       CAST(sum(a.dist) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.dist) OVER () AS BIGINT) AS inertia,
       h.centroid_sha256
FROM a3 a JOIN kept k USING (rid) JOIN h ON h.c = a.c
"""
