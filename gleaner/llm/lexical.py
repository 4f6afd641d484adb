"""Ranked lexical search: exact best-first search in sparse ball trees.

A document's vector has, for every term of the items, the term's weight times its
saturated count, as exact integers; an item's vector has its term counts, and a
score is the inner product. Postings are reduced to the items' terms in one pass
over the texts. A task then cuts its documents into slices, builds a ball tree of
each (centroid and radius per node, the two halves around two far points) and
answers every item on it, keeping its best documents from slice to slice. By
Cauchy and Schwarz no document of a ball scores above item * centroid + |item| *
radius. In hundreds of nearly independent dimensions that alone excludes little,
so a node also has the radius of its ball on each term's own axis, and the bound is
the smaller one of the two. It is rounded up by more than doubles can lose, nodes
are opened best bound first, and the search ends when the best bound left is below
the item's last kept score. Leaves are scored in 64-bit integers. The tasks' best
documents are merged by Spark.

Items are the stated query set: they go to the tasks in blocks of about
``BLOCK_BYTES`` of text, one after another, whatever their number.

Cases: null and empty texts have no terms, count in neither N nor L and match
nothing; rows that repeat are documents of their own; documents without id come
last among equal scores; an item without terms has no result; items that repeat
in id and text are answered once, an id with several texts once for each; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SPLIT_ALNUM_LOWER, ascii_lower, dropped, encode_words, staged, table, text_slices

TOP = 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Text of items that is sent to the tasks at once; more runs block after block.
BLOCK_BYTES = 16 << 20
#: Documents and postings of one ball tree, and documents of a leaf.
SLICE_DOCS = 8192
SLICE_POSTINGS = 2_000_000
LEAF_DOCS = 64
_FOUND = "item int, item_id long, doc_id long, score long"


class _Items:
    """One block of items: sorted vocabulary and each item's (codes, counts)."""

    def __init__(self, rows):
        names = sorted({t for r in rows for t in r["terms"]}, key=str.encode)
        code = {t: i for i, t in enumerate(names)}
        self.terms = pa.array([t.encode() for t in names], pa.large_binary())
        self.ids = [r["item_id"] for r in rows]
        self.vectors = []
        for r in rows:
            codes, counts = np.unique(np.array([code[t] for t in r["terms"]], dtype=np.int64), return_counts=True)
            self.vectors.append((codes, counts.astype(np.int64)))


def item_blocks(items: DataFrame, block_bytes: int, id_col: str = "item_id", text_col: str = "text"):
    """The items with terms, block by block; each block is collected for itself."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).distinct()
    rows = staged(rows.withColumn("terms", F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), 0))
                  .where("size(terms) > 0"), "items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / block_bytes)
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for i in range(blocks):
        got = rows.where(own == i).select("item_id", "terms").collect()
        if got:
            yield _Items(got)


def postings(docs: DataFrame, vocabulary: pa.Array, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, codes, tf) per row: number of terms, and the terms of the
    sorted ``vocabulary`` with their counts."""

    def run(batches):
        for b in batches:
            for first, texts in text_slices(b, 1):
                words, known, counts = encode_words(texts, SPLIT_ALNUM_LOWER)
                code = pc.index_in(known, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(len(texts)), counts)
                at = code[words] if len(known) else words
                hit = at >= 0
                both, tf = np.unique(of[hit] * len(vocabulary) + at[hit], return_counts=True)
                ends = np.searchsorted(both, np.arange(len(texts) + 1) * len(vocabulary)).astype(np.int32)
                one = lambda values: pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), pa.array(counts.astype(np.int64)), one(both % len(vocabulary)), one(tf)],
                    ["doc_id", "n", "codes", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, codes array<int>, tf array<int>")


def term_weights(df_of: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df_of], dtype=np.int64)


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 8 * m), m = 25 + (75 * n * N) div L."""
    m = 25 + ((75 * n_docs) * n.astype(object) // n_terms).astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Tree:
    """Ball tree of documents given as rows of term codes and integer values
    (all rows have terms). After ``__init__`` the rows are in tree order."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, codes: np.ndarray, values: np.ndarray, leaf: int):
        self.codes_in, local = np.unique(codes, return_inverse=True)
        exact = values.astype(np.float64)
        norm = np.add.reduceat(exact * exact, starts[:-1])
        order = np.arange(len(ids))
        self.span, self.child, self.radius = [], [], []
        centre_node, centre_code, centre_value, reach_value = [], [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.span)
            if parent >= 0:
                self.child[parent][side] = node
            rows = order[a:b]
            at, cuts = _take(starts, rows)
            c, x = local[at], exact[at]
            dot = lambda dense: np.add.reduceat(x * dense[c], cuts)  # noqa: B023,E731
            centre = np.bincount(c, x, minlength=len(self.codes_in)) / (b - a)
            of_centre = float(centre @ centre)
            own = norm[rows]
            # The square is widened by more than its rounding before the root is taken.
            far = own - 2 * dot(centre) + of_centre
            self.radius.append(math.sqrt(max(far.max(), 0.0) + 1e-10 * (own.max() + of_centre)))
            self.span.append((a, b))
            self.child.append([-1, -1])
            some = np.flatnonzero(centre)
            reach = np.zeros(len(self.codes_in))
            np.maximum.at(reach, c, x - centre[c])
            centre_node.append(np.full(len(some), node))
            centre_code.append(some)
            centre_value.append(centre[some])
            reach_value.append(centre[some] + reach[some])
            if b - a <= leaf:
                continue
            to_first = self._to(rows[far.argmax()], starts, local, exact, own, norm, dot, len(centre))
            lean = to_first - self._to(rows[to_first.argmax()], starts, local, exact, own, norm, dot, len(centre))
            left = np.flatnonzero(lean <= 0)
            if min(len(left), b - a - len(left)) < (b - a) // 8:  # a few far points: halves keep the tree flat
                by = np.argsort(lean, kind="stable")
                left = by[:(b - a) // 2]
            inside = np.zeros(b - a, dtype=bool)
            inside[left] = True
            order[a:b] = np.concatenate((rows[inside], rows[~inside]))
            middle = a + len(left)
            todo += [(a, middle, node, 0), (middle, b, node, 1)]
        at, cuts = _take(starts, order)
        self.ids, self.starts = ids[order], np.append(cuts, len(at))
        self.codes, self.values = local[at], values[at]
        code = np.concatenate(centre_code)
        by = np.argsort(code, kind="stable")
        self.centre_node, self.centre_value = np.concatenate(centre_node)[by], np.concatenate(centre_value)[by]
        self.reach_value = np.concatenate(reach_value)[by]
        self.centre_starts = np.searchsorted(code[by], np.arange(len(self.codes_in) + 1))
        self.radius = np.array(self.radius)
        self.dense = np.zeros(len(self.codes_in), dtype=np.int64)

    @staticmethod
    def _to(pivot, starts, local, exact, own, norm, dot, width):
        """Squared distances of the node's rows to the row ``pivot``."""
        dense = np.zeros(width)
        s = slice(starts[pivot], starts[pivot + 1])
        dense[local[s]] = exact[s]
        return own - 2 * dot(dense) + norm[pivot]

    def search(self, codes: np.ndarray, counts: np.ndarray, best: _Best) -> int:
        """Add what can be among the best to ``best``; returns the number of leaves scored."""
        at = np.searchsorted(self.codes_in, codes)
        at[at == len(self.codes_in)] = 0
        here = self.codes_in[at] == codes
        if not here.any():
            return 0
        at, counts = at[here], counts[here]
        runs, _ = _take(self.centre_starts, at)
        per = np.repeat(counts, self.centre_starts[at + 1] - self.centre_starts[at])
        nodes, size = self.centre_node[runs], len(self.radius)
        whole = np.bincount(nodes, self.centre_value[runs] * per, minlength=size) + math.sqrt(float(counts @ counts)) * self.radius
        by_term = np.bincount(nodes, self.reach_value[runs] * per, minlength=size)
        bound = np.minimum(whole, by_term) * (1 + 1e-9) + 1
        self.dense[at] = counts
        leaves, heap = 0, [(-bound[0], 0)]
        while heap and -heap[0][0] >= best.least:
            _, node = heapq.heappop(heap)
            children = self.child[node]
            if children[0] >= 0:
                for c in children:
                    if bound[c] >= best.least:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.span[node]
            s = slice(self.starts[a], self.starts[b])
            score = np.add.reduceat(self.values[s] * self.dense[self.codes[s]], self.starts[a:b] - self.starts[a])
            good = np.flatnonzero(score >= best.least)
            best.add(score[good].tolist(), self.ids[a + good].tolist())
            leaves += 1
        self.dense[at] = 0
        return leaves


def _take(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of ``rows``, one row after another, and where each row begins."""
    sizes = starts[rows + 1] - starts[rows]
    cuts = np.cumsum(sizes) - sizes
    return np.repeat(starts[rows] - cuts, sizes) + np.arange(sizes.sum()), cuts


class _Best:
    """The ``top`` best documents so far, by score and then id (none last)."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores: list, ids: list) -> None:
        self.rows += [(-s, i is None, i or 0, i) for s, i in zip(scores, ids)]
        self.rows = heapq.nsmallest(self.top, self.rows, key=lambda r: r[:3])
        if len(self.rows) == self.top:
            self.least = -self.rows[-1][0]


def search_block(found: DataFrame, block: _Items, weights: np.ndarray, n_docs: int, n_terms: int,
                 top: int = TOP, leaf: int = LEAF_DOCS, slice_docs: int = SLICE_DOCS) -> DataFrame:
    """(item, item_id, doc_id, score): each task's ``top`` best documents of every item of the block."""

    def run(batches):
        best = [_Best(top) for _ in block.vectors]

        def answer(parts):
            ids, n, sizes, codes, tf = (np.concatenate(x) for x in zip(*parts))
            starts = np.concatenate(([0], np.cumsum(sizes)))
            x = weights[codes] * saturated(tf, np.repeat(n, sizes), n_docs, n_terms)
            tree = _Tree(ids, starts, codes, x, leaf)
            for (c, q), b in zip(block.vectors, best):
                tree.search(c, q, b)

        parts, rows, size = [], 0, 0
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(2)), 0))
            at = 0
            while at < b.num_rows:
                lengths = pc.list_value_length(b.column(2).slice(at, slice_docs - rows)).to_numpy(zero_copy_only=False)
                fit = max(1, int(np.searchsorted(np.cumsum(lengths), SLICE_POSTINGS - size, side="right")))
                p = b.slice(at, min(fit, len(lengths)))
                at += p.num_rows
                parts.append((np.array(p.column(0).to_pylist(), dtype=object), p.column(1).to_numpy(),
                              lengths[:p.num_rows].astype(np.int64), p.column(2).flatten().to_numpy().astype(np.int64),
                              p.column(3).flatten().to_numpy().astype(np.int64)))
                rows, size = rows + p.num_rows, size + int(lengths[:p.num_rows].sum())
                if rows >= slice_docs or size >= SLICE_POSTINGS:
                    answer(parts)
                    parts, rows, size = [], 0, 0
        if parts:
            answer(parts)
        out = [(k, block.ids[k], r[3], -r[0]) for k, b in enumerate(best) for r in b.rows]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        cols = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["item", "item_id", "doc_id", "score"])

    return found.mapInArrow(run, _FOUND)


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents of highest score above 0."""
    out = None
    for block in item_blocks(items, block_bytes):
        found = staged(postings(docs, block.terms), "postings")
        seen = found.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        if not seen["docs"]:
            break
        df_of = np.zeros(len(block.terms), dtype=np.int64)
        for r in found.select(F.explode("codes").alias("code")).groupBy("code").count().collect():  # the block's terms
            df_of[r["code"]] = r["count"]
        weights = term_weights(df_of, seen["docs"])
        parts = search_block(found, block, weights, seen["docs"], seen["terms"], top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        best = staged(best.select("item_id", "rank", "doc_id", "score"), "ranked")
        dropped(found)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: All scores, then the best of each item.
OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
i AS (
  SELECT row_number() OVER () AS iid, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
q AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(terms) AS term FROM i) GROUP BY 1, 2),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM p, s GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, s WHERE len(terms) > 0),
r AS (
  SELECT q.iid, p.rid, CAST(sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN m ON m.rid = p.rid GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT i.item_id, m.doc_id, r.score,
         row_number() OVER (PARTITION BY r.iid ORDER BY r.score DESC, m.doc_id NULLS LAST) AS rank
  FROM r JOIN m ON m.rid = r.rid JOIN i ON i.iid = r.iid WHERE r.score > 0)
WHERE rank <= 10
"""
