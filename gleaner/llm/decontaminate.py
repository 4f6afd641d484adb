"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the training texts into segments of at most
``SEGMENT_WORDS`` words (a longer text is a segment alone) and stores for every
term of a segment its sorted word positions. ``search`` runs a stated set of
phrases, in blocks of bounded size, against every segment: a phrase whose terms
are all there is answered by intersecting the offset-adjusted position lists,
the segment's rarest term first. Postings never move between tasks; a very
common passage costs each segment its own positions only. With ``slop`` the
search returns proximity matches instead: the shortest stretches of at most
phrase length + ``slop`` words that hold all terms of the phrase in any order.

Cases: null and empty texts have no words and no hits (an item without words has
no window); rows that repeat, in either table, are answered row by row (an item
id counts once); an item without item_id hits words but is not listed; an empty
table of documents gives an empty result, an empty benchmark hits nothing;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPLIT_ALNUM_LOWER, ascii_lower, encode_words, staged, table

WINDOW_WORDS = 10
SEGMENT_WORDS = 500_000
#: Phrases (with their item) that are sent to the tasks at once; more run block after block.
BLOCK_PHRASES = 50_000
#: The words of the contract, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INDEX = ("doc_ids array<long>, n_words array<int>, terms array<binary>, term_starts array<int>, postings array<int>")


def _segment(ids: list, texts: list[bytes]) -> pa.RecordBatch:
    words, terms, counts = encode_words(texts, SPLIT_ALNUM_LOWER)
    order = np.argsort(words, kind="stable").astype(np.int32)
    starts = np.searchsorted(words[order], np.arange(len(terms) + 1)).astype(np.int32)
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    lists = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays(
        [one(ids, pa.int64()), lists(pa.array(counts.astype(np.int32))), lists(terms.cast(pa.binary())),
         lists(pa.array(starts)), lists(pa.array(order))],
        ["doc_ids", "n_words", "terms", "term_starts", "postings"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """A row per segment: its documents in order with their word counts, its
    terms, and the positions (word number within the segment) of each term."""

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            col = b.column(1).cast(pa.binary())
            for i in range(b.num_rows):
                t = col[i].as_py() or b""
                # At least two bytes of text for every word but the last.
                if texts and size + len(t) > 2 * segment_words:
                    yield _segment(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(b.column(0)[i].as_py())
                texts.append(t)
                size += len(t) + 1
        if texts:
            yield _segment(ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, _INDEX).withColumn("segment", F.monotonically_increasing_id()), "index")


def item_windows(items: DataFrame, size: int = WINDOW_WORDS, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words): every run of ``size`` words of an item, or all its words if fewer."""
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(WORD), 0)
    return (items.select(F.col(id_col).cast("long").alias("item_id"), words.alias("w")).where("size(w) > 0")
            .select("item_id", F.explode(F.expr(
                f"transform(sequence(1, greatest(size(w) - {size - 1}, 1)), i -> slice(w, i, {size}))")).alias("words"))
            .distinct())


class _Phrases:
    """One block of phrases as a matrix of term numbers, filled up with -1."""

    def __init__(self, rows):
        by: dict[tuple, list] = {}
        for r in rows:
            by.setdefault(tuple(r["words"]), []).append(r["item_id"])
        terms: dict[str, int] = {}
        self.matrix = np.full((len(by), max(map(len, by), default=0)), -1, dtype=np.int32)
        for i, words in enumerate(by):
            self.matrix[i, :len(words)] = [terms.setdefault(w, len(terms)) for w in words]
        self.items = list(by.values())
        self.terms = pa.array([t.encode() for t in terms], pa.large_binary())


def _exact(lists: list[np.ndarray], n: int) -> np.ndarray:
    """Positions where the n terms with these position lists follow each other."""
    by_size = sorted(range(n), key=lambda k: len(lists[k]))
    at = lists[by_size[0]].astype(np.int64) - by_size[0]
    for k in by_size[1:]:
        if not len(at):
            break
        to = np.searchsorted(lists[k], at + k)
        to[to == len(lists[k])] = 0
        at = at[lists[k][to] == at + k]
    return at


def _near(lists: list[np.ndarray], need: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Shortest stretches [from, to) of at most ``reach`` words with all lists;
    a term that is in the phrase twice or more is needed as often."""
    rare = min(lists, key=len).astype(np.int64)
    lists = [x[np.abs(rare[np.clip(np.searchsorted(rare, x - reach), 0, len(rare) - 1)] - x) <= reach]
             for x in (y.astype(np.int64) for y in lists)]
    distinct, want = [], []
    for x in lists:
        for i, y in enumerate(distinct):
            if len(x) == len(y) and (x == y).all():
                want[i] += 1
                break
        else:
            distinct.append(x)
            want.append(1)
    pos = np.concatenate(distinct)
    which = np.repeat(np.arange(len(distinct)), [len(x) for x in distinct])
    order = np.argsort(pos)
    pos, which = pos[order], which[order]
    have, missing, left, out = [0] * len(distinct), need, 0, []
    for right in range(len(pos)):
        k = which[right]
        missing -= have[k] < want[k]
        have[k] += 1
        while missing == 0:
            k = which[left]
            if have[k] == want[k]:
                if pos[right] - pos[left] < reach:
                    out.append((pos[left], pos[right] + 1))
                missing = 1
            have[k] -= 1
            left += 1
    got = np.array(out, dtype=np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _answers(phrases, slop: int | None):
    """Arrow function over index rows: (segment, nth, spans, items) of documents with matches."""

    def answer(row, block) -> pa.RecordBatch | None:
        flat = lambda c: row.column(c).values
        counts = flat("n_words").to_numpy()
        ends = np.cumsum(counts, dtype=np.int64)
        starts, postings = flat("term_starts").to_numpy(), flat("postings").to_numpy()
        there = pc.index_in(block.terms, value_set=flat("terms").cast(pa.large_binary()))
        where = there.fill_null(-1).to_numpy(zero_copy_only=False)
        used = block.matrix >= 0
        full = np.flatnonzero(~((where[block.matrix] < 0) & used).any(axis=1) & used.any(axis=1))
        doc, frm, to, of = [], [], [], []
        for p in full:
            terms = where[block.matrix[p][used[p]]]
            lists = [postings[starts[t]:starts[t + 1]] for t in terms]
            if slop is None:
                a = _exact(lists, len(lists))
                z = a + len(lists)
            else:
                a, z = _near(lists, len(lists), len(lists) + slop)
            if not len(a):
                continue
            d = np.searchsorted(ends, a, side="right")
            inside = z <= ends[d]  # not over the end of a document
            if inside.any():
                doc.append(d[inside])
                frm.append(a[inside])
                to.append(z[inside])
                of.append(np.full(int(inside.sum()), p))
        if not doc:
            return None
        doc, frm, to, of = map(np.concatenate, (doc, frm, to, of))
        frm, to = (x - (ends - counts)[doc] for x in (frm, to))
        nth, spans, items = [], [], []
        order = np.lexsort((frm, doc))
        for rows in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            nth.append(int(doc[rows[0]]))
            spans.append([{"start": int(a), "stop": int(z)} for a, z in
                          dict.fromkeys(zip(frm[rows].tolist(), to[rows].tolist()))])
            items.append(sorted({i for p in set(of[rows].tolist()) for i in block.items[p] if i is not None}))
        return pa.RecordBatch.from_arrays(
            [pa.array([row.column("segment")[0].as_py()] * len(nth), pa.int64()), pa.array(nth, pa.int32()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
             pa.array(items, pa.list_(pa.int64()))], ["segment", "nth", "spans", "items"])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = pa.RecordBatch.from_arrays(
                    [c.take(pa.array([i])) for c in b.columns], names=b.schema.names)
                out = answer(row, phrases.value)
                if out is not None:
                    yield out

    return run


def search(index: DataFrame, phrases: DataFrame, slop: int | None = None, block_phrases: int = BLOCK_PHRASES) -> DataFrame:
    """(segment, nth, spans, items) for each document with a match of ``phrases``
    (item_id, words): ``spans`` are [start, stop) in the document's words. The phrases
    are answered block by block: a block's broadcast goes once its matches are written."""
    spark = index.sparkSession
    phrases = staged(phrases.select("item_id", "words"), "phrases")
    blocks = -(-phrases.count() // block_phrases)
    schema = "segment long, nth int, spans array<struct<start: int, stop: int>>, items array<long>"
    found = staged(spark.createDataFrame([], schema), "matches")
    for i in range(blocks):
        rows = phrases.where(F.pmod(F.xxhash64("words", "item_id"), F.lit(blocks)) == i).collect()
        block = spark.sparkContext.broadcast(_Phrases(rows))
        (index.select("segment", "n_words", "terms", "term_starts", "postings")
         .mapInArrow(_answers(block, slop), schema).write.mode("append").parquet(found.staged_path))
        block.destroy()
    found = spark.read.schema(schema).parquet(found.staged_path)
    return found.groupBy("segment", "nth").agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                               F.flatten(F.collect_list("items")).alias("items"))


def covered(spans):
    """Number of positions inside any of the [start, stop) spans."""
    ordered = F.array_sort(spans)
    return F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], acc["last"]))).alias("n"),
                                F.greatest(acc["last"], x["stop"]).alias("last")),
        lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) per row of ``docs``."""
    index = build_index(docs)
    hits = search(index, item_windows(benchmark, window))
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("nth", "d")).select(
        "segment", "nth", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))
    spans = F.coalesce("spans", F.array().cast("array<struct<start: int, stop: int>>"))
    return rows.join(hits, ["segment", "nth"], "left").select(
        "doc_id", "n_words", covered(spans).alias("n_hit"), spans.alias("spans"),
        F.array_distinct(F.coalesce("items", F.array().cast("array<long>"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark. A text is
    judged alike wherever it stands, so rows are matched by their text's hash."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                        F.xxhash64(docs["text"]).alias("text_hash"))
    index_rows = keyed.select(F.col("text_hash").alias("doc_id"), F.col("row.text").alias("text"))
    bad = contamination(index_rows, benchmark, window).where("n_hit > 0").select(
        F.col("doc_id").alias("bad_hash")).distinct()
    return keyed.join(bad, keyed["text_hash"] == bad["bad_hash"], "left_anti").select("row.*")


def op3_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
