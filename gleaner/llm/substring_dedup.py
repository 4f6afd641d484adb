"""Substring deduplication with a count-min prefilter.

A window is ``window`` consecutive words. First pass: every partition sketches,
for each of its documents, the window anchors (the lowest hash of a ``GRAM_WORDS``
run of words inside the window; equal windows have equal anchors), the sketches
are added up, and only the cells counted twice or more are kept. A window whose
anchor has a cell with a count of one is in one document only; the sketch never
counts too little, so none is lost. Second pass: the windows estimated as
repeated are grouped exactly, by 96 bits of their word sequence, and the
smallest doc_id of each group is found. Within a slice of a partition a window
is sent once, for its smallest document; larger ones are settled there. So a
passage in a third of all rows sends one row per slice.

Cases: null or empty text has no words; a text shorter than a window has none;
rows that repeat a doc_id are judged alike (no row removes from its own id); a
row without doc_id neither removes nor loses words; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SPLIT_BLANKS, encode_words, in_filter, table, text_slices

WINDOW_WORDS = 50
GRAM_WORDS = 8
#: Cells in each of the sketch's two rows; the bits kept of it are broadcast (2 x CELLS / 8 bytes).
CELLS = 1 << 26
_CHUNK = 1 << 16
_U = np.uint64
_MULT = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ _U(seed)) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _runs(lane: np.ndarray, length: int, mult: np.uint64) -> np.ndarray:
    """Polynomial hash of every run of ``length`` words."""
    n = len(lane)
    up, down = _powers(mult, n + 1), _powers(_U(pow(int(mult), -1, 1 << 64)), n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lane * down[:n], dtype=np.uint64)))
    return (total[length:] - total[:-length]) * up[:n - length + 1]


class _Windows:
    """The windows of some texts: position of each, its text, anchor and hash."""

    def __init__(self, texts: list[bytes], window: int):
        ids, words, counts = encode_words(texts, SPLIT_BLANKS)
        self.window, self.counts = window, counts
        self.starts = np.cumsum(counts) - counts
        self.at = np.zeros(0, np.int64)
        if not len(counts) or counts.max(initial=0) < window:
            return
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), dtype=np.uint64).reshape(-1, 2)
        self.lanes = digest[ids, 0], digest[ids, 1]
        gram = min(GRAM_WORDS, window)
        low = _mix(_runs(self.lanes[0], gram, _MULT[0]), 1)
        span = window - gram + 1  # minimum over so many grams, by doubling
        size = 1
        while size < span:
            step = min(size, span - size)
            low = np.minimum(low[:-step], low[step:])
            size += step
        text = np.repeat(np.arange(len(counts)), counts)[:len(low)]
        self.at = np.flatnonzero(np.arange(len(low)) + window <= (self.starts + counts)[text])
        self.text, self.anchor = text[self.at], low[self.at]

    def hashes(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_mix(_runs(lane, self.window, m)[self.at[keep]], 2) for lane, m in zip(self.lanes, _MULT))


def _cells(anchor: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple((_mix(anchor, s) % _U(cells)).astype(np.int64) + i * cells for i, s in enumerate((11, 12)))


def repeated_cells(docs: DataFrame, window: int, cells: int) -> np.ndarray:
    """The merged sketch as a bit for each cell: set if two documents or more count there."""

    def sketch(batches):
        for b in batches:
            for _, texts in text_slices(b, 0):
                w = _Windows(texts, window)
                if not len(w.at):
                    continue
                new = np.concatenate(([True], (np.diff(w.anchor) != 0) | (np.diff(w.text) != 0)))
                pair = np.unique(np.stack((w.text[new].astype(np.uint64), w.anchor[new])), axis=1)[1]
                cell, n = np.unique(np.concatenate(_cells(pair, cells)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    def pack(key, rows):
        bits = np.zeros(_CHUNK, dtype=np.uint8)
        bits[(rows["cell"] % _CHUNK).to_numpy()] = 1
        rows = rows.iloc[:1][["chunk"]].copy()
        rows["bits"] = [np.packbits(bits, bitorder="little").tobytes()]
        return rows

    counted = docs.select("text").mapInArrow(sketch, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    chunks = (counted.where("n > 1").select("cell", F.expr(f"cell div {_CHUNK}").alias("chunk"))
              .groupBy("chunk").applyInPandas(pack, "chunk long, bits binary"))
    out = np.zeros(2 * cells // 8, dtype=np.uint8)
    for r in chunks.toLocalIterator():  # at most 2 * cells / 8 bytes in all
        at = r["chunk"] * _CHUNK // 8
        out[at:at + _CHUNK // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def repeated_spans(docs: DataFrame, window: int = WINDOW_WORDS, cells: int = CELLS) -> DataFrame:
    """(doc_id, text_hash, spans): for each document that loses words, the
    [from, to) word ranges covered by windows that also start in a document
    with a smaller doc_id. ``docs`` has doc_id (long), text_hash and text."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(repeated_cells(docs, window, cells))

    def find(batches):
        for b in batches:
            all_ids = b.column(0).to_numpy(zero_copy_only=False)
            known = ~np.asarray(b.column(0).is_null())
            all_ids = np.where(known, all_ids, 0).astype(np.int64)
            hashes = b.column(1).to_numpy(zero_copy_only=False)
            for first, texts in text_slices(b, 2):
                w = _Windows(texts, window)
                if not len(w.at):
                    continue
                keep = known[first + w.text]
                for c in _cells(w.anchor, cells):
                    keep[keep] = in_filter(bits.value, c[keep])
                if not keep.any():
                    continue
                text, at = w.text[keep], w.at[keep]
                h1, h2 = w.hashes(keep)
                ids = all_ids[first + text]
                order = np.lexsort((ids, h2, h1))
                h1, h2, ids, text, at = (x[order] for x in (h1, h2, ids, text, at))
                new = np.concatenate(([True], (np.diff(h1) != 0) | (np.diff(h2) != 0)))
                lowest = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
                sent = ids == lowest
                pos = (at - w.starts[text]).astype(np.int32)
                th = hashes[first + text]
                back = np.lexsort((at[sent], text[sent]))  # by document again: its columns repeat
                yield rows(*(x[sent][back] for x in (h1, h2, ids, th, pos)), np.full(len(back), window), False)
                # Settled here: runs of neighbouring windows as one range.
                h1, h2, text, pos, ids, th = (x[~sent] for x in (h1, h2, text, pos, ids, th))
                if len(text):
                    order = np.lexsort((pos, text))
                    h1, h2, text, pos, ids, th = (x[order] for x in (h1, h2, text, pos, ids, th))
                    a = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(pos) > 1))))
                    z = np.concatenate((a[1:], [len(pos)])) - 1
                    # A key of its own: a settled range only travels along.
                    own = _mix(th[a].view(np.uint64) + pos[a].astype(np.uint64), 3)
                    yield rows(own, own, ids[a], th[a], pos[a], pos[z] - pos[a] + window, True)

    def rows(h1, h2, ids, th, pos, words, settled):
        return pa.RecordBatch.from_arrays(
            [pa.array(h1.view(np.int64)), pa.array((h2 >> _U(32)).astype(np.uint32).view(np.int32)), pa.array(ids),
             pa.array(th), pa.array(pos), pa.array(words.astype(np.int32)), pa.array(np.full(len(pos), settled))],
            ["h1", "h2", "doc_id", "text_hash", "start", "words", "settled"])

    found = docs.select("doc_id", "text_hash", "text").mapInArrow(
        find, "h1 long, h2 int, doc_id long, text_hash long, start int, words int, settled boolean")
    # Settled rows take no part in the minimum, even if their key should meet another's.
    lowest = F.min(F.when(~F.col("settled"), F.col("doc_id"))).over(Window.partitionBy("h1", "h2"))
    return (found.withColumn("first_id", lowest).where("settled or doc_id > first_id")
            .groupBy("doc_id", "text_hash").agg(F.collect_set(
                F.struct("start", (F.col("start") + F.col("words")).alias("stop"))).alias("spans")))


def _cut(words: list[bytes], spans) -> list[bytes]:
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans or ():
        gone[s["start"]] += 1
        gone[s["stop"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if not g]


def substring_dedup(docs: DataFrame, window: int = WINDOW_WORDS, cells: int = CELLS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row; ``kept`` is the text of the words left, joined by one space."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn(
        "text_hash", F.xxhash64("text"))
    spans = repeated_spans(rows, window, cells).withColumnsRenamed({"doc_id": "s_id", "text_hash": "s_hash"})
    joined = rows.join(spans, (F.col("doc_id") == F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left")

    def cut(batches):
        for b in batches:
            n, removed, kept = [], [], []
            for first, texts in text_slices(b, 1):
                for i, t in enumerate(texts):
                    words = t.translate(SPLIT_BLANKS).split()
                    left = _cut(words, b.column(2)[first + i].as_py())
                    n.append(len(words))
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
