"""Helpers the corpus operators share: tables, staging, words, hash filters, components."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.session import checkpoint_root

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"

#: ``bytes.translate`` tables that turn every byte outside a word into a blank.
#: In UTF-8 no byte of a non-ASCII character is below 0x80, so bytes suffice.
SPLIT_BLANKS = bytes(0x20 if chr(b) in BLANKS else b for b in range(256))
SPLIT_BLANKS_LOWER = bytes(b + 32 if 65 <= b <= 90 else SPLIT_BLANKS[b] for b in range(256))
_ALNUM = {ord(c) for c in string.digits + string.ascii_lowercase}
SPLIT_ALNUM_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _ALNUM or b >= 0x80 else 0x20 for b in range(256))

#: Bytes of text a Python task works on at a time; a longer text is worked on alone.
SLICE_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files of a table that ``staged`` returned and nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def id_remainder(id_col, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % mod


def text_slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of runs of rows with about ``limit`` bytes; null is empty."""
    col = batch.column(text_at).cast(pa.binary())
    first, run, size = 0, [], 0
    for i in range(batch.num_rows):
        t = col[i].as_py() or b""
        if run and size + len(t) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(t)
        size += len(t) + 1
    if run:
        yield first, run


def encode_words(texts: list[bytes], split: bytes) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """Words of all texts as (index of each word in the dictionary, dictionary,
    number of words by text), without a Python object per word."""
    raw = np.frombuffer(b" ".join(texts).translate(split), dtype=np.uint8)
    inside = raw != 0x20
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                  [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[inside]))])
    coded = words.dictionary_encode()
    text_starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=text_starts[1:])
    counts = np.diff(np.searchsorted(starts, text_starts))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, counts


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over consecutive runs of the given lengths (0 allowed)."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


FILTER_BITS = 1 << 26
_CHUNK = 1 << 16


def hash_filter(df: DataFrame, term: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bit array with the crc32 of every term set: at most ``bits``/8 bytes come
    to the driver whatever the number of terms, so it may be broadcast. It has
    false positives only; users join with the terms afterwards."""

    def pack(key, rows):
        b = np.zeros(_CHUNK, dtype=np.uint8)
        b[(rows["cell"] % _CHUNK).to_numpy()] = 1
        rows = rows.iloc[:1][["chunk"]].copy()
        rows["bits"] = [np.packbits(b, bitorder="little").tobytes()]
        return rows

    cells = df.select((F.crc32(F.col(term).cast("binary")) % bits).alias("cell")).distinct()
    chunks = (cells.withColumn("chunk", F.expr(f"cell div {_CHUNK}"))
              .groupBy("chunk").applyInPandas(pack, "chunk long, bits binary").collect())
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in chunks:
        at = r["chunk"] * _CHUNK // 8
        out[at:at + _CHUNK // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def in_filter(filter_bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (filter_bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b: long); root is the smallest
    node of its component.

    Large-star and small-star steps as joins and partial aggregates; a hub's
    edges are joined with its minimum, never gathered. Each round is staged and the one before removed.
    """
    cur = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        mark = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark["n"] == 0 or mark == seen:
            break
        seen = mark
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        before, cur = cur, staged(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                     .union(small.select("a", F.col("m").alias("b"))).distinct(), "cc")
        dropped(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
