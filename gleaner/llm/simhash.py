"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits and mapped to the vector of
its segments' bit counts. The Manhattan distance of two such vectors never
exceeds the Hamming distance of the fingerprints, so a range join of the vectors
loses no link. The grid: the 32 coordinates form six blocks; vectors at distance
3 or less agree in at least three whole blocks, so each vector is put into the
20 cells named by three of its blocks, and cell mates are compared, first by
Manhattan and then by Hamming distance. A crowded cell has a grid of its own over
the halves of the three blocks it leaves open: mates at distance 3 or less agree in
three of these six halves.

Cases: a null or empty text has fingerprint zero and links like any other; rows
that repeat, and documents with equal fingerprints, are one node; a row without
doc_id links but never names a component (a component with no id at all has a
null id); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SPLIT_BLANKS_LOWER, connected_components, staged, table, text_slices

SHINGLE_WORDS = 3
MAX_BITS = 3
_LOW = 0x5555555555555555
#: First coordinate of each block and the end.
_BLOCKS = (0, 6, 12, 17, 22, 27, 32)
#: Members of a cell that one task compares with each other; a larger cell is
#: cut into parts and every pair of parts is compared somewhere. Beyond
#: ``GRID_PARTS`` parts (a second grid sends each member 20 times) it is cut by a grid.
CELL_PART = 4096
GRID_PARTS = 20


def simhash(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint as an unsigned integer."""
    words = text.translate(SPLIT_BLANKS_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        grams = [joined]
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        grams = [joined[a:b - 1] for a, b in zip(starts, starts[shingle:])]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(42))), dtype=np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at:at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for every row; fp holds the 64 bits as a long."""

    def run(batches):
        for b in batches:
            fp = np.zeros(b.num_rows, dtype=np.uint64)
            for first, texts in text_slices(b, 2):
                for i, t in enumerate(texts):
                    fp[first + i] = simhash(t, shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             ["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _mask(first: int, end: int) -> int:
    """Bits of the coordinates from ``first`` up to ``end``."""
    return sum(0b11 << (2 * i) for i in range(first, end))


def _grid(pieces: list[int]) -> list[int]:
    """Masks of every three of six pieces."""
    return [_signed(sum(c)) for c in combinations(pieces, 3)]


def _halves(chosen: tuple[int, ...]) -> list[int]:
    """Masks of the halves of the blocks that are not ``chosen``."""
    out = []
    for a, z in (_BLOCKS[b:b + 2] for b in range(6) if b not in chosen):
        out += [_mask(a, (a + z) // 2), _mask((a + z) // 2, z)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def embedding(fp):
    """Bit counts of the two-bit segments in unary code (0: 00, 1: 01, 2: 11), so
    that the Manhattan distance of two vectors is the bit count of their xor."""
    lo, hi = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return lo.bitwiseOR(hi).bitwiseOR(F.shiftleft(lo.bitwiseAND(hi), 1))


def _cell_links(max_bits: int):
    """Arrow function over rows sorted by group: a spanning set of the links
    inside each group, as (member, earlier member) pairs. A link connects two
    members whose bits differ in ``max_bits`` or fewer places."""

    def spanning(fp: np.ndarray, emb: np.ndarray):
        left = np.arange(len(fp))
        a, b = [], []
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                x = todo.pop()
                close = np.bitwise_count(emb[left] ^ emb[x]) <= max_bits
                close[close] = np.bitwise_count(fp[left[close]] ^ fp[x]) <= max_bits
                if close.any():
                    found = left[close]
                    left = left[~close]
                    a.append(fp[found])
                    b.append(np.full(len(found), fp[x]))
                    todo.extend(found.tolist())
        return a, b

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            group = held.column("grp").combine_chunks().to_numpy()
            last = np.flatnonzero(group != group[-1])
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield from cells(held.slice(0, done))
                held = held.slice(done).combine_chunks()
        if held is not None and held.num_rows:
            yield from cells(held)

    def cells(t):
        group, fp, emb = (t.column(c).combine_chunks().to_numpy() for c in ("grp", "fp", "emb"))
        fp, emb = fp.view(np.uint64), emb.view(np.uint64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(group)]))
        a, b = [], []
        pair = np.flatnonzero(np.diff(cuts) == 2)  # the common case at once
        x, y = cuts[pair], cuts[pair] + 1
        near = (np.bitwise_count(emb[x] ^ emb[y]) <= max_bits) & (np.bitwise_count(fp[x] ^ fp[y]) <= max_bits)
        a.append(fp[y[near]])
        b.append(fp[x[near]])
        for i in np.flatnonzero(np.diff(cuts) > 2):
            s = slice(cuts[i], cuts[i + 1])
            more = spanning(fp[s], emb[s])
            a += more[0]
            b += more[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, part: int = CELL_PART, grid_parts: int = GRID_PARTS) -> DataFrame:
    """(a, b) pairs of distinct fingerprints ``fps`` (fp) at ``max_bits`` (at most
    3) or fewer differing bits that connect what all such pairs connect."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the grid of six blocks serves up to 3 bits")
    masks = _grid([_mask(*_BLOCKS[b:b + 2]) for b in range(6)])
    finer = F.array(*[F.array(*map(F.lit, _grid(_halves(c)))) for c in combinations(range(6), 3)])
    emb = fps.select("fp", embedding(F.col("fp")).alias("emb"))
    # A cell name is a hash: cells that share one are compared together, which only adds comparisons.
    rows = emb.select("fp", "emb", F.posexplode(F.array(*[
        F.xxhash64(F.lit(i), F.col("emb").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])).alias("grid", "cell"))
    sized = rows.join(_parts(rows, part), "cell")
    fine = sized.where(F.col("parts") > grid_parts).select("fp", "emb", F.explode(F.transform(
        F.element_at(finer, F.col("grid") + 1),
        lambda m, i: F.xxhash64("cell", i, F.col("emb").bitwiseAND(m)))).alias("cell"))
    met = _dealt(sized.where(F.col("parts") <= grid_parts)).union(_dealt(fine.join(_parts(fine, part), "cell")))
    return (met.repartition("grp").sortWithinPartitions("grp")
            .mapInArrow(_cell_links(max_bits), "a long, b long").distinct())


def _parts(rows: DataFrame, part: int) -> DataFrame:
    """(cell, parts) of the cells with more than one row."""
    return rows.groupBy("cell").count().where("count > 1").select(
        "cell", F.ceil(F.col("count") / part).cast("int").alias("parts"))


def _dealt(sized: DataFrame) -> DataFrame:
    """(grp, fp, emb): every two parts of a cell meet in a group."""
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")).cast("int")
    return (sized.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
            .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "fp", "emb"))


def simhash_components(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, component) per row; ``component`` is the smallest
    fingerprint of the connected component."""
    fps = staged(fingerprints(docs, shingle, id_col, text_col), "simhash")
    roots = connected_components(links(fps.select("fp").distinct(), max_bits))
    return (fps.join(roots, fps["fp"] == roots["node"], "left")
            .select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("component")))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id
    (rows without one come last; ties go by the text's hash, then by
    a hash of the whole row; rows alike in all columns to any, so reruns agree)."""
    marked = staged(simhash_components(docs, shingle, max_bits), "simhash-marked")
    first = marked.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias("k_id"), F.col("k.text_hash").alias("k_hash"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    one = Window.partitionBy("k_id", "k_hash").orderBy(F.xxhash64(F.to_json("row")))
    return (packed.withColumn("k_id", F.col("row.doc_id").cast("long")).withColumn("k_hash", F.xxhash64("row.text"))
            .join(keep.withColumnsRenamed({"k_id": "r_id", "k_hash": "r_hash"}),
                  F.col("k_id").eqNullSafe(F.col("r_id")) & (F.col("k_hash") == F.col("r_hash")), "left_semi")
            .withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = staged(simhash_components(table(spark, sf_dir, "documents")), "op10")
    names = marked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return marked.join(names, "component").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
