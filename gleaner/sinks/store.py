"""A note table with commits by batch and an index of its keys.

Plain Parquet has neither MERGE nor transactions, so a batch is written to a folder
of its own and counts only once a small commit entry names it:

    rows/commit=<attempt>/<partition>=<value>/   the rows
    keys/commit=<attempt>/bucket=<n>/            their keys (and folders) by hash bucket
    blooms/commit=<attempt>/bucket=<n>/          a Bloom filter of each bucket's keys
    commits/<number>.json                        batch name, row folders added and dropped

A batch that died before its entry leaves a folder nobody reads; a batch that is
replayed finds its name committed and writes nothing, without a look at the keys.
Rows, keys and filters become visible together. Partitions are replaced copy-on-write:
their new folders are added and the old ones dropped by one entry, all other folders
stay as they are. An entry is made by a rename that fails if the number is taken, so
of two writers one wins and the other raises.

``stored_among`` answers which of some items are stored: it reads the filters of the
buckets the items fall in, and the keys only of buckets in which a filter says maybe.
The lists of buckets are the only thing that reaches the driver, ``buckets`` numbers
at most. A filter that is too small for its keys costs reads, never a wrong answer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.dedup import dedup_first
from ..session import stage

_KEY = "key string, folder string, bucket int"
_BLOOM = "word int, bits long, bucket int"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    """Four bits of a 64-bit word (some may coincide)."""
    bits = [F.expr("1L")] * 4
    h = F.xxhash64(key, F.lit(2))
    one = [F.call_function("shiftleft", b, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
           for i, b in enumerate(bits)]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2]).bitwiseOR(one[3])


class CommitConflict(RuntimeError):
    """Another writer committed first."""


class NoteStore:
    """``key`` names a row (null and blank keys are written, but never found);
    ``partition_by`` is a column of the rows. ``buckets`` and ``words`` (64-bit
    words of a bucket's filter) are fixed when the store is made: about
    ``buckets * words * 6`` keys keep the filters sharp."""

    def __init__(self, spark: SparkSession, path: str, key: str = "item_key", partition_by: str = "date",
                 buckets: int = 64, words: int = 1 << 16):
        self.spark, self.path, self.key, self.partition_by = spark, path.rstrip("/"), key, partition_by
        self.buckets, self.words = buckets, words

    # ---- files

    def _jvm_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._jvm_path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(), self._jvm_path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _put(self, path: str, text: str) -> None:
        """Write a small file whole, or fail if it exists."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        hadoop = jvm.org.apache.hadoop.fs
        fs, draft, target = self._fs(), self._jvm_path(f"{self.path}/drafts/{uuid.uuid4().hex}"), self._jvm_path(path)
        fs.mkdirs(target.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        no_options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(draft, target, no_options)
        except Exception as exc:
            fs.delete(draft, False)
            if fs.exists(target):
                raise CommitConflict(f"{path} was taken by another writer") from exc
            raise

    # ---- commits

    def commits(self) -> list[dict]:
        """All commit entries, oldest first (one small file per batch)."""
        if not self._children(f"{self.path}/commits"):
            return []
        rows = self.spark.read.text(f"{self.path}/commits/*.json", wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda c: c["number"])

    def committed(self, batch: str) -> bool:
        return any(c["batch"] == batch for c in self.commits())

    def _commit(self, log: list[dict], entry: dict) -> None:
        number = log[-1]["number"] + 1 if log else 0
        self._put(f"{self.path}/commits/{number:012d}.json", json.dumps(entry | {"number": number}))

    @staticmethod
    def _live(log: list[dict]) -> list[str]:
        """Row folders that count, in order of their commits."""
        live: dict[str, None] = {}
        for c in log:
            for f in c["dropped"]:
                live.pop(f, None)
            live.update(dict.fromkeys(c["added"]))
        return list(live)

    @staticmethod
    def _index(log: list[dict]) -> list[str]:
        """Attempts whose keys and filters count."""
        out: list[str] = []
        for c in log:
            out = ([] if c.get("index_anew") else out) + ([c["index"]] if c.get("index") else [])
        return out

    # ---- reading

    def rows(self) -> DataFrame | None:
        """The table as of now; None before the first commit."""
        log = self.commits()
        return self._read_rows(log, self._live(log)) if log else None

    def _read_rows(self, log: list[dict], folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(log[-1]["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.path}/rows"
        with_commit = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        read = self.spark.read.schema(with_commit).option("basePath", base)
        return read.parquet(*[f"{base}/{f}" for f in folders]).select(*schema.names)

    def _read_index(self, kind: str, schema: str, attempts: list[str], buckets: Sequence[int]) -> DataFrame:
        base = f"{self.path}/{kind}"
        read = self.spark.read.schema(f"{schema}, commit string").option("basePath", base)
        return read.parquet(*[f"{base}/commit={a}" for a in attempts]).where(F.col("bucket").isin([int(b) for b in buckets]))

    def stored_among(self, items: DataFrame, scope: str | None = None) -> DataFrame:
        """The keys (one column, ``key``'s name) of ``items`` that are stored;
        with ``scope`` only those stored in that folder count (T4)."""
        attempts = self._index(self.commits())
        key = F.col("key")
        asked = items.select(F.col(self.key).cast("string").alias("key")).where(F.coalesce(key, F.lit("")) != "").distinct()
        asked = stage(asked.select("key", _bucket(key, self.buckets).alias("bucket"), _word(key, self.words).alias("word"),
                                   _mask(key).alias("mask")), how="table")
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
        if not attempts or not buckets:
            return asked.where("false").select(key.alias(self.key))
        blooms = (self._read_index("blooms", _BLOOM, attempts, buckets).groupBy("bucket", "word")
                  .agg(F.bit_or("bits").alias("bits")))
        maybe = stage(asked.join(blooms, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
                      .select("key", "bucket"), how="table")
        hit = [r[0] for r in maybe.select("bucket").distinct().collect()]
        known = self._read_index("keys", _KEY, attempts, hit)
        if scope is not None:
            known = known.where(F.col("folder") == scope)
        return maybe.join(known.select("bucket", "key"), ["bucket", "key"], "left_semi").select(key.alias(self.key))

    def skip_known(self, items: DataFrame, scope: str | None = None) -> DataFrame:
        """``items`` without those that are stored; null and blank keys stay."""
        known = self.stored_among(items, scope).select(F.col(self.key).alias("__known"))
        return items.join(known, F.col(self.key).cast("string") == F.col("__known"), "left_anti")

    # ---- writing

    def _write_rows(self, rows: DataFrame, attempt: str) -> list[str]:
        folder = f"commit={attempt}"
        rows.hint("rebalance", self.partition_by).write.partitionBy(self.partition_by).parquet(f"{self.path}/rows/{folder}")
        return [f"{folder}/{d}" for d in self._children(f"{self.path}/rows/{folder}") if d.startswith(f"{self.partition_by}=")]

    def _write_index(self, keys: DataFrame, attempt: str) -> None:
        """``keys`` (key, folder) and their filters, a few files per bucket."""
        keys = keys.withColumn("bucket", _bucket(F.col("key"), self.buckets))
        keys.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/keys/commit={attempt}")
        bits = (keys.groupBy("bucket", _word(F.col("key"), self.words).alias("word"))
                .agg(F.bit_or(_mask(F.col("key"))).alias("bits")))
        bits.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/blooms/commit={attempt}")

    def append(self, rows: DataFrame, batch: str, order: Sequence = ()) -> DataFrame | None:
        """Add the rows whose key is not stored, one per key (the first by
        ``order``), as ``batch``; returns them, or None if the batch was committed
        before. The partition column must not be the key."""
        log = self.commits()
        if any(c["batch"] == batch for c in log):
            return None
        order = list(order) or [c for c in ("seq", "note_id", self.partition_by) if c in rows.columns]
        blank = F.coalesce(F.col(self.key).cast("string"), F.lit("")) == ""
        new = dedup_first(rows.where(~blank), [self.key], order).unionByName(rows.where(blank))
        new = stage(self.skip_known(new), how="table")
        attempt = uuid.uuid4().hex
        added = self._write_rows(new, attempt)
        folder = F.col("folder") if "folder" in new.columns else F.lit(None).cast("string")
        self._write_index(new.where(~blank).select(F.col(self.key).cast("string").alias("key"), folder.alias("folder")), attempt)
        self._commit(log, {"batch": batch, "added": added, "dropped": [], "index": attempt if added else None,
                           "schema": new.schema.json()})
        return new

    def partitions(self) -> list[str]:
        """Live row folders."""
        return self._live(self.commits())

    def update(self, changed: DataFrame, batch: str, columns: Sequence[str]) -> int:
        """K4: put the values of ``columns`` of the rows in ``changed`` (key,
        partition column, ``columns``) into the table, copy-on-write: only
        partitions that hold such a row are written anew. Keys and partitions of
        rows stay. Returns the number of partitions written."""
        log = self.commits()
        if not log or any(c["batch"] == batch for c in log):
            return 0
        part = self.partition_by
        values = [r[0] for r in changed.select(part).distinct().collect()]  # partitions of the table
        live = self._live(log)
        names = {str(v) if v is not None else "__HIVE_DEFAULT_PARTITION__" for v in values}
        old = [f for f in live if self._value(f) in names]
        if not old:
            return 0
        new = changed.select(F.col(self.key).alias("__key"), *[F.col(c).alias(f"__new_{c}") for c in columns], F.lit(True).alias("__hit"))
        table = self._read_rows(log, old)
        joined = table.join(new, F.col(self.key) == F.col("__key"), "left")
        merged = joined.select(*[F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
                                 for c in table.columns])
        added = self._write_rows(merged, uuid.uuid4().hex)
        self._commit(log, {"batch": batch, "added": added, "dropped": old, "index": None, "schema": log[-1]["schema"]})
        return len(added)

    def _value(self, folder: str) -> str:
        """Partition value of a row folder, as Spark escapes it in paths."""
        util = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        return util.unescapePathName(folder.rpartition("/")[2].partition("=")[2])

    def compact_index(self) -> None:
        """Write all commits' keys and filters as one set, so that a look-up lists one folder."""
        log = self.commits()
        attempts = self._index(log)
        if len(attempts) < 2:
            return
        attempt = uuid.uuid4().hex
        keys = self._read_index("keys", _KEY, attempts, range(self.buckets)).select("key", "folder")
        self._write_index(keys, attempt)
        self._commit(log, {"batch": f"index:{attempt}", "added": [], "dropped": [], "index": attempt, "index_anew": True,
                           "schema": log[-1]["schema"]})

    def vacuum(self) -> int:
        """Remove folders that no commit names any more (dropped partitions, dead
        attempts). Only to be called while nobody writes or reads an older state."""
        log = self.commits()
        live, index = set(self._live(log)), set(self._index(log))
        gone = []
        for c in self._children(f"{self.path}/rows"):
            parts = [p for p in self._children(f"{self.path}/rows/{c}") if "=" in p]
            dead = [p for p in parts if f"{c}/{p}" not in live]
            gone += [f"rows/{c}"] if len(dead) == len(parts) else [f"rows/{c}/{p}" for p in dead]
        gone += [f"{kind}/{c}" for kind in ("keys", "blooms") for c in self._children(f"{self.path}/{kind}")
                 if c.removeprefix("commit=") not in index]
        for g in gone:
            self._fs().delete(self._jvm_path(f"{self.path}/{g}"), True)
        return len(gone)
