"""Note table of record (K1), quarantine table (K5), backfill output (K4).

The table of record is Parquet partitioned by ``date`` and keyed by
``item_key`` where the notes carry it, else by the full ``source_url``;
Markdown is a derived column (T20, T21). Plain Parquet
has no MERGE, so new rows are the ``left_anti`` of the batch against the
stored keys, then appended: re-running a batch adds nothing (idempotent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import dedup_first
from ..operators.items import item_key
from ..session import stage


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def stored_keys(spark: SparkSession, path: str, key: str = "source_url") -> DataFrame | None:
    if not _exists(spark, path):
        return None
    table = spark.read.parquet(path)
    if key == "item_key" and key not in table.columns:  # written before notes carried it
        table = table.select(item_key(table).alias(key))
    return table.select(key)


def write_notes(notes: DataFrame, path: str, key: str | None = None, partition_by: str = "date") -> DataFrame:
    """K1: append rows whose key is not stored yet, one per key (the smallest
    note id); returns the rows added, staged before the write, so that they
    neither change with the table nor are computed twice.

    Rows are gathered by ``partition_by`` in shuffle partitions that AQE splits
    where one value is large, so a date gets few files and no task a whole date.
    """
    spark = notes.sparkSession
    key = key or ("item_key" if "item_key" in notes.columns else "source_url")
    order = [c for c in ("seq", "note_id", partition_by) if c in notes.columns]
    old = stored_keys(spark, path, key)
    new = dedup_first(notes, [key], order)
    new = stage(new if old is None else new.join(old, key, "left_anti"), how="table")
    new.hint("rebalance", partition_by).write.mode("append").partitionBy(partition_by).parquet(path)
    return new


def write_quarantine(bad: DataFrame, path: str, on=None) -> None:
    """K5: append quarantined rows (url, stage, error_kind, payload) with the day of the run."""
    bad.withColumn("quarantined_on", F.lit(on).cast("date")).write.mode("append").parquet(path)


def write_backfill(backfilled: DataFrame, path: str) -> None:
    """K4: write the recomputed notes to a new location (Spark cannot
    overwrite the path it is reading)."""
    backfilled.write.mode("overwrite").parquet(path)
