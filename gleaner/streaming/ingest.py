"""Structured Streaming forms of the daily run's incremental parts.

R1 ``ingest_stream``: landed entries arrive as files; each micro-batch is
normalised (S1 row logic), deduplicated keep-first (X3), cleared of stored keys
through the store's key index (J1) and appended as one commit named after the
query and its batch number. The foreachBatch sink is at-least-once: a batch that
died before its commit left nothing that is read, and one replayed after it is
known by its name, so every batch counts exactly once and no run reads all keys.

R2 ``dedup_stream``: bounded-state dedup of an event stream by key within a
watermark (``dropDuplicatesWithinWatermark``).

Checkpoints live under the shared checkpoint folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.items import feed_items
from ..session import staging_path
from ..sinks.store import NoteStore


def ingest_stream(entries: DataFrame, sink_path: str, checkpoint: str | None = None, *, as_of,
                  key: str = "source_url", available_now: bool = True,
                  to_entries: Callable[[DataFrame], DataFrame] | None = None, name: str | None = None,
                  partition_by: str = "published_date", store: NoteStore | None = None):
    """Start the ingest query and return it (``StreamingQuery``).

    ``entries`` is a streaming DataFrame of landed rows; ``to_entries`` maps
    them to the feed-entry schema when they are not already in it. The rows go to
    ``store`` (or a ``NoteStore`` at ``sink_path``; read it with ``NoteStore.rows``).
    Batches are named ``name:<number>``; the name defaults to the checkpoint's
    path, because batch numbers start anew with a new checkpoint.
    """
    spark = entries.sparkSession
    checkpoint = checkpoint or staging_path(spark, "ingest-ckpt")
    name = name or checkpoint
    store = store or NoteStore(spark, sink_path, key=key, partition_by=partition_by)

    def batch(df: DataFrame, epoch_id: int) -> None:
        label = f"{name}:{epoch_id}"
        if store.committed(label):
            return
        e = to_entries(df) if to_entries else df
        store.append(feed_items(e, as_of).withColumn("batch_id", F.lit(epoch_id)), label, order=["seq"])

    w = entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def dedup_stream(events: DataFrame, keys: Sequence[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """R2: drop repeats of ``keys`` arriving within ``delay`` of each other
    (state is bounded by the watermark). ``event_time`` must be a
    TIMESTAMP (a TIMESTAMP_NTZ column is cast, session time zone)."""
    ts = F.col(event_time).cast("timestamp")
    return (events.withColumn(event_time, ts).withWatermark(event_time, delay)
            .dropDuplicatesWithinWatermark(list(keys)))


def run_to_parquet(stream: DataFrame, sink_path: str, checkpoint: str | None = None):
    """Run a streaming frame to completion (available-now) into Parquet."""
    spark = stream.sparkSession
    checkpoint = checkpoint or staging_path(spark, "stream-ckpt")
    q = (stream.writeStream.format("parquet").option("path", sink_path)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def read_stream_parquet(spark: SparkSession, path_glob: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path_glob)
