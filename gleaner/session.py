"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. Dates are compared in UTC; AQE re-plans joins
# (broadcast only when the runtime size is under the threshold) and splits
# skewed shuffle partitions. Of a key repeated in a JSON reply the last counts.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "gleaner", extra: dict | None = None) -> SparkSession:
    """Create (or get) a session with the settings above.

    ``master`` is only for local runs and tests; on a cluster leave it None and
    let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k in ("spark.sql.session.timeZone", "spark.sql.variant.allowDuplicateKeys"):
        spark.conf.set(k, conf[k])
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    It is the folder named by ``spark.checkpoint.dir`` (shared storage every
    executor can reach). Where that is unset, a scratch folder is made for a
    local master only (driver and tasks are one process, as in tests); on a
    cluster the call raises, because a driver's own folder would lose data.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="gleaner-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint root for a staged table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/staged/{name}-{os.getpid()}-{next(_counter)}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def stage(df, how: str = "checkpoint"):
    """Materialise ``df`` once so later actions reuse it (model replies must
    not be requested twice) and lineage is cut.

    ``checkpoint`` writes to the shared checkpoint folder (survives executor
    loss); ``table`` writes Parquet under it and reads it back. Never a
    machine-local cache.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    if how == "checkpoint":
        return df.checkpoint(eager=True)
    if how == "table":
        path = staging_path(spark, "stage")
        df.write.mode("overwrite").parquet(path)
        out = spark.read.parquet(path)
        out.staged_path = path
        return out
    if how == "none":
        return df
    raise ValueError(how)
