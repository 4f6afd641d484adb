"""Batch model calls (U1, U3): the only stage that leaves the JVM.

``infer_batch`` appends ``reply``, ``backend`` and ``error`` to every row via
``mapInArrow``: whole Arrow record batches go to the Python worker, nested
columns pass through untouched, and the three new columns are appended. The
backend list is tried in order per row; availability is checked once per
partition (not per row). A failing row keeps its error text; nothing raises.

Model output may differ between calls, so callers stage the result
(``gleaner.session.stage``) before more than one action reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage


class Backend:
    """A model endpoint: ``generate(system, user) -> text``; may raise."""

    name = "backend"

    def available(self) -> bool:
        return True

    def generate(self, system: str, user: str) -> str:  # pragma: no cover - interface
        raise NotImplementedError

    def generate_batch(self, systems: list, users: list) -> list:
        """Replies for many prompts at once; an item may be an exception
        (that row then falls back to the next backend). Backends that can
        send one request for many prompts override this."""
        out = []
        for s, u in zip(systems, users):
            try:
                out.append(self.generate(s, u))
            except Exception as exc:  # per row
                out.append(exc)
        return out


class FunctionBackend(Backend):
    """Wrap a plain function ``fn(system, user) -> text`` as a backend."""

    def __init__(self, name: str, fn: Callable[[str, str], str],
                 available: Callable[[], bool] | None = None):
        self.name = name
        self._fn = fn
        self._available = available

    def available(self) -> bool:
        return True if self._available is None else bool(self._available())

    def generate(self, system: str, user: str) -> str:
        return self._fn(system, user)


def _ship(obj_module_names=("gleaner",)):
    """Pickle this package by value so executors need not have it installed."""
    import importlib

    from pyspark import cloudpickle
    for name in obj_module_names:
        try:
            cloudpickle.register_pickle_by_value(importlib.import_module(name))
        except Exception:  # already registered or not importable
            pass


def call_batch(live: Sequence[Backend], systems: list, users: list):
    """(reply, backend, error) per prompt: each backend answers the prompts
    still open, in order; rows it fails on go to the next backend."""
    n = len(systems)
    res: list = [None] * n
    errs: list = ["no backend available"] * n
    open_rows = list(range(n))
    for b in live:
        if not open_rows:
            break
        try:
            got = b.generate_batch([systems[i] or "" for i in open_rows], [users[i] or "" for i in open_rows])
        except Exception as exc:  # the whole call failed: every open row keeps trying
            got = [exc] * len(open_rows)
        if len(got) != len(open_rows):
            got = [RuntimeError(f"{b.name} returned {len(got)} replies for {len(open_rows)} prompts")] * len(open_rows)
        still = []
        for i, g in zip(open_rows, got):
            if isinstance(g, BaseException):
                errs[i] = f"{type(g).__name__}: {g}"
                still.append(i)
            elif not isinstance(g, str):  # not a reply: the next backend is asked
                errs[i] = f"TypeError: {b.name} replied with {type(g).__name__}"
                still.append(i)
            else:
                res[i] = (g, b.name, None)
        open_rows = still
    for i in open_rows:
        res[i] = (None, None, errs[i])
    return res


#: Prompts that a task holds as Python objects at once.
CALL_ROWS = 256


def infer_batch(df: DataFrame, backends: Sequence[Backend], system_col: str = "system",
                user_col: str = "user", reply_col: str = "reply", backend_col: str = "backend",
                error_col: str = "error", system: str | None = None, keep: Sequence[str] | None = None,
                call_rows: int = CALL_ROWS) -> DataFrame:
    """One model call per row, replies appended as columns.

    With ``system`` all rows have this system prompt and no column for it; ``keep``
    names the columns to return (all by default). A backend gets ``call_rows``
    prompts at a time, so what a task holds does not grow with its rows.

    Filters and projections must be applied before this call: Catalyst does
    not push them through ``mapInArrow``. Repartition beforehand to set the
    request concurrency.
    """
    backends = list(backends)
    at_of = list(range(len(df.columns))) if keep is None else [df.columns.index(c) for c in keep]
    out = T.StructType([df.schema.fields[i] for i in at_of] + [
        T.StructField(reply_col, T.StringType()),
        T.StructField(backend_col, T.StringType()),
        T.StructField(error_col, T.StringType()),
    ])
    _ship()

    def run(batches):
        import pyarrow as pa

        live = []
        for b in backends:
            try:
                if b.available():
                    live.append(b)
            except Exception:
                pass
        for whole in batches:
            for at in range(0, whole.num_rows, call_rows):
                rb = whole.slice(at, call_rows)
                users = rb.column(rb.schema.get_field_index(user_col)).to_pylist()
                systems = [system] * len(users) if system is not None else rb.column(rb.schema.get_field_index(system_col)).to_pylist()
                res = call_batch(live, systems, users)
                cols = [rb.column(i) for i in at_of] + [
                    pa.array([r[0] for r in res], pa.string()),
                    pa.array([r[1] for r in res], pa.string()),
                    pa.array([r[2] for r in res], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return df.mapInArrow(run, out)


def _remembered(spark: SparkSession, path: str | None) -> DataFrame | None:
    if path is None:
        return None
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm):
        return None
    return spark.read.schema("prompt_key string, reply string, backend string").parquet(path)


def infer_distinct(items: DataFrame, system: Column, user: Column, backends: Sequence[Backend],
                   partitions: int | None = None, memory: str | None = None) -> DataFrame:
    """U1, each distinct prompt asked once: ``items`` with ``reply``, ``backend``
    and ``error``.

    ``user`` is an expression over the items, ``system`` one that is the same for
    all of them. Prompts are known by a hash; only hash, reply, backend and error
    are staged, never a prompt, and they are joined back to the items by the hash.
    With ``memory`` (a folder) replies are kept there and later runs ask only
    prompts that have no reply yet; a call that failed is not kept, so it is asked
    again. ``partitions`` sets the number of concurrent calls.
    """
    spark = items.sparkSession
    one = spark.range(1).select(system.alias("system"))
    digest = F.sha2(F.concat(one.select(F.sha2("system", 256)).scalar(), F.sha2(F.coalesce(user, F.lit("")), 256)), 256)
    keyed = items.withColumn("prompt_key", digest)
    asked = items.select(digest.alias("prompt_key"), user.alias("user")).dropDuplicates(["prompt_key"])
    known = _remembered(spark, memory)
    if known is not None:
        asked = asked.join(known, "prompt_key", "left_anti")
    if partitions:
        asked = asked.repartition(partitions)
    called = infer_batch(asked, backends, system=one.first()["system"] or "", keep=["prompt_key"])
    replies = stage(called, how="table")
    if memory is not None:
        replies.where(F.col("error").isNull()).select("prompt_key", "reply", "backend").write.mode("append").parquet(memory)
    if known is not None:
        # One reply per prompt, as two runs at the same time may both have asked.
        old = known.groupBy("prompt_key").agg(F.min(F.struct("reply", "backend")).alias("r"))
        replies = replies.unionByName(old.select("prompt_key", "r.reply", "r.backend", F.lit(None).cast("string").alias("error"))
                                      .join(replies.select("prompt_key"), "prompt_key", "left_anti"))
    return keyed.join(replies, "prompt_key", "left").drop("prompt_key")
