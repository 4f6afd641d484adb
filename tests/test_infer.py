"""Model-call operator: backend routing, per-row errors, called once."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from gleaner.operators.infer import Backend, FunctionBackend, infer_batch
from gleaner.session import stage

# backends defined here travel to the Python workers by value
from pyspark import cloudpickle  # noqa: E402
import sys  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky(Backend):
    def __init__(self, name, avail=True, fail=False):
        self.name, self._avail, self._fail = name, avail, fail

    def available(self):
        return self._avail

    def generate(self, system, user):
        if self._fail:
            raise RuntimeError(f"{self.name} failed")
        return f"{self.name}:{user}"


def _run(spark, backends):
    df = spark.createDataFrame([(1, "s", "u1")], "id long, system string, user string")
    return infer_batch(df, backends).first()


def test_first_backend_used(spark):
    r = _run(spark, [Flaky("local"), Flaky("remote")])
    assert (r.reply, r.backend, r.error) == ("local:u1", "local", None)


def test_unavailable_backend_skipped(spark):
    r = _run(spark, [Flaky("local", avail=False), Flaky("remote")])
    assert r.backend == "remote"


def test_failing_backend_falls_back(spark):
    r = _run(spark, [Flaky("local", fail=True), Flaky("remote")])
    assert r.backend == "remote"


def test_all_fail_keeps_error_per_row(spark):
    r = _run(spark, [Flaky("local", fail=True), Flaky("remote", fail=True)])
    assert r.reply is None and r.backend is None and "remote failed" in r.error
    r = _run(spark, [])
    assert r.error == "no backend available"


def test_nested_columns_pass_through(spark):
    df = spark.createDataFrame([(1, (2, ["a"]), "s", "u")], "id long, w struct<n:int,t:array<string>>, system string, user string")
    r = infer_batch(df, [Flaky("m")]).first()
    assert r.w.n == 2 and r.w.t == ["a"] and r.reply == "m:u"


def test_model_called_once_when_staged(spark):
    d = tempfile.mkdtemp(prefix="calls-")

    def gen(system, user, _d=d):
        import os as _os
        import uuid
        open(_os.path.join(_d, uuid.uuid4().hex), "w").close()
        return "{}"
    df = spark.range(50).select("id", F.lit("s").alias("system"), F.col("id").cast("string").alias("user"))
    out = stage(infer_batch(df, [FunctionBackend("f", gen)]))
    out.count()
    out.groupBy("backend").count().collect()
    assert len(os.listdir(d)) == 50


class Batching(Backend):
    """Answers a whole batch in one call; fails the rows whose user text is 'bad'."""
    name = "batch"

    def generate_batch(self, systems, users):
        return [RuntimeError("bad row") if u == "bad" else f"B:{u}" for u in users]


def test_batch_backend_with_row_fallback(spark):
    df = spark.createDataFrame([(1, "s", "ok"), (2, "s", "bad")], "id long, system string, user string")
    got = {r.user: (r.reply, r.backend) for r in infer_batch(df, [Batching(), Flaky("single")]).collect()}
    assert got == {"ok": ("B:ok", "batch"), "bad": ("single:bad", "single")}


class Sized(Backend):
    """Replies with the number of prompts it was given at once."""

    name = "sized"

    def generate_batch(self, systems, users):
        return [f"{len(users)} {s}" for s in systems]


def test_a_backend_gets_few_prompts_at_once_whatever_the_rows(spark):
    df = spark.range(0, 3000, 1, 1).select("id", F.col("id").cast("string").alias("user"), F.lit("s").alias("system"))
    out = infer_batch(df, [Sized()])
    assert out.columns == ["id", "user", "system", "reply", "backend", "error"] and out.distinct().count() == 3000
    assert out.agg(F.max(F.split("reply", " ")[0].cast("int"))).first()[0] <= 256
    few = infer_batch(df.drop("system"), [Sized()], system="shared", keep=["id"])
    assert few.columns == ["id", "reply", "backend", "error"] and few.where("reply like '% shared'").count() == 3000
