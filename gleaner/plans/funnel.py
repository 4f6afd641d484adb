"""Relevance funnel (W6 / Q1): wire items are pre-ranked, gated by the model,
budgeted and deep-dived; items without wire metrics pass through ungated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.gate import deep_dive, gate_prompt_columns, survivor_budget, triage_gate
from ..operators.infer import Backend, infer_distinct
from ..operators.score import wire_prerank
from ..schemas import TRIAGE


def run_funnel(items: DataFrame, *, backends: Sequence[Backend], lens_summary: Column,
               exemplar_block: Column, taxonomy=None, threshold: int = 3, maybe_band: int = 1,
               max_survivors: int | None = None, comments: DataFrame | None = None,
               deep_dive_k: int = 12, enabled: bool = True, partitions: int | None = None,
               memory: str | None = None) -> DataFrame:
    """Q1. Returns all items with ``bucket`` (ungated / survivor / maybe /
    rejected), ``triage``, ``triage_score``, ``wire_pre_score``, ``overflow``
    and ``deep_dived``. ``enabled=False`` (F8) marks everything ungated.

    Each distinct prompt is asked once; its reply (without the prompt) is staged
    before buckets and budget read it, and kept in ``memory`` if given, so that
    later runs do not ask it again.
    """
    base = items.withColumns({
        "wire_pre_score": F.lit(None).cast("double"), "triage": F.lit(None).cast(TRIAGE),
        "triage_score": F.lit(None).cast("int"), "bucket": F.lit("ungated"),
        "overflow": F.lit(False), "deep_dived": F.lit(False)})
    if not enabled:
        return base
    other = base.where(F.col("wire").isNull())
    wired = items.where(F.col("wire").isNotNull())
    ranked = wire_prerank(wired, taxonomy)
    replied = infer_distinct(ranked, *gate_prompt_columns(lens_summary, exemplar_block), backends, partitions, memory)
    gated = triage_gate(replied, threshold, maybe_band).drop("reply", "backend", "error")
    gated = survivor_budget(gated, max_survivors)
    if comments is not None:
        gated = deep_dive(gated, comments, deep_dive_k)
    else:
        gated = gated.withColumn("deep_dived", F.lit(False))
    return other.unionByName(gated.select(*other.columns))
