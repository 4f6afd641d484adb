"""Source registry (S8, J5) and fetch outcomes of landed responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank


def enabled_sources(registry: DataFrame) -> DataFrame:
    """Enabled sources that have a URL (feeds) or a slug (charts).

    Registry columns: adapter, name, slug, url, enabled. A chart source is
    addressed by its slug; every other adapter by its URL.
    """
    addr = F.when(F.col("adapter") == "beatport", nonblank("slug")).otherwise(nonblank("url"))
    return registry.where(F.coalesce(F.col("enabled"), F.lit(False)) & addr.isNotNull())


def attach_source(entries: DataFrame, registry: DataFrame, on: str = "name") -> DataFrame:
    """Entries joined to their (enabled) source definition. The registry
    is a small config table; AQE broadcasts it when its runtime size allows."""
    reg = enabled_sources(registry)
    return entries.join(reg, on, "inner")


def looks_like_html(body) -> F.Column:
    """HTML sniff on the first 200 characters after leading whitespace."""
    head = F.lower(F.substring(F.regexp_replace(F.coalesce(body, F.lit("")), r"^(?U)\s+", ""), 1, 200))
    return (head.startswith("<!doctype html") | head.startswith("<html")
            | (F.instr(head, "<head") > 0) | (F.instr(head, "theme-beta") > 0))


def classify_fetch(responses: DataFrame) -> DataFrame:
    """Outcome per landed response (url, attempt, status, body):
    ``retry`` for no response at all (NULL status), 429, 5xx or an HTML
    challenge page; ``give_up`` for any other non-200; ``ok`` otherwise."""
    st = F.col("status")
    outcome = (F.when(st.isNull() | (st == 429) | (st >= 500), F.lit("retry"))
               .when(st != 200, F.lit("give_up"))
               .when(looks_like_html(F.col("body")), F.lit("retry"))
               .otherwise(F.lit("ok")))
    return responses.withColumn("outcome", outcome)


def fetch_result(responses: DataFrame, max_attempts: int = 4) -> DataFrame:
    """Per URL: the body of the first decisive attempt (``ok`` -> body,
    ``give_up`` -> NULL) within ``max_attempts``; NULL when every attempt
    asked for a retry. One partial aggregation per URL (``min_by``)."""
    c = classify_fetch(responses).where((F.col("attempt") < max_attempts) & (F.col("outcome") != "retry"))
    first = F.min_by(F.struct("outcome", "body"), F.col("attempt"))
    agg = c.groupBy("url").agg(first.alias("d"))
    allu = responses.select("url").distinct()
    return allu.join(agg, "url", "left").select(
        "url", F.when(F.col("d.outcome") == "ok", F.col("d.body")).alias("body"),
        F.coalesce(F.col("d.outcome"), F.lit("exhausted")).alias("outcome"))
