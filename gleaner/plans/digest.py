"""Feed digest: the minimal end-to-end slice.

feed entries -> items (strip HTML, pick body, dates, tags) -> keep-first dedup
on a URL key -> drop already-stored URLs -> pre-rank score -> top N per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import url_prefix_key
from ..operators.dedup import dedup_first, first_per_key, skip_known
from ..operators.items import feed_items
from ..operators.score import wire_prerank


def feed_digest(entries: DataFrame, known: DataFrame, *, as_of, taxonomy=None, top_n: int = 5,
                key_segments: int = 1) -> DataFrame:
    items = feed_items(entries, as_of)
    items = items.withColumn("dedup_key", url_prefix_key("source_url", key_segments))
    items = dedup_first(items, ["dedup_key"], ["seq"])
    items = skip_known(items, known)
    scored = wire_prerank(items, taxonomy)
    top = first_per_key(scored, ["source"], [F.col("wire_pre_score").desc(), F.col("seq").asc()],
                        top_n, rank_col="rank")
    return top.select("source", "source_url", "dedup_key", "title", "published_date", "wire_pre_score",
                      F.col("rank").cast("int").alias("rank"))
