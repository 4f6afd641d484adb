"""Run metrics (A1-A4): one-pass conditional aggregates, map-side combined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = ("ungated", "survivor", "maybe", "rejected")


def funnel_stats(gated: DataFrame) -> DataFrame:
    """A3: items in the funnel and per-bucket counts (one row). Items
    without wire metrics (ungated) are not counted as ``in``."""
    b = F.col("bucket")
    return gated.agg(
        F.count_if(b != "ungated").cast("bigint").alias("n_in"),
        F.count_if(b == "survivor").cast("bigint").alias("survivors"),
        F.count_if(b == "maybe").cast("bigint").alias("maybe"),
        F.count_if(b == "rejected").cast("bigint").alias("rejected"),
        F.count_if(b == "ungated").cast("bigint").alias("ungated"),
    )


def adapter_counts(items: DataFrame) -> DataFrame:
    """A2: items per adapter and source."""
    return items.groupBy("adapter", "source").agg(F.count(F.lit(1)).cast("bigint").alias("n_items"))


def label_totals(labels: DataFrame) -> DataFrame:
    """A4: positives / negatives (one row)."""
    return labels.agg(F.count_if("positive").cast("bigint").alias("positives"),
                      F.count_if(~F.col("positive")).cast("bigint").alias("negatives"))
