"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, mix.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``docs``; the last returns the
documents the mix takes, with ``copies`` (how often) and ``taken`` (words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm._common import staged, table
from gleaner.llm.decontaminate import decontaminate
from gleaner.llm.mixing import mix
from gleaner.llm.quality import quality_filter
from gleaner.llm.secrets import redact_secrets
from gleaner.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix(docs).where("copies > 0")
    names = {c.lower() for c in docs.columns}
    new = [F.col("copies").alias("copies" if "copies" not in names else "mix_copies"),
           (F.col("copies") * F.col("size")).alias("taken" if "taken" not in names else "mix_taken")]
    return mixed.select("row.*", *new)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("source mix", source_mix),
]

#: The decoding of secrets and the binomial bounds are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
