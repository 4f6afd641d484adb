"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share ``TOTAL_SHARE`` of all words; a target stops at ``MAX_COPIES`` times its
source's words and the excess is shared anew by weight until none is above.
A document's expected copies are its source's target over its size, times the
document's weight if a weight column is given; the whole part is taken for
certain, the rest is its inclusion probability p. Documents are ranked by their
random odds over their inclusion odds, u/(1-u) / (p/(1-p)), and the first ones
are taken until the source's words come nearest to the target. The u come from
the md5 of id and seed, so reruns agree.

The rank's running total needs no sort of a source in one task: words are summed
by source and by ``BINS`` slices of the rank, the slice in which the target falls
is found by a running sum over the slices, and inside it again by ``BINS`` slices
of it; only documents of that slice are ordered. What comes out is one rank per
source up to which documents are taken, so the texts are never shuffled by it.

Cases: a null or empty text has size 0 and takes 0 words; a null source is a
source of its own, the last; rows that repeat an id have the same rank and are
taken alike; documents without id use their text's md5; a null or negative weight
counts as 0; an empty table gives an empty result; columns of the input that clash
with results do not matter, as rows are packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import staged, table

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_COPIES = 2
BINS = 2048
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source):
    """A source as a text that is never null and differs for null and ''."""
    return F.when(source.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), source))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``pos``, their place in code point order, null last: a range
    partitioning, a row number in each partition and the sizes of those before."""
    spread = staged(sources.repartitionByRange(F.col("source").isNull(), "source")
                    .withColumn("part", F.spark_partition_id()), "sources")
    sizes = spread.groupBy("part").count()
    before = sizes.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    return spread.join(before, "part").withColumn("pos", F.col("before") + place - 1).drop("part", "before")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """(key, source_size, target, mean_w) from ``sizes`` (source, size, w); mean_w
    is the mean weight of the source's words."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("w") * F.col("size")).alias("mass"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    s = staged(_ranked(per).withColumn("weight", cycle).withColumn("cap", F.col("source_size") * float(max_copies)), "targets")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level only rises; each step is one sum over the sources
        full = F.col("weight") * level >= F.col("cap")
        capped, free = s.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)),
                             F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        rise = (total * total_share - capped) / free if free else None
        if rise is None:
            level = float("inf")
        if rise is None or rise <= level:
            break
        level = rise
    return s.select(_source_key(F.col("source")).alias("key"), "source_size",
                    F.least(F.col("cap"), F.col("weight") * level).alias("target"),
                    F.when(F.col("source_size") > 0, F.col("mass") / F.col("source_size")).alias("mean_w"))


def _document(row: str, seed: str, weight_col: str | None):
    """Key of the source, size, u and weight of the packed column ``row``."""
    own = F.coalesce(F.col(f"{row}.doc_id").cast("string"), F.md5(F.coalesce(f"{row}.text", F.lit("")).cast("binary")))
    digits = F.substring(F.md5(F.concat(own, F.lit(f":{seed}")).cast("binary")), 1, 12)
    w = F.coalesce(F.col(f"{row}.{weight_col}").cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    return [_source_key(F.col(f"{row}.source")).alias("key"), word_count(F.col(f"{row}.text")).alias("size"),
            ((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)).alias("u"), F.greatest(w, F.lit(0.0)).alias("w")]


def _with_rank(d: DataFrame, max_copies: int) -> DataFrame:
    """Adds ``sure`` (certain copies) and ``rank``, random odds over inclusion odds
    as a number from 0 to 1; null where no further copy may be drawn."""
    expected = F.when((F.col("source_size") > 0) & (F.col("mean_w") > 0), F.least(
        F.lit(float(max_copies)), F.col("target") / F.col("source_size") * (F.col("w") / F.col("mean_w")))).otherwise(0.0)
    d = d.withColumn("expected", expected).withColumn("sure", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("sure")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return d.withColumn("rank", F.when((p > 0) & (F.col("size") > 0), odds / (1 + odds)))


def _crossing(slices: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """For each source the slice in which the running total of ``words`` reaches
    the goal, with the total before it (``had``) and its words."""
    upto = F.sum("words").over(Window.partitionBy("key").orderBy(*by))
    return (slices.withColumn("upto", upto).join(start, "key")
            .withColumn("had", F.col("had") + F.col("upto") - F.col("words"))
            .where((F.col("had") < F.col("goal")) & (F.col("had") + F.col("words") >= F.col("goal")))
            .select("key", *by, "goal", "had", "words"))


def sampling_plan(narrow: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES, bins: int = BINS) -> DataFrame:
    """``targets`` with ``until``, the rank up to which a source's documents get
    one more copy (null: all of them), and ``with_last``, whether that rank itself does."""
    d = _with_rank(narrow.join(targets, "key"), max_copies)
    start = d.groupBy("key").agg(F.max("target").alias("goal"), F.sum(F.col("sure") * F.col("size")).cast("double").alias("had"))
    level1 = F.floor(F.col("rank") * bins).cast("long")
    level2 = F.floor((F.col("rank") * bins - F.floor(F.col("rank") * bins)) * bins).cast("long")
    ranked = staged(d.where("rank is not null").select("key", "size", "rank", level1.alias("a"), level2.alias("b"))
                    .groupBy("key", "a", "b", "rank").agg(F.sum("size").alias("words")), "ranks")
    start = staged(start, "start")
    one = _crossing(ranked.groupBy("key", "a").agg(F.sum("words").alias("words")), start, ["a"])
    inside = ranked.join(one.select("key", "a"), ["key", "a"])
    two = _crossing(inside.groupBy("key", "a", "b").agg(F.sum("words").alias("words")), one.select("key", "goal", "had"), ["a", "b"])
    last = inside.join(two.select("key", "a", "b"), ["key", "a", "b"])
    three = _crossing(last.select("key", "rank", "words"), two.select("key", "goal", "had"), ["rank"])
    over, under = F.col("had") + F.col("words") - F.col("goal"), F.col("goal") - F.col("had")
    return targets.join(three.select("key", F.col("rank").alias("until"), (over <= under).alias("with_last")), "key", "left")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE, max_copies: int = MAX_COPIES,
        weight_col: str | None = None, seed: str = SEED, bins: int = BINS) -> DataFrame:
    """(row, size, source_size, target, copies) for every row of ``docs``, which
    must have doc_id, text and source; ``row`` holds all its columns."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    narrow = staged(packed.select(*_document("row", seed, weight_col)), "mix")
    sizes = narrow.select(F.when(F.col("key") != "none", F.expr("substring(key, 2)")).alias("source"), "size", "w")
    targets = source_targets(sizes, weights, total_share, max_copies)
    plan = staged(sampling_plan(narrow, targets, max_copies, bins), "mix-plan")
    d = _with_rank(packed.select("row", *_document("row", seed, weight_col)).join(plan, "key"), max_copies)
    drawn = F.col("rank").isNotNull() & (F.col("until").isNull() | (F.col("rank") < F.col("until"))
                                         | (F.col("with_last") & (F.col("rank") == F.col("until"))))
    return d.select("row", "size", "source_size", "target", (F.col("sure") + drawn.cast("long")).alias("copies"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in one statement: the level of the targets in closed form, the ranks in one sort of a source.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) || ':mix'), 1, 12) AS BIGINT)::DOUBLE + 0.5)
           / 281474976710656.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::BIGINT AS cap,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM d GROUP BY source),
k AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS n,
         sum(cap) OVER (ORDER BY cap / weight, source) - cap AS capped,
         sum(weight) OVER (ORDER BY cap / weight DESC, source DESC) AS free
  FROM s),
lv AS (
  SELECT min((1.5 * (SELECT sum(source_size) FROM s) - capped) / free) AS level FROM k
  WHERE n = (SELECT min(n) FROM k WHERE (1.5 * (SELECT sum(source_size) FROM s) - capped) / free < cap / weight)),
t AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM lv), 'infinity'::DOUBLE)) AS target FROM s),
e AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(2.0, t.target / t.source_size) ELSE 0.0 END AS expected
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, floor(expected)::BIGINT AS sure, expected - floor(expected) AS p,
         CASE WHEN expected > floor(expected) AND size > 0
              THEN (u / (1 - u)) / ((expected - floor(expected)) / (1 - (expected - floor(expected)))) END AS odds
  FROM e),
c AS (
  SELECT *, odds / (1 + odds) AS rank,
         sum(sure * size) OVER (PARTITION BY source)
           + sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST) AS upto,
         sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source, odds / (1 + odds)) AS words
  FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       size::BIGINT * (sure + CASE WHEN rank IS NOT NULL AND upto - words < target
                                        AND (upto <= target OR upto - target <= target - (upto - words)) THEN 1 ELSE 0 END) AS taken
FROM c
"""
