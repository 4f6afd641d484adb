"""Quality rules whose cutoffs limit false rejection, by DataFrame functions only.

A rule rejects a text if its badness (a number that grows with trouble) is over
a cutoff. The cutoffs come from a fixed grid, stated before any label is seen.
For every stratum (language), rule and cutoff, the labelled good documents that
it would reject are counted, and the cutoff is certified if the exact binomial
bound says that its rate of false rejection is below the rule's share of
``ALPHA``: P(Bin(n, alpha) <= rejected) <= ``DELTA`` / number of hypotheses
(Bonferroni). The strictest certified cutoff of each rule holds in its stratum.
So with probability 1 - DELTA, in every stratum at most ``ALPHA`` of the good
documents that pass the base rules are rejected. A stratum without enough labels
gets no cutoff.

Cases: a null or empty text has no words and fails the base rule; a null stratum
is a stratum of its own; an id labelled twice is good only if all labels say so;
null labels and ids do not count; rows that repeat are judged alike; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BLANKS, staged, table

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
ALPHA = 0.02
DELTA = 0.05
#: Terms of the binomial sum that are added one by one; the rest is bounded from above.
SUM_TERMS = 20_000

#: Grid of each rule. Badness: share of symbols in word characters, share of
#: repeated lines, share of words in repeated windows, mean word length, minus
#: mean word length, minus number of words.
GRID = {
    "symbols": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3),
    "dup_lines": (0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeats": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "long_words": (8.0, 9.0, 10.0, 12.0, 15.0),
    "short_words": (-4.0, -3.5, -3.0, -2.5),
    "few_words": (-60.0, -50.0, -40.0, -30.0, -25.0),
}


def with_features(df: DataFrame, text: str) -> DataFrame:
    """``df`` with the features of the column ``text``; helper columns start with ``_q_``."""
    n = REPEAT_WINDOW
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumn("_q_text", F.btrim(t, F.lit(BLANKS)))
    d = d.withColumn("_q_words", F.split("_q_text", r"[\x20\x09-\x0D]+"))
    d = d.withColumn("n_words", F.when(F.col("_q_text") == "", 0).otherwise(F.size("_q_words")).cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate("_q_text", BLANKS, "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).cast("long"))
    d = d.withColumn("_q_lines", F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    d = d.withColumn("n_lines", F.size("_q_lines").cast("long"))
    d = d.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
    # Windows by the 64-bit hash of their words; equal ones stand together after a sort.
    d = d.withColumn("_q_hash", F.when(F.col("n_words") >= n, F.transform(
        F.sequence(F.lit(1), F.col("n_words").cast("int") - (n - 1)), lambda i: F.xxhash64(F.slice("_q_words", i, n)))))
    d = d.withColumn("_q_sorted", F.when(F.size(F.array_distinct("_q_hash")) < F.size("_q_hash"), F.sort_array(
        F.transform("_q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.get(F.col("_q_sorted"), j)["h"] == x["h"]
    found = F.filter("_q_sorted", lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
    d = d.withColumn("_q_at", F.sort_array(F.transform(found, lambda x: x["i"])))
    reach = F.transform("_q_at", lambda x, i: F.least(F.lit(n), F.coalesce(F.get(F.col("_q_at"), i + 1) - x, F.lit(n))))
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    d = d.drop("_q_text", "_q_words", "_q_lines", "_q_hash", "_q_sorted", "_q_at")
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def badness() -> dict:
    mean = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / F.greatest("word_chars", F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
        "long_words": mean,
        "short_words": -mean,
        "few_words": -F.col("n_words").cast("double"),
    }


def log_gamma(z):
    """ln Gamma(z) for z >= 1: Stirling's series at z + 7."""
    w = z + 7
    series = 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w)
    steps = sum((F.log(z + k) for k in range(1, 7)), F.log(z))
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - steps


def binomial_at_most(x, n, p: float):
    """P(Bin(n, p) <= x); 1 where x is not below n * p. If more than ``SUM_TERMS``
    terms would be needed, the rest is bounded by a geometric series."""
    x, n = x.cast("double"), n.cast("double")
    odds = (1 - p) / p
    top = (log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1) + x * math.log(p) + (n - x) * math.log(1 - p))
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total"))
    total = F.aggregate(
        F.sequence(F.lit(0), F.least(x, F.lit(float(SUM_TERMS))).cast("int")), zero,
        lambda acc, j: F.struct((acc["term"] * (x - j) / (n - x + j + 1) * odds).alias("term"),
                                (acc["total"] + acc["term"]).alias("total")),
        lambda acc: acc["total"] + F.when(x > SUM_TERMS, acc["term"] / (1 - x / (n - x + 1) * odds)).otherwise(0.0))
    return F.when(x < n * p, F.exp(top) * total).otherwise(1.0)


def certified_cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                      grid: dict = GRID) -> DataFrame:
    """(stratum, rule, cutoff): the strictest certified cutoff of each rule.
    ``features``: q_id, stratum and the features of all documents."""
    good = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id"))
            .agg(F.min("quality").alias("quality")).where("quality = 1"))
    held = features.where(~F.col("base_failed")).join(good, F.col("q_id") == F.col("l_id"))
    bad = badness()
    tests = [(rule, cut) for rule, cuts in grid.items() for cut in cuts]
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(bad[rule] > cut).alias(f"x{i}") for i, (rule, cut) in enumerate(tests)])
    counts = staged(counts, "quality-counts")
    hypotheses = max(counts.count(), 1) * len(tests)
    each = counts.select("stratum", "n", F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(cut).alias("cutoff"), F.col(f"x{i}").alias("x"))
        for i, (rule, cut) in enumerate(tests)])))
    sure = binomial_at_most(F.col("x"), F.col("n"), alpha / len(grid)) <= delta / hypotheses
    return each.where(sure).groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judged(features: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """``features`` with ``kept``: passes the base rules and every certified cutoff of its stratum."""
    cuts = certified_cutoffs(features, labels, **limits).groupBy(F.col("stratum").alias("c_stratum")).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    rejected = F.lit(False)
    for rule, value in badness().items():
        rejected = rejected | F.coalesce(value > F.col("cuts")[rule], F.lit(False))
    return (features.join(cuts, F.col("stratum") == F.col("c_stratum"), "left")
            .withColumn("kept", ~F.col("base_failed") & ~rejected).drop("cuts", "c_stratum"))


def _stratum(lang):
    return F.when(lang.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), lang)).alias("stratum")


def quality_verdicts(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Features and ``kept`` of every row (q_id: its doc_id)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("q_id"), _stratum(docs["lang"]), docs["text"].alias("q_text"))
    return judged(staged(with_features(rows, "q_text").drop("q_text"), "quality"), labels, **limits)


def quality_filter(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """``docs`` without rejected rows."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("q_id"),
                       _stratum(docs["lang"]))
    return judged(staged(with_features(rows, "row.text"), "quality"), labels, **limits).where("kept").select("row.*")


def op8_risk_controlled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        F.col("q_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")
