"""Toxicity from subword-bag embeddings and a linear softmax.

A word is the mean of the embeddings of its hashed character 3- to 5-grams (word
edges included), so an unseen misspelling shares most vectors with its word. A
text is the mean of its words, and a linear softmax on it gives the two classes.
Embeddings and softmax are trained jointly in numpy (Adam) on a bounded sample of
labelled texts: at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` clean ones,
those whose ids hash lowest; the classes' share of all labels corrects the bias.
The model is linear in the n-grams, so a task needs one number per n-gram
bucket, and scoring covers every whole text.

Cases: a null or empty text has an empty bag and gets the bias alone; a doc_id
labelled twice is toxic if one label says so; null labels and ids are not
learned from; rows that repeat are scored row by row; without labels every
score is 0.5; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPLIT_BLANKS_LOWER, encode_words, id_remainder, table, text_slices

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5)
KEEP = 0.2
SAMPLE_TOXIC = 1800
SAMPLE_CLEAN = 3200
STEPS = 100
RATE = 0.1
_U = np.uint64


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of every n-gram of every word; the word's edges count as one character each."""
    points = np.frombuffer(("\n" + "\n".join(w.decode() for w in words.to_pylist()) + "\n").encode("utf-32-le"), dtype=np.uint32)
    edge = points == 10
    edges = np.cumsum(edge)
    buckets, owner = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        last = len(points) - n + 1
        h = np.full(last, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ points[k:last + k].astype(_U)) * _U(0x9E3779B97F4A7C15)
            h ^= h >> _U(29)
        # An edge may be the first or the last character, not one between.
        inner = edges[n - 2:last + n - 2] - edges[:last] == 0
        at = np.flatnonzero(inner & ~(edge[:last] & edge[n - 1:last + n - 1] & (n < 3)))
        buckets.append((h[at] % _U(BUCKETS)).astype(np.int64))
        owner.append(edges[at + 1] - 1)
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owner)


def _means(values: np.ndarray, owner: np.ndarray, size: int) -> np.ndarray:
    n = np.bincount(owner, minlength=size)
    return np.bincount(owner, weights=values, minlength=size) / np.maximum(n, 1)


class _Bags:
    """N-grams of the words and words of some texts."""

    def __init__(self, texts: list[bytes]):
        self.ids, words, counts = encode_words(texts, SPLIT_BLANKS_LOWER)
        self.n_words, self.n_texts = len(words), len(texts)
        self.grams, self.word = word_grams(words) if len(words) else (np.zeros(0, np.int64),) * 2
        self.text = np.repeat(np.arange(len(texts)), counts)

    def logits(self, per_bucket: np.ndarray, bias: float, keep=slice(None)) -> np.ndarray:
        word = _means(per_bucket[self.grams], self.word, self.n_words)
        return _means(word[self.ids[keep]], self.text[keep], self.n_texts) + bias

    def back(self, err: np.ndarray, keep=slice(None)) -> np.ndarray:
        """Gradient by bucket of the texts' gradients ``err``."""
        ids, text = self.ids[keep], self.text[keep]
        size = np.maximum(np.bincount(text, minlength=self.n_texts), 1)
        word = np.bincount(ids, weights=(err / size)[text], minlength=self.n_words)
        size = np.maximum(np.bincount(self.word, minlength=self.n_words), 1)
        return np.bincount(self.grams, weights=(word / size)[self.word], minlength=BUCKETS)


def fit(texts: list[bytes], toxic: np.ndarray, steps: int = STEPS, rate: float = RATE, seed: int = 5) -> tuple[np.ndarray, float]:
    """(difference of the two logits for each bucket, its bias) of the jointly
    trained embeddings E (buckets x DIM) and softmax weights W (DIM x 2). Every
    step sees a random ``KEEP`` of the words of each text, against overfitting."""
    rng = np.random.default_rng(seed)
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    if not 0 < toxic.sum() < len(texts):
        return np.zeros(BUCKETS), 0.0
    bags = _Bags(texts)
    state = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in (("E", E), ("W", W), ("b", bias))}
    for step in range(1, steps + 1):
        keep = np.flatnonzero(rng.random(len(bags.ids)) < KEEP)
        diff = W[:, 1] - W[:, 0]
        logit = bags.logits(E @ diff, float(bias[1] - bias[0]), keep)
        err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic) / len(texts)
        by_bucket = bags.back(err, keep).astype(np.float32)
        g_diff = E.T @ by_bucket
        grads = {"E": by_bucket[:, None] * diff + 1e-7 * E, "W": np.stack((-g_diff, g_diff), axis=1) + 1e-5 * W,
                 "b": np.array([-err.sum(), err.sum()], dtype=np.float32)}
        for k, x in (("E", E), ("W", W), ("b", bias)):
            m, v = state[k]
            m += 0.1 * (grads[k] - m)
            v += 0.01 * (grads[k] ** 2 - v)
            x -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return (E @ (W[:, 1] - W[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def probabilities(texts: list[bytes], per_bucket: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_Bags(texts).logits(per_bucket, bias), -500, 500)))


def usable_labels(labels: DataFrame, fold: tuple[int, int]) -> DataFrame:
    """(doc_id, toxic) outside the held-out fold, a row per id."""
    return (labels.where("doc_id is not null and toxic is not null")
            .where(id_remainder(F.col("doc_id"), fold[0]) != fold[1])
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))


def labelled_sample(docs: DataFrame, known: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(text, toxic) of the lowest-hashed ids of ``known``: at most ``n_toxic`` +
    ``n_clean`` of them, so the hint to broadcast them is bounded."""
    order = F.xxhash64("doc_id", F.lit(3))
    picked = (known.where("toxic = 1").orderBy(order).limit(n_toxic)
              .union(known.where("toxic = 0").orderBy(order).limit(n_clean))
              .select(F.col("doc_id").alias("picked_id"), "toxic"))
    return (docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id"))
            .groupBy("picked_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).orderBy("picked_id")
            .select("text", "toxic"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0),
                    n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, steps: int = STEPS) -> DataFrame:
    """(doc_id, held_out, score) for every row of ``docs``."""
    spark = docs.sparkSession
    known = usable_labels(labels, fold)
    sample = labelled_sample(docs, known, n_toxic, n_clean).collect()
    toxic = np.array([r["toxic"] for r in sample], dtype=np.float64)
    per_bucket, bias = fit([(r["text"] or "").encode() for r in sample], toxic, steps)
    if 0 < toxic.sum() < len(toxic):
        n, n_all = known.agg(F.sum("toxic"), F.count(F.lit(1))).first()
        bias += float(np.log(n / (n_all - n)) - np.log(toxic.mean() / (1 - toxic.mean())))
    model = spark.sparkContext.broadcast((per_bucket, bias))
    held = (id_remainder(F.col("doc_id"), fold[0]) == fold[1]).alias("held_out")

    def score(batches):
        for b in batches:
            for first, texts in text_slices(b, 1):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, len(texts)), b.column(2).slice(first, len(texts)),
                     pa.array(probabilities(texts, *model.value))], ["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held).mapInArrow(
        score, "doc_id long, held_out boolean, score double")


def op4_subword_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
