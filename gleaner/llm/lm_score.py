"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Two layers, both log-bilinear, factor the softmax. The first predicts a class: the
``HEAD_CLASSES`` commonest words and the end of a text are classes of their own,
``TAIL_CLASSES`` classes hold all other words by their last bytes. From the two
classes before it the context vector is ``c1 * R[one back] + c2 * R[two back]``,
and a class scores its product with ``Q[class]`` plus a bias. The second predicts
the word inside a tail class: the ``own_words`` commonest words, ever more of them
as the corpus grows (``OWN_SCALE * tokens ** OWN_POWER``), have a vector and a bias
each, scored against a vector of the class one back; one further slot of each class
stands for its rarer words, among which a word has its add-one share, unknown words
together one. So the probabilities of all words, the unknown and the end sum to one.
At 10^13 tokens some 2.6 million words have vectors (about 180 MB in a task).

Training covers every training text. Each of ``ROUNDS`` rounds takes its share of
the texts (by hash), every partition runs NCE in numpy from the common
parameters over its tokens, and the changes are averaged, weighted by tokens.
Counts cover every training text; only the ``LOOKUP_WORDS`` commonest (or those
with vectors, if more) are broadcast, all other words of a text meet their counts in a join (no such word is
common, so the join has no hot key).

Cases: null and empty texts are one end token; rows that repeat are scored (and
counted) row by row; a row without doc_id counts as id '' for the split; without
any training row all counts are zero and the model is uniform over its classes;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import copy
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPLIT_BLANKS_LOWER, encode_words, id_remainder, segment_sums, staged, table, text_slices

HEAD_CLASSES = 639
TAIL_CLASSES = 128
DIM = 16
NOISE = 32
#: Noise words of each token inside its class.
NOISE_WORDS = 4
OWN_SCALE, OWN_POWER = 16, 0.4
BATCH = 2048
ROUNDS = 3
RATE = 0.05
#: Words whose counts are sent to every task (some 20 bytes each).
LOOKUP_WORDS = 120_000
END = ""  # no word is empty


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``docs`` (text); the end token is the empty word."""

    def count(batches):
        for b in batches:
            for _, texts in text_slices(b, 0):
                ids, words, _ = encode_words(texts, SPLIT_BLANKS_LOWER)
                n = np.append(np.bincount(ids, minlength=len(words)), len(texts))
                names = pa.concat_arrays([words.cast(pa.binary()), pa.array([b""], pa.binary())]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(n.astype(np.int64))], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of ``counts`` with at least some count, the lowest that leaves
    ``limit`` or fewer; found with a histogram over steps of an eighth of a power of two."""
    step = F.floor(8 * F.log2("n"))
    kept, least = 0, None
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        kept += r["count"]
        if kept > limit:
            break
        least = r["step"]
    return counts.where(step >= least) if least is not None else counts.limit(0)


def own_words(tokens: int) -> int:
    """Number of words with vectors of their own for a corpus of ``tokens`` tokens."""
    return max(HEAD_CLASSES, int(OWN_SCALE * tokens ** OWN_POWER))


class Vocabulary:
    """Class and slot of every word. Classes: 0 the end, then the head words, then
    the tail classes. Slots: for each tail class its rarer words, then its own words."""

    def __init__(self, words: list[bytes], head: int = HEAD_CLASSES, tails: int = TAIL_CLASSES):
        self.head, self.tails = min(head, len(words)), tails
        self.size, self.first_tail = 1 + self.head + tails, 1 + self.head
        self.words = pa.array(words, pa.large_binary())
        tail = np.array([zlib.crc32(w[-3:]) % tails for w in words[self.head:]], dtype=np.int64)
        #: First slot of each tail class, and the number of slots.
        self.first = np.arange(tails + 1) + np.concatenate(([0], np.cumsum(np.bincount(tail, minlength=tails))))
        order = np.argsort(tail, kind="stable")
        slot = np.empty(len(tail), dtype=np.int64)
        slot[order] = np.arange(len(tail)) + tail[order] + 1
        self.class_of = np.concatenate((np.arange(1, self.first_tail), self.first_tail + tail))
        self.slot_of = np.concatenate((np.full(self.head, -1), slot))

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(class, slot) by word; head words have slot -1."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)
        rare = np.flatnonzero(at < 0)
        tail = np.array([zlib.crc32(words[i].as_py()[-3:]) % self.tails for i in rare], dtype=np.int64)
        classes, slots = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        classes[at >= 0], slots[at >= 0] = self.class_of[at[at >= 0]], self.slot_of[at[at >= 0]]
        classes[rare], slots[rare] = self.first_tail + tail, self.first[tail]
        return classes, slots


def _contexts(texts: list[bytes], vocabulary: Vocabulary):
    """(one back, two back, class, slot) of every token of the texts, ends included
    (slot -1); before a text stands the end's class. Also words, dictionary and
    counts, and the slots of the dictionary."""
    ids, words, counts = encode_words(texts, SPLIT_BLANKS_LOWER)
    of, slot_of = vocabulary.of(words)
    ends = np.cumsum(counts + 1) - 1
    tokens = np.zeros(len(ids) + len(texts), dtype=np.int64)
    slots = np.full(len(tokens), -1, dtype=np.int64)
    inner = np.ones(len(tokens), dtype=bool)
    inner[ends] = False
    tokens[inner], slots[inner] = of[ids], slot_of[ids]
    starts = ends - counts
    one = np.concatenate(([0], tokens[:-1]))
    two = np.concatenate(([0, 0], tokens[:-2]))[:len(tokens)]
    two[np.minimum(starts + 1, ends)] = 0
    one[starts] = two[starts] = 0
    return one, two, tokens, slots, ids, words, counts, of, slot_of


def _by_row(index: np.ndarray, grad: np.ndarray, factor: np.ndarray | None = None):
    """Distinct rows of ``index`` and the sums of their gradients. With ``factor``,
    the gradient of the n-th is ``factor[n]`` times its row of ``grad``, every row of
    which is used by as many in turn: the products are made in order at once."""
    narrow = index.astype(np.uint16) if index.size and index.max() < 1 << 16 else index
    order = np.argsort(narrow, kind="stable")
    index = index[order]
    cut = np.flatnonzero(np.concatenate(([True], np.diff(index) != 0)))
    if factor is None:
        rows = grad.take(order, axis=0)
    else:
        rows = grad.take(order // (len(index) // len(grad)), axis=0)
        rows *= factor.take(order)[:, None]
    return index[cut], np.add.reduceat(rows, cut, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), worked out in one array."""
    out = np.clip(x, -30, 30)
    np.negative(out, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _step(param, square, index, grad, rate):
    """AdaGrad on some (distinct) rows of a parameter; ``take`` reads rows several
    times faster than an index does."""
    new = square.take(index, axis=0) + grad * grad
    square[index] = new
    param[index] = param.take(index, axis=0) - rate * grad / np.sqrt(new)


class Model:
    """Parameters of the log-bilinear model."""

    def __init__(self, frequency: np.ndarray, dim: int = DIM, seed: int = 17):
        rng = np.random.default_rng(seed)
        k = len(frequency)
        self.R = rng.normal(0, 0.1, (k, dim)).astype(np.float32)
        self.Q = rng.normal(0, 0.1, (k, dim)).astype(np.float32)
        self.c = np.ones((2, dim), dtype=np.float32) * np.float32(0.7)
        self.bias = np.log(frequency).astype(np.float32)

    def train(self, one, two, target, noise_p: np.ndarray, rng, noise: int = NOISE, rate: float = RATE, squares=None):
        """One pass of noise-contrastive estimation with the noise classes shared by a batch."""
        k = len(noise_p)
        log_noise = np.log(noise * noise_p).astype(np.float32)
        cumulative = np.cumsum(noise_p)
        squares = squares or [np.full(x.shape, 1e-8, np.float32) for x in (self.R, self.Q, self.c, self.bias)]
        sq_r, sq_q, sq_c, sq_b = squares

        for at in range(0, len(target), BATCH):
            i, j, w = one[at:at + BATCH], two[at:at + BATCH], target[at:at + BATCH]
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(noise) * cumulative[-1]), k - 1)
            ri, rj, qw, qn = (x.take(at_rows, axis=0) for x, at_rows in ((self.R, i), (self.R, j), (self.Q, w), (self.Q, drawn)))
            ctx = ri * self.c[0] + rj * self.c[1]
            pos = np.einsum("ij,ij->i", ctx, qw) + self.bias[w] - log_noise[w]
            neg = ctx @ qn.T + (self.bias[drawn] - log_noise[drawn])
            g_pos = -_sigmoid(-pos)  # of the loss by the score
            g_neg = _sigmoid(neg)
            scale = np.float32(1 / len(w))
            g_ctx = (g_pos[:, None] * qw + g_neg @ qn) * scale
            wi, gq = _by_row(w, np.concatenate((g_pos[:, None] * ctx, g_pos[:, None]), axis=1) * scale)
            ri_, gi = _by_row(np.concatenate((i, j)), np.concatenate((g_ctx * self.c[0], g_ctx * self.c[1])))
            gn = np.concatenate((g_neg.T @ ctx, g_neg.sum(axis=0)[:, None]), axis=1) * scale
            ni, gn = _by_row(drawn, gn)
            gc = np.stack(((g_ctx * ri).sum(axis=0), (g_ctx * rj).sum(axis=0)))
            for index, g in ((wi, gq), (ni, gn)):
                _step(self.Q, sq_q, index, g[:, :-1], rate)
                _step(self.bias, sq_b, index, g[:, -1], rate)
            _step(self.R, sq_r, ri_, gi, rate)
            _step(self.c, sq_c, np.arange(2), gc, rate)
        return squares

    def log_tables(self, block: int = 32):
        """log P(w | i one back, j two back) = a[i, w] + b[j, w] - z[i, j]."""
        a = (self.R * self.c[0]) @ self.Q.T + self.bias
        b = (self.R * self.c[1]) @ self.Q.T
        z = np.empty((len(a), len(b)), dtype=np.float32)
        top = b.max(axis=1)
        eb = np.exp(b - top[:, None])
        for at in range(0, len(a), block):
            hi = a[at:at + block].max(axis=1)
            z[at:at + block] = np.log(np.exp(a[at:at + block] - hi[:, None]) @ eb.T) + hi[:, None] + top
        return a.astype(np.float32), b.astype(np.float32), z


class WordLayer:
    """Parameters of the words inside the tail classes: a word's slot scores
    ``U[class one back] . Q[slot]`` plus its bias against the slots of its class."""

    def __init__(self, vocabulary: Vocabulary, mass: np.ndarray, dim: int = DIM, seed: int = 19):
        rng = np.random.default_rng(seed)
        self.first = vocabulary.first
        sizes = np.diff(self.first)
        share = mass / np.repeat(np.add.reduceat(mass, self.first[:-1]), sizes)
        noise = share ** 0.75
        self.noise = noise / np.repeat(np.add.reduceat(noise, self.first[:-1]), sizes)
        self.U = rng.normal(0, 0.1, (vocabulary.size, dim)).astype(np.float32)
        #: Vector and, in the last column, bias of every slot.
        self.Q = np.concatenate((rng.normal(0, 0.1, (len(mass), dim)), np.log(share)[:, None]), axis=1).astype(np.float32)

    def train(self, one, tail, slot, rng, noise: int = NOISE_WORDS, rate: float = RATE, squares=None):
        """One pass of noise-contrastive estimation over tokens of tail classes;
        the noise of a token is drawn from its own class."""
        squares = squares or [np.full(x.shape, 1e-8, np.float32) for x in (self.U, self.Q)]
        sq_u, sq_q = squares
        log_noise = np.log(noise * self.noise).astype(np.float32)
        cumulative = np.cumsum(self.noise)  # every class adds one
        for at in range(0, len(slot), BATCH):
            i, k, w = one[at:at + BATCH], tail[at:at + BATCH], slot[at:at + BATCH]
            drawn = np.searchsorted(cumulative, k[:, None] + rng.random((len(w), noise)), side="right")
            drawn = np.clip(drawn, self.first.take(k)[:, None], self.first.take(k + 1)[:, None] - 1)
            both = np.concatenate((w[:, None], drawn), axis=1)
            ctx, q = np.ones((len(i), self.Q.shape[1]), np.float32), self.Q.take(both, axis=0)
            ctx[:, :-1] = self.U.take(i, axis=0)
            z = np.einsum("td,tnd->tn", ctx, q) - log_noise.take(both)
            g = _sigmoid(z)
            g[:, 0] -= 1
            g *= np.float32(1 / len(w))
            ui, gu = _by_row(i, np.einsum("tn,tnd->td", g, q[:, :, :-1]))
            qi, gq = _by_row(both.ravel(), ctx, g.ravel())
            _step(self.Q, sq_q, qi, gq, rate)
            _step(self.U, sq_u, ui, gu, rate)
        return squares

    def log_norm(self) -> np.ndarray:
        """Log of the sum over the slots of a tail class, by class one back and tail class."""
        out = np.empty((len(self.U), len(self.first) - 1), dtype=np.float32)
        for k, (a, b) in enumerate(zip(self.first, self.first[1:])):
            scores = self.U @ self.Q[a:b, :-1].T + self.Q[a:b, -1]
            top = scores.max(axis=1)
            out[:, k] = np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top
        return out

    def log_p(self, norm: np.ndarray, one, tail, slot) -> np.ndarray:
        """log P(slot | tail class, class one back) by token."""
        out = np.empty(len(slot), dtype=np.float64)
        for at in range(0, len(slot), 1 << 16):
            i, k, w = (x[at:at + (1 << 16)] for x in (one, tail, slot))
            u, q = self.U.take(i, axis=0), self.Q.take(w, axis=0)
            out[at:at + (1 << 16)] = np.einsum("td,td->t", u, q[:, :-1]) + q[:, -1] - norm.take(i * norm.shape[1] + k)
        return out


_PIECE = 4096
#: Partitions whose changes one task adds up.
_FAN_IN = 64


def _arrays(model: Model, layer: WordLayer) -> list[np.ndarray]:
    return [model.R, model.Q, model.c, model.bias, layer.U, layer.Q]


def _flat(model: Model, layer: WordLayer) -> np.ndarray:
    return np.concatenate([x.ravel() for x in _arrays(model, layer)])


def _add(key, rows):
    total = np.sum([np.frombuffer(x, dtype=np.float32) for x in rows["sums"]], axis=0, dtype=np.float64)
    out = rows.iloc[:1].copy()
    out["tokens"], out["sums"] = rows["tokens"].sum(), [total.astype(np.float32).tobytes()]
    return out


def fit(train: DataFrame, vocabulary: Vocabulary, frequency: np.ndarray, mass: np.ndarray,
        rounds: int = ROUNDS) -> tuple[Model, WordLayer]:
    """Train on every row of ``train`` (text, share); ``frequency``: class
    probabilities, ``mass``: counts by slot, all above 0."""
    spark = train.sparkSession
    model, layer = Model(frequency), WordLayer(vocabulary, mass)
    noise_p = frequency ** 0.75
    noise_p /= noise_p.sum()
    for r in range(rounds):
        state = spark.sparkContext.broadcast((model, layer, vocabulary, noise_p))

        def part(batches):
            start, start_layer, vocabulary, noise_p = state.value
            local, words = copy.deepcopy(start), copy.deepcopy(start_layer)
            tokens, squares, word_squares = 0, None, None
            rng = np.random.default_rng(29)
            for b in batches:
                for _, texts in text_slices(b, 0):
                    one, two, target, slots, *_ = _contexts(texts, vocabulary)
                    order = rng.permutation(len(target))
                    squares = local.train(one[order], two[order], target[order], noise_p, rng, squares=squares)
                    order = order[slots[order] >= 0]
                    word_squares = words.train(one[order], target[order] - vocabulary.first_tail, slots[order], rng,
                                               squares=word_squares)
                    tokens += len(target)
            if tokens:
                change = (_flat(local, words) - _flat(start, start_layer)) * np.float32(tokens)
                cuts = [c for c in range(0, len(change), _PIECE) if c == 0 or change[c:c + _PIECE].any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c // _PIECE for c in cuts], pa.int32()), pa.array([tokens] * len(cuts), pa.int64()),
                     pa.array([change[c:c + _PIECE].tobytes() for c in cuts], pa.binary())], ["piece", "tokens", "sums"])

        schema = "piece int, salt int, tokens long, sums binary"
        salt = F.floor(F.spark_partition_id() / _FAN_IN).cast("int")
        got = (train.where(F.pmod("share", F.lit(rounds)) == r).select("text")
               .mapInArrow(part, "piece int, tokens long, sums binary").withColumn("salt", salt)
               .groupBy("piece", "salt").applyInPandas(_add, schema)
               .groupBy("piece").applyInPandas(_add, schema).collect())
        if got:
            # The first piece comes from every partition, so it carries all tokens.
            total = next(x["tokens"] for x in got if x["piece"] == 0)
            flat = _flat(model, layer).astype(np.float64)
            for x in got:
                sums = np.frombuffer(x["sums"], dtype=np.float32).astype(np.float64)
                flat[x["piece"] * _PIECE:x["piece"] * _PIECE + len(sums)] += sums / total
            at = 0
            for x in _arrays(model, layer):
                x[...] = flat[at:at + x.size].reshape(x.shape)
                at += x.size
        state.destroy()
    return model, layer


@dataclass
class Learned:
    """A trained model with the counts it was trained on."""

    vocabulary: Vocabulary
    model: Model
    layer: WordLayer
    counts: DataFrame  # (word, n) of all training words
    top: list  # the commonest rows of ``counts``
    total: int
    distinct: int
    end_count: int
    rest_share: np.ndarray  # by tail class: counts, words and one of its rarer words


def learn(train: DataFrame, rounds: int = ROUNDS, head: int = HEAD_CLASSES, own: int | None = None) -> Learned:
    """Count and train on every row of ``train`` (text, share: any hash of the row);
    ``own`` words have vectors, by default as many as ``own_words`` gives for the corpus."""
    counts = staged(word_counts(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    end_count = (counts.where(F.col("word") == END).first() or {"n": 0})["n"]
    own = own_words(total) if own is None else own
    top = sorted(common_words(counts, max(LOOKUP_WORDS, own)).collect(), key=lambda r: (-r["n"], r["word"]))
    picked = [r for r in top if r["word"] != END][:own]
    vocabulary = Vocabulary([r["word"].encode() for r in picked], head)
    n_own = np.array([r["n"] for r in picked], dtype=np.float64)
    last = F.expr("substring(cast(word as binary), -3, 3)")
    headed = [r["word"] for r in picked[:vocabulary.head]]
    tails = (counts.where(~F.col("word").isin(headed + [END]))
             .groupBy((F.crc32(last) % TAIL_CLASSES).alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect())
    n_tail, v_tail = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in tails:
        n_tail[r["k"]], v_tail[r["k"]] = r["n"], r["v"]
    of = vocabulary.class_of[vocabulary.head:] - vocabulary.first_tail
    slot_n, at = np.zeros(vocabulary.first[-1]), vocabulary.slot_of[vocabulary.head:]
    slot_n[at] = n_own[vocabulary.head:]
    n_rest = n_tail - np.bincount(of, weights=n_own[vocabulary.head:], minlength=TAIL_CLASSES)
    slot_n[vocabulary.first[:-1]] = n_rest
    rest_share = n_rest + v_tail - np.bincount(of, minlength=TAIL_CLASSES) + 1
    mass = np.concatenate(([end_count], n_own[:vocabulary.head], n_tail))
    frequency = (mass + 1) / (mass + 1).sum()
    model, layer = fit(train, vocabulary, frequency, slot_n + 1, rounds)
    return Learned(vocabulary, model, layer, counts, top, total, distinct, end_count, rest_share)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: tuple[int, int] = (7, 2),
              rounds: int = ROUNDS, learned: Learned | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (add-one unigram) and score (the model), log10 of the whole text. The model is
    learnt from the rows outside the fold unless one is given."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       (id_remainder(F.col(id_col), fold[0]) == fold[1]).alias("held_out"))
    if learned is None:
        learned = learn(rows.where(~F.col("held_out")).withColumn("share", F.xxhash64("doc_id", "text")), rounds)
    counts, total, distinct, end_count = learned.counts, learned.total, learned.distinct, learned.end_count
    known = pa.array([r["word"].encode() for r in learned.top], pa.large_binary())
    log_count = np.append(np.log10(np.array([r["n"] for r in learned.top], dtype=np.float64) + 1), 0.0)
    state = spark.sparkContext.broadcast((learned.vocabulary, learned.model.log_tables(), learned.layer, learned.layer.log_norm(),
                                          known, log_count, np.log10(learned.rest_share)))

    def score(batches):
        vocabulary, (a, b, z), layer, norm, known, log_count, log_share = state.value
        first_tail = vocabulary.first_tail
        for batch in batches:
            for first, texts in text_slices(batch, 1):
                one, two, target, slots, ids, words, counts, of, slot_of = _contexts(texts, vocabulary)
                log_p = (a.take(one * len(z) + target) + b.take(two * len(z) + target) - z.take(one * len(z) + two)).astype(np.float64)
                inner = np.flatnonzero(slots >= 0)
                log_p[inner] += layer.log_p(norm, one[inner], target[inner] - first_tail, slots[inner])
                at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                unseen = at < 0
                logs = log_count[at]  # of -1: 0.0, joined later
                tail = np.maximum(of - first_tail, 0)
                rare = (slot_of >= 0) & (slot_of == vocabulary.first[tail])
                in_rest = np.where(rare, logs - log_share[tail], 0.0)
                base = segment_sums(logs[ids], counts) + np.log10(end_count + 1)
                model_score = segment_sums(log_p, counts + 1) / np.log(10) + segment_sums(in_rest[ids], counts)
                seen = segment_sums((~unseen)[ids].astype(np.int64), counts) + (end_count > 0)
                # The other words: (text, word) with how often.
                text = np.repeat(np.arange(len(texts)), counts)[unseen[ids]]
                pair, n = np.unique(text * len(words) + ids[unseen[ids]], return_counts=True)
                per = np.bincount(pair // max(len(words), 1), minlength=len(texts))
                offs = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
                rest = words.take(pa.array(pair % max(len(words), 1))).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)),
                     pa.array(counts + 1), pa.array(seen), pa.array(base), pa.array(model_score),
                     pa.ListArray.from_arrays(offs, pa.StructArray.from_arrays([rest, pa.array(n)], ["word", "times"]))],
                    ["doc_id", "held_out", "n_tokens", "seen", "base", "model", "rest"])

    parts = staged(rows.select("doc_id", "text", "held_out").mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, seen long, base double, model double, "
               "rest array<struct<word: string, times: long>>")
        .withColumn("row", F.monotonically_increasing_id()), "lm")
    rest = (parts.select("row", F.inline("rest")).join(counts, "word")
            .groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs")))
    return parts.drop("rest").join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"))


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
