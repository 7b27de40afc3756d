"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy (operator 10).

A word is the mean of the vectors of its byte n-grams (with marks at both ends) and of itself, hashed into a
table; a text is the mean of all its words; a softmax over two classes reads it off. Since a few words sink in the
mean of a long text, the same softmax also reads off the means of its windows of 16 words (in which a word said again
at once counts once), and the strongest of them is a second input of the score: z = bias + a * text + b * window. Vectors
and softmax are learned together on a bounded, balanced sample of labelled rows; a, b and the bias by logistic
regression on a fifth of that sample held back for it, weighted to the classes' shares. Misspelt words share most n-grams
with known ones.

Since all is linear up to the softmax, the logit of a text or window is the mean of its words' logits, and a hash bucket
needs one number at scoring time: executors get a table of `buckets` floats, whatever the data.

Defined cases: a null or empty text, or one without words, has the mean vector 0 and so the bias alone; a null
id counts as the empty string for the folds; with labels of one class only, or none, every score is the share
of label 1 (one half without labels); repeated rows are scored one by one; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumatab.llm import shared
from lumatab.llm.rule_ensemble import fold
from lumatab.operators.sampling import smallest

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 3_000
#: Bytes of them, at most.
SAMPLE_BYTES = 96 << 20
BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
#: Words that are averaged together.
WINDOW = 16
#: Words that a worker remembers between batches.
MEMO = 400_000
_EDGES = b".,;:!?\"'()[]{}<>|*#$%&~`/\\-_=+"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [w for x in (text or "").lower().encode().split() if (w := x.strip(_EDGES))]


def grams_of(words: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word index) of every n-gram and of every whole word."""
    marked = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), sizes)
    out, who = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(data), np.uint64)
        for k in range(max(GRAMS)):
            n = len(data) - k
            if n <= 0:
                break
            h = h[:n] * np.uint64(0x100000001B3) + data[k:] + np.uint64(1)
            if k + 1 in GRAMS:
                inside = np.flatnonzero(owner[:n] == owner[k:])
                mixed = (h[inside] ^ np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                out.append(mixed >> np.uint64(40))
                who.append(owner[inside])
        # the whole word: a polynomial over its bytes, by a running sum
        power = np.cumprod(np.full(int(sizes.max()) if len(sizes) else 0, 0x100000001B3, np.uint64))
        starts = np.cumsum(sizes) - sizes
        term = (data + np.uint64(1)) * power[np.arange(len(data)) - starts[owner]] if len(data) else data
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
        whole = (total[starts + sizes] - total[starts]) * np.uint64(0x9E3779B97F4A7C15)
    out.append(whole >> np.uint64(40))
    who.append(np.arange(len(marked)))
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64), np.concatenate(who)


@dataclass
class SubwordModel:
    """Logit of a text: bias + whole * (mean of its words) + window * (mean of its strongest window's words); a word is the mean over its buckets of `weights`."""

    bias: float
    weights: np.ndarray
    whole: float = 0.5
    window: float = 0.5

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        bucket, who = grams_of(words, len(self.weights))
        return np.bincount(who, self.weights[bucket], len(words)) / np.bincount(who, minlength=len(words))


def windows(n: int, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of a text's windows: one after the other, the last one moved back to full size."""
    if n <= size:
        return np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n, np.int64)
    starts = np.arange(0, n, size)
    starts[-1] = min(starts[-1], n - size)
    return starts, starts + size


def strongest(logits: np.ndarray) -> tuple[float, int, int]:
    """(mean, start, end) of the window of words with the highest mean; (0, 0, 0) without words."""
    if not len(logits):
        return 0.0, 0, 0
    starts, ends = windows(len(logits))
    total = np.concatenate([[0.0], np.cumsum(logits)])
    mean = (total[ends] - total[starts]) / (ends - starts)
    k = int(mean.argmax())
    return float(mean[k]), int(starts[k]), int(ends[k])


class Scorer:
    """Scores texts; remembers a bounded number of words."""

    def __init__(self, model: SubwordModel) -> None:
        self.model, self.memo = model, {}

    def logits(self, texts: list[str | None]) -> list[float]:
        out = []
        memo = self.memo
        for i in range(0, len(texts), 256):
            bags = [words_of(t) for t in texts[i : i + 256]]
            if len(memo) > MEMO:
                memo.clear()
            new = list(set().union(*bags).difference(memo))
            memo.update(zip(new, self.model.word_logits(new).tolist(), strict=True))
            for bag in bags:
                values = np.fromiter(map(memo.__getitem__, bag), np.float64, len(bag))
                anew = np.fromiter(map(bytes.__ne__, bag, [b"", *bag]), bool, len(bag))
                whole = float(values.mean()) if len(bag) else 0.0
                out.append(self.model.bias + self.model.whole * whole + self.model.window * strongest(values[anew])[0])
        return out


class _Trainer:
    """Adam on the cross entropy of averaged words; parameters are the vectors of buckets found in enough texts, the softmax and its bias."""

    def __init__(self, texts: list[list[bytes]], dim: int, least: int, rate: float, buckets: int, seed: int) -> None:
        self.r, self.rate, self.dim, self.buckets = np.random.default_rng(seed), rate, dim, buckets
        names = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.docs = [np.fromiter(map(names.__getitem__, t), np.int32, len(t)) for t in texts]
        self.runs = [d[np.diff(d, prepend=-1) != 0] for d in self.docs]  # a word said again at once counts once
        words, parts, sizes = list(names), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 50_000):  # a chunk at a time: the driver's memory is small
            found, who = grams_of(words[i : i + 50_000], buckets)
            parts.append(found[np.argsort(who, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(who))
        bucket, self.size = np.concatenate(parts), np.concatenate(sizes)
        del names, words, parts
        self.first = np.cumsum(self.size) - self.size
        in_texts = np.zeros(buckets, np.int64)
        for d in self.docs:
            in_texts[np.unique(bucket[self._grams(np.unique(d))[0]])] += 1
        # buckets found in fewer texts than that tell texts apart, not classes: they share slot 0, which stays 0
        self.used = np.concatenate([[-1], np.flatnonzero(in_texts >= least)])
        place = np.zeros(buckets, np.int32)
        place[self.used[1:]] = np.arange(1, len(self.used), dtype=np.int32)
        self.slot = place[bucket]
        self.vec = self.r.normal(0, 0.05, (len(self.used), dim))
        self.vec[0] = 0
        self.soft, self.bias = self.r.normal(0, 0.5, (dim, 2)), np.zeros(2)
        self.state = [(np.zeros_like(p), np.zeros_like(p)) for p in (self.vec, self.soft, self.bias)]
        self.t = 0

    def _grams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words' n-grams, and which word each belongs to."""
        size = self.size[words]
        ends = np.cumsum(size)
        return np.repeat(self.first[words] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0), np.repeat(np.arange(len(words)), size)

    def weights(self) -> np.ndarray:
        return self.vec @ (self.soft[:, 1] - self.soft[:, 0])

    def word_logits(self) -> np.ndarray:
        weights = self.weights()
        sums = [np.zeros(0)]
        for i in range(0, len(self.size), 50_000):
            words = np.arange(i, min(i + 50_000, len(self.size)))
            at, who = self._grams(words)
            sums.append(np.bincount(who, weights[self.slot[at]], len(words)))
        return np.concatenate(sums) / self.size

    def step(self, parts: list[np.ndarray], y: np.ndarray) -> None:
        """One step on texts, or parts of texts, given as word numbers."""
        self.t += 1
        k, dim = len(parts), self.dim
        lengths = np.array([max(1, len(p)) for p in parts])
        owner = np.repeat(np.arange(k), [len(p) for p in parts])
        words, back = np.unique(np.concatenate(parts), return_inverse=True)
        at, who = self._grams(words)
        rows, slot = np.unique(self.slot[at], return_inverse=True)
        size, share = self.size[words], 1 / lengths[owner]
        word_vec = np.stack([np.bincount(who, self.vec[rows[slot], d], len(words)) for d in range(dim)], 1) / size[:, None]
        text_vec = np.stack([np.bincount(owner, share * word_vec[back, d], k) for d in range(dim)], 1)
        z = text_vec @ self.soft + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(k), y.astype(int)] -= 1
        p /= k
        d_text = p @ self.soft.T
        d_word = np.stack([np.bincount(back, share * d_text[owner, d], len(words)) for d in range(dim)], 1) / size[:, None]
        d_vec = np.stack([np.bincount(slot, d_word[who, d], len(rows)) for d in range(dim)], 1)
        d_vec[rows == 0] = 0
        for param, i, grad, (m, v) in ((self.vec, rows, d_vec, self.state[0]), (self.soft, slice(None), text_vec.T @ p, self.state[1]), (self.bias, slice(None), p.sum(axis=0), self.state[2])):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            param[i] -= self.rate * (m[i] / (1 - 0.9**self.t)) / (np.sqrt(v[i] / (1 - 0.999**self.t)) + 1e-7)


def combine(x: np.ndarray, y: np.ndarray, n: np.ndarray, pull: float = 0.002, rounds: int = 50) -> np.ndarray:
    """(bias, weights) of logistic regression by Newton steps; row i counts n[i] times, weights are pulled to one half."""
    data = np.column_stack([np.ones(len(x)), x])
    rest = np.array([0.0, *[0.5] * x.shape[1]])
    ridge = pull * n.sum() * np.diag([1e-6, *[1.0] * x.shape[1]])
    w = rest.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        slope = data.T @ (n * (p - y)) + ridge @ (w - rest)
        step = np.linalg.solve((data * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ data + ridge, slope)
        w -= step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
    return w


def fit(texts: list[list[bytes]], y: np.ndarray, share: float, dim: int = 8, warm: int = 3, steps: int = 2000, batch: int = 64, rate: float = 0.02, least: int = 5, buckets: int = BUCKETS, seed: int = 7) -> SubwordModel:
    """A model from texts as word lists, of about balanced classes; `share` is label 1's among all rows.

    After `warm` epochs on whole texts come epochs, up to about `steps` steps in all, in which a text is learned from its strongest window as the model
    stands, and a text of label 0 also from a window at random. A fifth of the texts is held back to weigh text and window.
    """
    share = float(np.clip(share, 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return SubwordModel(prior, np.zeros(buckets, np.float32))
    least = max(2, min(least, len(y) // 50))
    learner = _Trainer(texts, dim, least, rate, buckets, seed)
    r, docs, runs = learner.r, learner.docs, learner.runs
    back = r.random(len(y)) < 0.2
    if len(y) < 100 or len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    own = np.flatnonzero(~back)
    epoch = 0
    while epoch < warm or learner.t < steps:
        parts, truth = [docs[i] for i in own], list(y[own])
        if epoch >= warm:
            logits = learner.word_logits()
            parts = [runs[i][slice(*strongest(logits[runs[i]])[1:])] for i in own]
            for i in own[y[own] == 0]:
                starts, ends = windows(len(runs[i]))
                if len(starts) > 1:
                    k = int(r.integers(len(starts)))
                    parts.append(runs[i][starts[k] : ends[k]])
                    truth.append(0.0)
        truth = np.array(truth)
        for ids in np.array_split(r.permutation(len(parts)), max(1, len(parts) // batch)):
            learner.step([parts[i] for i in ids], truth[ids])
        epoch += 1
    weights = np.zeros(buckets, np.float32)
    weights[learner.used[1:]] = learner.weights()[1:]
    if not back.any():
        seen = float(truth.mean())  # label 1's share of what the last epoch learned from
        return SubwordModel(float(learner.bias[1] - learner.bias[0]) + prior - float(np.log(seen / (1 - seen))), weights)
    logits, held = learner.word_logits(), np.flatnonzero(back)
    x = np.array([[logits[docs[i]].mean() if len(docs[i]) else 0.0, strongest(logits[runs[i]])[0]] for i in held])
    mean = float(y[held].mean())
    bias, whole, window = combine(x, y[held], np.where(y[held] == 1, share / mean, (1 - share) / (1 - mean)))
    return SubwordModel(float(bias), weights, float(whole), float(window))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> SubwordModel:
    """A model from labelled rows outside the held-out fold: up to `sample` of each class, by md5 of the id, of `sample_bytes` bytes together at most."""
    key = F.col(id_col).cast("string")
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col), folds) != held_out)).select(key.alias("key"), F.col(label_col).cast("int").alias("label"))
    with shared.steps(docs.sparkSession) as tables:
        usable = tables.write(usable, "toxic-labels")
        shares = usable.agg(F.avg("label")).first()[0]
        if shares is None:
            return SubwordModel(0.0, np.zeros(BUCKETS, np.float32))
        picked = [smallest(usable.where(F.col("label") == v), F.md5("key"), ["key"], sample) for v in (0, 1)]
        chosen = tables.write(picked[0].unionByName(picked[1]), "toxic-sample")
        rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "key")  # at most 2 * `sample` short rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([b" ".join(words_of(t.as_py())) for t in b.column(2)], pa.binary())], ["key", "label", "words"])

        got = rows.select("key", "label", "t").mapInArrow(run, "key string, label int, words binary")
        order = [F.md5("key"), F.col("label"), F.col("words")]
        got = got.orderBy(*order).limit(2 * sample)  # again bounded, should ids repeat; and in bytes, as the driver holds them
        got = got.withColumn("upto", F.sum(F.length("words")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= sample_bytes).toArrow()
    return fit([w.split() for w in got.column("words").to_pylist()], got.column("label").to_numpy().astype(np.float64), float(shares))


def score(docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0) -> DataFrame:
    """(id, held_out, score, predicted) per row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.whole, model.window))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(SubwordModel(*sent.value))
        for b in batches:
            z = np.clip(np.array(scorer.logits(b.column(1).to_pylist()), np.float64), -700, 700)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-z)), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, score double")
    return rows.select(F.col("id").alias(id_col), (fold(F.col("id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
