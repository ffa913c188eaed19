"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5 bytes, with word ends), hashed into a table of
embeddings; a run of WINDOW words is the average of all its n-grams, and a two-class softmax over that
average gives its probability. A misspelt word that was never seen shares most n-grams with the word.
A text's score is that of its most toxic run, so a few words count in a long text as in a short one.

Training is by stochastic gradient steps (Adagrad) on embeddings and softmax together, over a bounded
sample: at most ``per_class`` labelled rows of each class, of at most ``sample_bytes`` bytes each, in
the order of a hash of the id. As labels hold for whole texts, runs of toxic texts first all count as
toxic; then only the runs that the model finds most toxic in their text do, against the runs of clean
texts that it finds most toxic and random ones. Clean texts kept back set the bias. Scoring covers whole
texts of all rows, row-local.

Defined results: a null or wordless text scores 0; a text shorter than a run is one run; rows with null
or several labels count as toxic if any label is 1, and rows whose labels are all null are not learned
from; without rows of both classes every score is 0; equal texts have equal scores; an empty table gives
no rows; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.arrow import append, in_one_task, text_buffers
from strata.llm.words import ALNUM, LOWER, Tokenizer, mix

WINDOW = 8
SIZES = (3, 4, 5)
BUCKETS = 1 << 17
DIM = 8
PER_CLASS = 1500
SAMPLE_BYTES = 1 << 14
STEPS = (250, 250, 250)
BATCH = 512
RATE = 0.5
THRESHOLD = 0.7
#: A fifth of the clean sample is kept from training; the bias lets this share of it score below this.
CLEAN_SHARE, CLEAN_SCORE = 0.99, 0.55
#: A run of n-grams that training never saw scores no more than this, whatever the kept-back texts say.
UNSEEN_SCORE = 0.4

GRAM_BYTES = np.random.default_rng(7).integers(1, 2**63, (max(SIZES), 256), dtype=np.uint64)


def ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(bucket ids of all n-grams, word by word, and their number for each word)."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    text = np.full(int(size.sum()), 0x20, np.uint8)
    inner = np.ones(len(text), bool)
    inner[first] = inner[first + size - 1] = False
    text[inner] = LOWER[data[np.repeat(starts - (first + 1), size - 2) + np.flatnonzero(inner)]]
    word = np.repeat(np.arange(len(size)), size)
    ids, of = [], []
    for n in SIZES:
        m = max(len(text) - n + 1, 0)
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h += GRAM_BYTES[j][text[j:j + m]]
        ok = np.flatnonzero(word[:m] == word[n - 1:]) if m else np.zeros(0, np.int64)
        ids.append((mix(h[ok]) % np.uint64(BUCKETS)).astype(np.int64))
        of.append(word[ok])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(ids)[order], np.bincount(of, minlength=len(size))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts`` values (rows)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return total[edge[1:]] - total[edge[:-1]]


@dataclass
class Model:
    """Embeddings of the buckets, softmax weights (dimension x class) and bias."""
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def gram_logits(self) -> np.ndarray:
        """What each n-gram adds to the logit of class 1 against 0."""
        return self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])


def word_sums(data, offsets, tokenizer, logits):
    """(sum of logits, number of n-grams) of each word, and the first word of each row."""
    _, starts, ends, h, bounds = tokenizer.words(data, offsets)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    ids, n = ngrams(data, starts[first], ends[first])
    return sums(logits[ids], n)[which], n[which], bounds


def window_logits(total, n, bounds, size: int = WINDOW):
    """Average logit of every run of ``size`` words (or of a shorter row), and the row of each."""
    row_words = np.diff(bounds)
    runs = np.where(row_words > 0, np.maximum(row_words - size + 1, 1), 0)
    row = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + bounds[row]
    end = np.minimum(at + size, bounds[row + 1])
    t, c = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(n)])
    return (t[end] - t[at]) / np.maximum(c[end] - c[at], 1), row, at


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, toxic) to learn from: a bounded sample of rows that both tables have."""
    known = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    ids = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return (docs.select("doc_id", "text").where(F.octet_length("text") <= sample_bytes)
            .join(F.broadcast(ids[0].unionAll(ids[1])), "doc_id").orderBy("doc_id", "text").select("text", "toxic"))


def train(texts, labels: np.ndarray, seed: int = 11) -> Model:
    """Embeddings and softmax, from an Arrow array of texts and their labels."""
    rng = np.random.default_rng(seed)
    model = Model(np.zeros((BUCKETS, DIM), np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32),
                  np.zeros(2, np.float32))
    if len(np.unique(labels)) < 2:
        return Model(model.embeddings * 0, model.weights, np.array([50.0, -50.0], np.float32))
    data, offsets = text_buffers(texts)
    _, starts, ends, h, bounds = Tokenizer(ALNUM, lower=True).words(data, offsets)
    _, first, word = np.unique(h, return_index=True, return_inverse=True)
    ids, count = ngrams(data, starts[first], ends[first])
    gram_at = np.cumsum(count) - count
    ids, word = ids.astype(np.int32), word.astype(np.int32)
    del data, starts, ends, h, first
    speed = [np.full(x.shape, 1e-3, np.float32) for x in (model.embeddings, model.weights, model.bias)]

    def ranges(begin, n):
        return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def step(begin, n_words, target):
        words = word[ranges(begin, n_words)]
        n = count[words]
        grams = ids[ranges(gram_at[words], n)]
        per = np.add.reduceat(n, np.cumsum(n_words) - n_words)
        run = np.repeat(np.arange(len(begin)), per)
        unique, local = np.unique(grams, return_inverse=True)
        bag = np.add.reduceat(model.embeddings[grams], np.cumsum(per) - per) / per[:, None]
        logits = bag @ model.weights + model.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(target)), target] -= 1
        p /= len(target)
        back = (p @ model.weights.T / per[:, None])[run]
        slope = np.stack([np.bincount(local, weights=back[:, d], minlength=len(unique)) for d in range(DIM)], 1)
        for x, s, g, at in ((model.embeddings, speed[0], slope * len(target) / 8, unique),
                            (model.weights, speed[1], bag.T @ p, ...), (model.bias, speed[2], p.sum(0), ...)):
            s[at] += g * g
            x[at] -= RATE / (2 if x is model.embeddings else 10) * g / np.sqrt(s[at])

    n_words = np.diff(bounds)
    runs = np.where(n_words > 0, np.maximum(n_words - WINDOW + 1, 1), 0)
    row = np.repeat(np.arange(len(runs), dtype=np.int32), runs)
    begin = (np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + bounds[row]).astype(np.int32)
    size = np.minimum(WINDOW, bounds[row + 1] - begin).astype(np.int32)
    toxic_run = labels[row] == 1
    clean = np.flatnonzero(labels == 0)
    kept_back = np.isin(np.arange(len(labels)), clean[::5] if len(clean) > 9 else [])
    good, bad = np.flatnonzero(~toxic_run & ~kept_back[row]), np.flatnonzero(toxic_run)
    if not len(good) or not len(bad):
        return Model(model.embeddings * 0, model.weights, np.array([50.0, -50.0], np.float32))
    hard, sure = good, bad

    def logits():
        score = model.gram_logits()
        value = window_logits(sums(score[ids], count)[word], count[word], bounds)[0]
        best = np.full(len(runs), -np.inf)
        np.maximum.at(best, row, value)
        return value, best

    for phase, steps in enumerate(STEPS):
        if phase:
            value, best = logits()
            sure = bad[value[bad] >= best[row[bad]] - 0.05 * np.abs(best[row[bad]])]
            hard = good[value[good] >= best[row[good]] - 0.05 * np.abs(best[row[good]])]
        for _ in range(steps):
            at = np.concatenate([rng.choice(sure, BATCH // 4), rng.choice(hard, BATCH // 4), rng.choice(good, BATCH // 2)])
            step(begin[at], size[at], toxic_run[at].astype(np.int64))
    best = logits()[1]
    held = best[kept_back & np.isfinite(best)]
    if len(held):
        logit, top = lambda s: np.log(s / (1 - s)), float(np.quantile(held, CLEAN_SHARE))
        bias = min(logit(CLEAN_SCORE) - top, logit(UNSEEN_SCORE))
        model.bias = np.array([0, bias], np.float32)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the probability, 0 to 1, that the text is toxic."""
    bias = float(model.bias[1] - model.bias[0])
    shared = docs.sparkSession.sparkContext.broadcast(model.gram_logits().astype(np.float64))

    def start():
        tokenizer, logits = Tokenizer(ALNUM, lower=True), shared.value

        def kernel(data, offsets, batch):
            value, row, _ = window_logits(*word_sums(data, offsets, tokenizer, logits))
            best = np.full(len(offsets) - 1, -np.inf)
            if len(row):
                edge = np.flatnonzero(np.diff(row, prepend=-1))
                best[row[edge]] = np.maximum.reduceat(value, edge)
            return [np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best + bias, -60, 60))), 0.0)]

        return kernel

    return append(docs, [T.StructField(name, T.DoubleType())], start, text)


def fitted(docs: DataFrame, labels: DataFrame, **bounds) -> Model:
    def learn(table):
        model = train(table.column("text"), np.array(table.column("toxic").to_pylist(), np.int64))
        return model.embeddings, model.weights, model.bias

    return Model(*in_one_task(sample(docs, labels, **bounds), learn))
