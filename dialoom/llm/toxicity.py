"""Toxicity by subword bags: embeddings of words' character n-grams, averaged over a text, in a linear softmax.

A word's n-grams (and the word itself) fall into ``BUCKETS`` buckets by a hash; each bucket has a vector. A
text's vector is the mean of its words' vectors, and a word's the mean of its n-grams', so a misspelling that
was never seen shares vectors with the word that it distorts. Vectors and softmax are trained jointly, in
numpy on the driver, by cross-entropy. All n-grams of the training texts take part, each heard as far as its
presence tells the classes apart (see ``trust``), so that what a few texts hold by chance isn't learned by heart.

The sample has at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled rows, of any length; their bags are made in all tasks
and read a few files at a time, so the driver gets at most ``BUCKETS`` buckets and shares for a text, and holds them once. All texts are scored whole. With the
trained model a word adds one number; each worker keeps those of its recent words.

Defined cases: null and wordless texts score as the trained bias alone; without labels of both classes
every text scores 0; other columns are kept, the score column replaces one of its name; rows that repeat are
scored each, as are those without an id; labels other than 0 and 1 aren't learned from.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm import arrays as A
from dialoom.llm.common import col, labelled_sample, worker_cache

DIM = 8
SHORTEST, LONGEST = 3, 5
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
TOXIC_ROWS, CLEAN_ROWS = 1200, 2400
EPOCHS, BATCH, RATE = 6, 32, 0.03
#: An n-gram whose presence differs by so many standard errors is half heard.
DOUBT = 5.0
#: Added to the root of the second moment: gradients far below it, those of n-grams that are hardly heard, move little.
EPSILON = 1e-4
#: Texts hold few telling words; their mean is scaled so that these are heard.
SCALE = np.float32(30.0)
#: Buckets of the sample's bags that a step of the driver handles.
STRETCH = 1 << 18
#: Words whose number a worker keeps.
KEPT_WORDS = 400_000
#: Texts whose words are looked up together; some are very long.
TEXTS = 32
WORDS = re.compile(r"\w+")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words with marked ends and of the words themselves, and where each word's begin."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(A.U)
    ends = np.cumsum([len(w) + 2 for w in words], dtype=np.int64)
    starts = ends - np.diff(ends, prepend=0)
    word = np.repeat(np.arange(len(words)), ends - starts)
    here = np.arange(len(points))
    found, owner = [], []
    for n in range(SHORTEST, min(LONGEST, len(points)) + 1):
        h = np.full(len(points), A.U(n))
        for k in range(n):
            h[: len(points) - k] += points[k:] * A.ODD[2500 + k]
        some = np.flatnonzero(here + n <= ends[word])
        found.append(h[some]), owner.append(word[some])
    whole = A.spans(A.prefix(points), starts, ends) if len(words) else np.zeros(0, A.U)
    found.append(whole), owner.append(np.arange(len(words)))
    owner, found = np.concatenate(owner), A.mix(np.concatenate(found)) >> A.U(64 - BUCKET_BITS)
    by = np.argsort(owner, kind="stable")
    return found[by].astype(np.int64), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets, once each, with their shares of its mean."""
    words = Counter(WORDS.findall(text.lower()))
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, bounds = grams(list(words))
    size = np.diff(bounds)
    share = np.repeat(np.fromiter(words.values(), float, len(words)) / words.total() / size, size)
    ids, at = np.unique(found, return_inverse=True)
    return ids.astype(np.int32), np.bincount(at, share).astype(np.float32)


@dataclass
class Model:
    """weights: of each bucket for class 1 against class 0; bias: the same of the softmax."""

    weights: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """What each word adds: the mean of its n-grams' weights."""
        if not words:
            return np.zeros(0)
        found, bounds = grams(words)
        return np.add.reduceat(self.weights[found], bounds[:-1]) / np.diff(bounds)


def trust(ids: np.ndarray, bounds: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """How far each of ``n`` buckets is heard, 0 to 1: z**4 / (z**4 + DOUBT**4), z being by how many standard errors
    its presence differs between the classes. What stands in a few texts by chance is heard little, but heard."""
    of = np.bincount(labels, minlength=2)
    k = np.zeros((n, 2))
    for a, b, c in zip(bounds[:-1], bounds[1:], labels):
        k[ids[a:b], c] += 1  # a bag has each bucket once
    pooled = (k.sum(1) + 1) / (of.sum() + 2)
    z = (k[:, 1] / of[1] - k[:, 0] / of[0]) / np.sqrt(pooled * (1 - pooled) * (1 / of).sum())
    return (z**4 / (z**4 + DOUBT**4)).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model | None:
    """Adam on the softmax loss of bags; None without both classes."""
    if not np.bincount(labels, minlength=2).all():
        return None
    bounds = np.concatenate(([0], np.cumsum([len(b[0]) for b in bags])))
    return _train(np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), bounds, labels, seed)


def _train(ids: np.ndarray, shares: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
    """Numbers ``ids`` anew and weighs ``shares`` in place, a stretch at a time: they are most of what the driver holds."""
    stretches = [slice(a, a + STRETCH) for a in range(0, len(ids), STRETCH)]
    seen = np.zeros(BUCKETS, bool)
    for part in stretches:
        seen[ids[part]] = True
    used = np.flatnonzero(seen)
    number = np.zeros(BUCKETS, np.int32)
    number[used] = np.arange(len(used))
    for part in stretches:
        ids[part] = number[ids[part]]
    heard = trust(ids, bounds, labels, len(used))
    for part in stretches:
        shares[part] *= heard[ids[part]]
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.01, 0.01, (len(used), DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (emb, soft, bias)]
    step = 0

    def adam(x, g, m, v, rows=slice(None)):
        m[rows] = 0.9 * m[rows] + 0.1 * g
        v[rows] = 0.99 * v[rows] + 0.01 * g * g
        x[rows] -= RATE * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + EPSILON)

    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for b in range(0, len(order), BATCH):
            pick = order[b : b + BATCH]
            step += 1
            share = np.concatenate([shares[bounds[i] : bounds[i + 1]] for i in pick])
            doc = np.repeat(np.arange(len(pick)), (bounds[1:] - bounds[:-1])[pick])
            local, at = np.unique(np.concatenate([ids[bounds[i] : bounds[i + 1]] for i in pick]), return_inverse=True)
            own = emb[local]
            mean = np.stack([np.bincount(doc, own[at, d] * share, len(pick)) for d in range(DIM)], 1).astype(np.float32) * SCALE
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            err = p / p.sum(1, keepdims=True)
            err[np.arange(len(pick)), labels[pick]] -= 1
            err = (err / len(pick)).astype(np.float32)
            back = (err @ soft.T) * SCALE
            grad = np.stack([np.bincount(at, back[doc, d] * share, len(local)) for d in range(DIM)], 1).astype(np.float32)
            adam(soft, mean.T @ err, *moments[1])
            adam(bias, err.sum(0), *moments[2])
            adam(emb, grad, *moments[0], rows=local)
    weights = np.zeros(BUCKETS)
    weights[used] = SCALE * heard * (emb @ (soft[:, 1] - soft[:, 0]))
    return Model(weights, float(bias[1] - bias[0]))


def _bags(texts: pd.Series) -> pd.Series:
    """Bags as bytes: all buckets, then all shares."""
    return texts.map(lambda t: b"".join(x.tobytes() for x in bag(t)))


def fit(documents: DataFrame, labels: DataFrame, where: Column) -> Model | None:
    """Train on a sample of the labelled documents for which ``where`` (of doc_id) holds."""
    bags = F.pandas_udf(_bags, "binary")(F.coalesce(F.col("text"), F.lit("")))
    known, sizes, values = labelled_sample(documents, labels.where(where), "toxic", (CLEAN_ROWS, TOXIC_ROWS), bags)
    if not np.bincount(known, minlength=2).all():
        return None
    bounds = np.concatenate(([0], np.cumsum(sizes // 8)))
    ids, shares = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
    for i, value in values:
        half = len(value) // 8
        ids[bounds[i] : bounds[i + 1]] = np.frombuffer(value, np.int32, half)
        shares[bounds[i] : bounds[i + 1]] = np.frombuffer(value, np.float32, half, 4 * half)
    return _train(ids, shares, bounds, known)


class _Numbers(dict):
    """Words' numbers, at most about ``KEPT_WORDS`` at a time; new ones of a batch are found together."""

    def __init__(self, model: Model):
        self.model = model

    def learn(self, texts: list[list[str]]) -> None:
        new = list({w for words in texts for w in words}.difference(self))
        if len(self) + len(new) > KEPT_WORDS:
            self.clear()
            new = list({w for words in texts for w in words})
        for i in range(0, len(new), 1 << 16):
            part = new[i : i + (1 << 16)]
            self.update(zip(part, self.model.words(part).tolist()))


def scored(docs: DataFrame, model: Model | None, score: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1."""
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_cache("toxicity", dict)  # its words are kept by the task; what other stages kept in this worker goes
        numbers = _Numbers(shared.value)
        bias = shared.value.bias
        for batch in batches:
            out = np.empty(len(batch))
            for lo in range(0, len(batch), TEXTS):
                found = [WORDS.findall(t.lower()) for t in batch.iloc[lo : lo + TEXTS]]
                numbers.learn(found)
                for i, words in enumerate(found, lo):
                    out[i] = bias + (sum(map(numbers.__getitem__, words)) / len(words) if words else 0.0)
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -500, 500))))

    return docs.withColumn(score, F.pandas_udf(of, "double")(F.coalesce(col(text), F.lit(""))))
