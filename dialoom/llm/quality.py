"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by a hidden layer over the mean
of its words' learned vectors (each word has one in a hashed table, and one for how it ends) and counts of its
letters, marks and repeated words. A gate tanh(V h) * sigmoid(U h) gives it an attention weight within its
document, and the weighted sum of the encodings is scored. All layers, vectors included, are trained together,
in numpy on the driver, from document labels alone, on a bounded sample (``ROWS`` of each class, of any length);
scoring reads every passage of every text.

Defined cases: null, empty and blank texts are one passage without words; without labels of both classes
every text scores 0; other columns are kept, the score column replaces one of its name; rows that repeat are
scored each, as are those without an id; labels other than 0 and 1 aren't learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm import arrays as A
from dialoom.llm.common import labelled_sample, text_bytes

PASSAGE, HIDDEN, GATE = 48, 16, 8
#: Buckets of the table of vectors (a power of two, half for words, half for endings), numbers of a vector.
BUCKETS, DIM = 1 << 14, 8
ROWS = (2000, 2500)
EPOCHS, BATCH, RATE = 15, 64, 0.01

_CLASSES = [range(65, 91), range(48, 58), range(128, 256), map(ord, ".,;:"), map(ord, "!?"), [10], [x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:!?"]]
_IS = np.zeros((len(_CLASSES), 256), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _IS[_k, list(_c)] = 1
FEATURES = len(_CLASSES) + 8


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all passages of the documents, where each document's begin (one passage at least), the words' buckets
    (two for each word, one after another), and where each passage's begin."""
    starts, ends, first = A.words(data, offsets)
    count = np.diff(first)
    per = np.maximum(1, -(-count // PASSAGE))
    bounds = np.concatenate(([0], np.cumsum(per)))
    doc = A.ids(bounds)
    a = first[doc] + (np.arange(bounds[-1]) - bounds[doc]) * PASSAGE
    b = np.minimum(a + PASSAGE, first[doc + 1])
    n = b - a
    x = np.zeros((len(a), FEATURES))
    some = np.flatnonzero(n)
    lo, hi = starts[a[some]], ends[b[some] - 1]
    size = np.maximum(hi - lo, 1)
    for k in range(len(_CLASSES)):
        total = np.concatenate(([0], np.cumsum(_IS[k][data], dtype=np.int64)))
        x[some, k] = (total[hi] - total[lo]) / size
    k = len(_CLASSES)
    length = np.concatenate(([0], np.cumsum(ends - starts)))
    square = np.concatenate(([0], np.cumsum((ends - starts) ** 2)))
    m = np.maximum(n, 1)
    mean = (length[b] - length[a]) / m
    names = A.spans(A.prefix(A.BYTE_KEYS[data]), starts, ends)
    owner = np.repeat(np.arange(len(a)), n)
    for back in (1, 2):
        same = np.zeros(len(names) + 1, np.int64)
        same[1:][back:] = np.cumsum((names[back:] == names[:-back]) & (owner[back:] == owner[:-back]))
        x[:, k + back] = (same[b] - same[a]) / m
    keys = np.sort((owner.astype(A.U) << A.U(40)) | (names >> A.U(24)))
    fresh = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
    x[:, k] = np.bincount((keys[fresh] >> A.U(40)).astype(np.int64), minlength=len(a)) / m
    x[:, k + 3] = np.log1p(n)
    x[:, k + 4] = mean
    x[:, k + 5] = np.sqrt(np.maximum((square[b] - square[a]) / m - mean**2, 0))
    x[:, k + 6] = np.log1p(count[doc])
    x[:, k + 7] = np.log1p(np.diff(offsets)[doc] / np.maximum(count[doc], 1))
    half = A.U(BUCKETS // 2 - 1)
    last = A.spans(A.prefix(A.BYTE_KEYS[data], A.BASE), np.maximum(starts, ends - 3), ends)
    ids = np.stack(((A.mix(names) & half).astype(np.int64), (A.mix(last) & half).astype(np.int64) + BUCKETS // 2), 1).ravel()
    return x, bounds, ids, 2 * np.concatenate((a, first[-1:]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Weights by name, and the forward pass over many bags at once."""

    def __init__(self, rng: np.random.Generator, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale = mean, scale
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.w = {"words": rng.normal(0, 0.1, (BUCKETS, DIM)), "enc": init(FEATURES + DIM, HIDDEN), "enc0": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "att": init(GATE), "out": init(HIDDEN), "out0": np.zeros(1)}

    def forward(self, x: np.ndarray, bounds: np.ndarray, ids: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, bag, at = self.w, A.ids(bounds), bounds[:-1]
        size = np.maximum(np.diff(first), 1)
        sums = np.concatenate((np.zeros((1, DIM)), np.cumsum(w["words"][ids], 0)))
        x = np.concatenate((np.clip((x - self.mean) / self.scale, -8, 8), (sums[first[1:]] - sums[first[:-1]]) / size[:, None]), 1)
        h = np.tanh(x @ w["enc"] + w["enc0"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["att"]
        e = np.exp(e - np.maximum.reduceat(e, at)[bag])
        a = e / np.add.reduceat(e, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out0"]), "bag": bag, "ids": ids, "passage": np.repeat(np.arange(len(size)), np.diff(first)), "size": size}

    def gradients(self, f: dict[str, np.ndarray], y: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        w, bag, at = self.w, f["bag"], bounds[:-1]
        d = (f["p"] - y) / len(y)
        dz = d[:, None] * w["out"]
        da = (f["h"] * dz[bag]).sum(1)
        de = f["a"] * (da - np.add.reduceat(f["a"] * da, at)[bag])
        dt = de[:, None] * w["att"] * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * w["att"] * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T
        dx = dh * (1 - f["h"] ** 2)
        dm = (dx @ w["enc"][FEATURES:].T) / f["size"][:, None]
        words = np.stack([np.bincount(f["ids"], dm[f["passage"], k], BUCKETS) for k in range(DIM)], 1)
        return {"words": words, "enc": f["x"].T @ dx, "enc0": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "att": (f["t"] * f["s"]).T @ de, "out": f["z"].T @ d, "out0": d.sum(keepdims=True)}


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Model | None:
    """Adam on the log loss of whole bags; None without both classes."""
    if not np.bincount(labels, minlength=2).all():
        return None
    parts = [passages(data, offsets) for _, _, data, offsets in A.chunks(pa.array(texts, pa.binary()))]
    x = np.concatenate([p[0] for p in parts])
    sizes = np.concatenate([np.diff(p[1]) for p in parts])
    first = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.concatenate([p[2] for p in parts])
    counts = np.concatenate([np.diff(p[3]) for p in parts])
    begins = np.concatenate(([0], np.cumsum(counts)))
    rng = np.random.default_rng(seed)
    model = Model(rng, x.mean(0), x.std(0) + 1e-3)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.w.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(sizes))
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            bounds = np.concatenate(([0], np.cumsum(sizes[pick])))
            rows = np.repeat(first[pick] - bounds[:-1], sizes[pick]) + np.arange(bounds[-1])
            begin = np.concatenate(([0], np.cumsum(counts[rows])))
            own = ids[np.repeat(begins[rows] - begin[:-1], counts[rows]) + np.arange(begin[-1])]
            grads = model.gradients(model.forward(x[rows], bounds, own, begin), labels[pick], bounds)
            step += 1
            for k, g in grads.items():
                m, v = moments[k]
                m[...] = 0.9 * m + 0.1 * g
                v[...] = 0.999 * v + 0.001 * g * g
                model.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Of texts, whole."""
    parts = [model.forward(*passages(data, offsets))["p"] for _, _, data, offsets in A.chunks(pa.array(texts, pa.binary()))]
    return np.concatenate(parts) if parts else np.zeros(0)


def fit(documents: DataFrame, labels: DataFrame, where: Column) -> Model | None:
    """Train on a sample of the labelled documents for which ``where`` (of doc_id) holds."""
    known, _, values = labelled_sample(documents, labels.where(where), "quality", ROWS, text_bytes("text"))
    return train([text for _, text in sorted(values)], known)


def scored(docs: DataFrame, model: Model | None, score: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1."""
    if model is None:
        return docs.withColumn(score, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scores(shared.value, list(batch)), dtype="float64")

    return docs.withColumn(score, F.pandas_udf(of, "double")(text_bytes(text)))
