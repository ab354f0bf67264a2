"""Encoding texts as vectors in workers: an encoder protocol, and a cache of models that each worker makes once.

A model is asked for by (kind, name): the kind is a registered maker, the name its parameters as text. A worker keeps
the ``MOST`` models that it used last, so several stages can share a session without filling its memory. Texts reach an
encoder in batches of a fixed size, whatever the batches of Arrow are.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: Texts in a batch when turns are encoded, and when documents are.
TURNS, DOCUMENTS = 512, 32
MOST = 2


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """A row of numbers for each text."""


class Cache:
    """The models used last, by (kind, name)."""

    def __init__(self, most: int = MOST):
        self.most, self.models, self.made = most, OrderedDict(), 0

    def get(self, kind: str, name: str, make: Callable[[str], Encoder]) -> Encoder:
        key = (kind, name)
        if key in self.models:
            self.models.move_to_end(key)
        else:
            while len(self.models) >= self.most:
                self.models.popitem(last=False)
            self.models[key] = make(name)
            self.made += 1
        return self.models[key]


#: This worker's; it lives as long as the worker, across tasks and stages.
CACHE = Cache()


class Hashed:
    """An encoder without weights: counts of character n-grams in buckets, to unit length. ``name``: buckets and n, as ``256x3``.

    An n-gram's bucket is the number that its code points make to the base 31, modulo the buckets. A text shorter
    than n is the zero vector.
    """

    def __init__(self, name: str):
        self.buckets, self.n = map(int, name.split("x"))

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.buckets))
        for row, text in zip(out, texts):
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
            if len(codes) >= self.n:
                grams = sum(codes[i : len(codes) - self.n + 1 + i] * 31 ** (self.n - 1 - i) for i in range(self.n))
                row += np.bincount(grams % self.buckets, minlength=self.buckets)
        lengths = np.sqrt((out**2).sum(1, keepdims=True))
        return np.divide(out, lengths, out=out, where=lengths > 0)


KINDS: dict[str, Callable[[str], Encoder]] = {"hashed": Hashed}


def encoded(rows: DataFrame, text: str, out: str = "v", kind: str = "hashed", name: str = "256x3", batch: int = TURNS, make: Callable[[str], Encoder] | None = None) -> DataFrame:
    """Adds ``out``, the vector of each text (null: of the empty one), by the encoder ``kind`` of ``name``; ``make`` for kinds of one's own."""
    maker = make or KINDS[kind]
    schema = StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dialoom.operators import encode

        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                some = whole.slice(lo, batch)
                vectors = encode.CACHE.get(kind, name, maker).encode([t or "" for t in some[text].to_pylist()])
                flat = pa.array(np.ascontiguousarray(vectors, dtype=np.float64).ravel())
                offsets = pa.array(np.arange(0, vectors.size + 1, vectors.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(offsets, flat)], names=[*some.schema.names, out])

    return rows.mapInArrow(of, schema)
