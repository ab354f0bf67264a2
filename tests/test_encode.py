"""The encoder and the worker's cache of models."""

from __future__ import annotations

import numpy as np

from dialoom.operators import encode as E


def test_hashed_counts():
    v = E.Hashed("64x2").encode(["abab", "a", "", "日本語"])
    ab, ba = (ord("a") * 31 + ord("b")) % 64, (ord("b") * 31 + ord("a")) % 64
    assert np.allclose(v[0, [ab, ba]], np.array([2, 1]) / 5**0.5) and np.count_nonzero(v[0]) == 2
    assert not v[1:3].any() and np.isclose((v[3] ** 2).sum(), 1)


def test_cache_keeps_the_models_used_last():
    made = []
    cache = E.Cache(2)
    for name in ["a", "b", "a", "c", "a", "b"]:  # b goes when c comes, c when b comes again
        cache.get("k", name, lambda n: made.append(n) or n)
    assert made == ["a", "b", "c", "b"] and list(cache.models) == [("k", "a"), ("k", "b")] and cache.made == 4
    assert cache.get("other", "a", str.upper) == "A"


def test_batches_and_one_model_a_worker(spark):
    class Sized:
        """Tells how large its batches are, and which of a worker's models it is."""

        def __init__(self, name):
            from dialoom.operators import encode

            self.number = encode.CACHE.made

        def encode(self, texts):
            return np.array([[len(texts), self.number, len(t)] for t in texts], float)

    rows = spark.createDataFrame([(i, "x" * (i % 5) if i % 7 else None) for i in range(1000)], "id long, text string").coalesce(1)
    got = E.encoded(rows, "text", kind="sized", name="s", batch=32, make=Sized).collect()
    assert len(got) == 1000 and max(r.v[0] for r in got) == 32 and len({r.v[1] for r in got}) == 1
    assert all(r.v[2] == len(r.text or "") for r in got)
    assert E.encoded(rows.limit(0), "text").count() == 0
