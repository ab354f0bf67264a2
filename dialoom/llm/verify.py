"""Found repeats held against the text that they repeat, by digests of both sides.

A repeat is a run of units (words or bytes) of one document that also stands in another place. Runs are
split where the other place's position is a multiple of ``BLOCK``, so that the many copies of one passage
ask for the same few pieces of it. A worker with both a document's own pieces and those that others ask of
it gives the SHA-256 of each, and Spark compares them by place. No text travels for it but the one pass
that removes the repeats, and a document that all others repeat digests no more than its own distinct pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import cut

BLOCK = 256
#: (first window, windows, and where the first of them also stands)
MATCH = "struct<at: int, n: int, src: long, src_tag: long, src_at: int>"
OWN = "array<struct<src: long, src_tag: long, src_at: int, len: int, at: int>>"
DIGESTS = "array<struct<src: long, src_tag: long, src_at: int, len: int, digest: binary>>"


def pieces(match: np.ndarray, window: int, block: int = BLOCK) -> list[tuple[int, int, int, int, int]]:
    """(at, n, src, src_tag, src_at) rows of one document -> (src, src_tag, src_at, len, at) of its runs, split into blocks."""
    at, n, src, tag, src_at = match
    by = np.lexsort((at, src_at - at, tag, src))
    at, n, src, tag, src_at = (x[by] for x in (at, n, src, tag, src_at))
    end = at + n + window - 1
    kin = np.zeros(len(at), bool)
    kin[1:] = (src[1:] == src[:-1]) & (tag[1:] == tag[:-1]) & ((src_at - at)[1:] == (src_at - at)[:-1])
    out = []
    run = None
    for k in range(len(at)):
        if run and kin[k] and at[k] <= run[1]:
            run[1] = max(run[1], int(end[k]))
            continue
        if run:
            out.append(run)
        run = [int(at[k]), int(end[k]), int(src[k]), int(tag[k]), int(src_at[k])]
    if run:
        out.append(run)
    split = []
    for a, b, s, t, p in out:
        stop = p + b - a
        while p < stop:
            q = min(stop, (p // block + 1) * block)
            split.append((s, t, p, q - p, a))
            a, p = a + q - p, q
    return split


def _own(window: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matches, out = batch.column(2), []
            for i in range(len(matches)):
                flat = matches[i].values
                got = pieces(tuple(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)), window)
                out.append([dict(zip(("src", "src_tag", "src_at", "len", "at"), x)) for x in got])
            kind = pa.list_(pa.struct([("src", pa.int64()), ("src_tag", pa.int64()), ("src_at", pa.int32()), ("len", pa.int32()), ("at", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], names=["doc_id", "tag", "own"])

    return of


def asked(matches: DataFrame, window: int) -> DataFrame:
    """(doc_id, tag, matches) -> (doc_id, tag, own, wanted): a document's own pieces, and those that others ask of it."""
    own = cut(matches.mapInArrow(_own(window), f"doc_id long, tag long, own {OWN}"))
    wanted = own.select(F.explode("own").alias("o")).select(F.col("o.src").alias("doc_id"), F.col("o.src_tag").alias("tag"), F.col("o.src_at").alias("at"), F.col("o.len").alias("len")).distinct()
    wanted = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "len")).alias("wanted"))
    return own.join(wanted, ["doc_id", "tag"], "full")


_FIELDS = (("src", pa.int64()), ("src_tag", pa.int64()), ("src_at", pa.int32()), ("len", pa.int32()), ("digest", pa.binary()))


class Digests:
    """Columns ``mine`` and ``theirs`` for the documents of a batch (doc_id, tag, ..., own, wanted, ...)."""

    def __init__(self, batch: pa.RecordBatch):
        at = batch.schema.get_field_index
        self.ids, self.tags, self.own, self.wanted = (batch.column(at(c)) for c in ("doc_id", "tag", "own", "wanted"))
        self.rows: tuple[list, list] = ([], [])
        self.ends: tuple[list, list] = ([0], [0])

    def _put(self, side: int, rows: list) -> None:
        self.rows[side].extend(rows)
        self.ends[side].append(len(self.rows[side]))

    def add(self, i: int, unit: Callable[[int, int], bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Digest row ``i``'s own pieces, under the places that they repeat, and those asked of it; (first unit, units) of its own."""
        none = np.zeros(0, np.int64)
        digest = lambda a, n: hashlib.sha256(unit(a, a + n)).digest()[:16]
        own, wanted = self.own[i], self.wanted[i]
        place = none, none
        if own.is_valid and len(own):
            src, tag, src_at, n, at = (own.values.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            self._put(0, list(zip(src.tolist(), tag.tolist(), src_at.tolist(), n.tolist(), map(digest, at.tolist(), n.tolist()))))
            place = at, n
        else:
            self._put(0, [])
        if wanted.is_valid and len(wanted):
            doc_id, doc_tag = self.ids[i].as_py(), self.tags[i].as_py()
            at, n = (wanted.values.field(k).to_numpy(zero_copy_only=False).tolist() for k in range(2))
            self._put(1, [(doc_id, doc_tag, a, m, digest(a, m)) for a, m in zip(at, n)])
        else:
            self._put(1, [])
        return place

    def columns(self) -> dict[str, pa.Array]:
        out = {}
        for name, rows, ends in zip(("mine", "theirs"), self.rows, self.ends):
            fields = list(zip(*rows)) or [()] * len(_FIELDS)
            flat = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(fields, _FIELDS)], names=[k for k, _ in _FIELDS])
            out[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return out


def agree(rows: DataFrame) -> None:
    """Raise unless each of the ``mine`` digests is the one that its place gives in ``theirs``."""
    key = ["src", "src_tag", "src_at", "len"]
    mine = rows.select(F.inline("mine")).distinct()
    theirs = rows.select(F.inline("theirs")).withColumnRenamed("digest", "found").distinct()
    bad = mine.join(theirs, key, "left").where(~F.col("digest").eqNullSafe(F.col("found"))).limit(1).collect()
    if bad:
        raise RuntimeError(f"a repeat differs from its first place: {bad[0].asDict()}")


def finished(rows: DataFrame, names: list[str]) -> DataFrame:
    """Write ``rows``, check their digests, and give the columns ``names``."""
    done = cut(rows)
    agree(done)
    return done.select(*names)


