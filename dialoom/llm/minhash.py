"""Near-duplicate documents by min-max hashing of five-word shingles, with exact confirmation.

Each permutation gives a minimum and a maximum, so 80 hash evaluations make a signature of 160 values;
a band is two permutations' minima and maxima. At the threshold of 0.75 a pair misses all 40 bands with
a chance of about 1e-6 (1e-5 for sets of a few shingles, whose minimum and maximum are dependent).

Work never pairs a whole group up. Equal shingle sets collapse into one representative first. In each
band bucket, every member is paired with two leaders (the smallest id, and the smallest id hash of the
band), and pairs are confirmed on full sets from the texts. Buckets that then still hold several
components are gathered into clusters (components of shared buckets), and a cluster's documents are
compared across components in blocks of at most about ``BLOCK`` documents and ``BLOCK_SHINGLES`` shingles:
signatures first (an estimate under ``MAYBE`` is five standard errors below the threshold), then full sets,
and only links that join two components come out. A block holds one class of set sizes, each class a third
larger than the one before, and only blocks of the same or neighbouring classes meet, as sets further apart
can't be linked. Blocks of one large component are never compared with each other.

Sets are sets of 64-bit fingerprints; equal sets are told by their size and two 64-bit sums over two mixes
of these. Texts travel for documents that share a bucket only, once to be kept and once for each pair.

Defined cases: letters A-Z are lowered, others not; fewer than five words make one shingle of all; null
or blank texts have no shingles and link with nothing; rows with a null id link with nothing, get a null
component and are kept; rows that repeat an id are one document, for which the text with the least hash
stands (each row has its own n_shingles); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import arrays as A
from dialoom.llm.common import col, columns, cut, free_name, identified, text_bytes
from dialoom.llm.components import components

SHINGLE, PERCENT = 5, 75
PERMUTATIONS, BANDS = 80, 40
MAYBE = 0.58
#: Documents, and shingles, of a block, two of which one task compares.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Size classes grow by this, a little more than the ratio of sizes that can be linked.
CLASS_RATIO = 1.001 * 100 / PERCENT

_FACTORS, _SHIFTS = A.ODD[:PERMUTATIONS], A.ODD[1000 : 1000 + PERMUTATIONS]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASE_SCHEMA = "doc_id long, tag long, n long, sa long, sb long, keys array<long>, sig binary"


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle fingerprints, repeats included, and where each document's begin."""
    starts, ends, first = A.words(data, offsets)
    named = A.spans(A.prefix(A.BYTE_KEYS[_LOWER[data]]), starts, ends)
    count = np.diff(first)
    doc = A.ids(first)
    last = first[1:][doc]
    here = np.arange(len(named))
    full = here + SHINGLE <= last
    out = np.zeros(len(named), A.U)
    for k in range(SHINGLE):
        moved = named[k:] * A.ODD[2000 + k]
        out[: len(moved)] += np.where(here[: len(moved)] + k < last[: len(moved)], moved, A.U(0))
    out = A.mix(out)
    # a short document's first position stands for its whole word sequence, told apart by its length
    short = (count[doc] < SHINGLE) & (here == first[:-1][doc])
    out[short] = A.mix(out[short] + A.ODD[2100 + count[doc][short]])
    keep = full | short
    return out[keep], np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=len(count)))))


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in A.chunks(batch.column(2)):
            got, bounds = shingles(data, offsets)
            n, sa, sb = (np.zeros(hi - lo, t) for t in (np.int64, A.U, A.U))
            for i in np.flatnonzero(np.diff(bounds)):
                own = np.unique(got[bounds[i] : bounds[i + 1]])
                n[i], sa[i], sb[i] = len(own), A.mix(own + A.U(1)).sum(dtype=A.U), A.mix(own + A.U(2)).sum(dtype=A.U)
            some = np.flatnonzero(n)
            at = bounds[:-1][some]
            sig = np.empty((len(some), 2 * PERMUTATIONS), A.U)
            for p in range(PERMUTATIONS) if len(some) else ():
                v = got * _FACTORS[p]
                v += _SHIFTS[p]
                np.minimum.reduceat(v, at, out=sig[:, 2 * p])
                np.maximum.reduceat(v, at, out=sig[:, 2 * p + 1])
            per = 2 * PERMUTATIONS // BANDS
            keys = np.zeros((len(some), BANDS), A.U)
            for k in range(per):
                keys += sig[:, k::per] * A.ODD[2200 + k]
            keys = A.mix(A.mix(keys) + A.ODD[2300 : 2300 + BANDS])
            brief = (A.mix(sig) >> A.U(48)).astype(np.uint16)
            lengths = np.where(n > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n), pa.array(A.signed(sa)), pa.array(A.signed(sb)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(A.signed(np.ascontiguousarray(keys)).ravel())),
                    pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.concatenate(([0], np.cumsum(np.where(n > 0, 4 * PERMUTATIONS, 0)))).astype(np.int32)), pa.py_buffer(brief.tobytes())]),
                ],
                names=["doc_id", "tag", "n", "sa", "sb", "keys", "sig"],
            )


def _set(text: bytes) -> np.ndarray:
    """A text's shingle set, ordered."""
    return np.unique(shingles(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: tuple[int | None, np.ndarray] = (None, np.zeros(0, A.U))
    for batch in batches:
        a, b, left, right = (batch.column(i) for i in range(4))
        good = np.zeros(len(a), bool)
        for i in range(len(a)):
            if known[0] != (leader := a[i].as_py()):
                known = leader, _set(left[i].as_py())
            good[i] = _linked(known[1], _set(right[i].as_py()))
        yield pa.RecordBatch.from_arrays([a.filter(pa.array(good)), b.filter(pa.array(good))], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of (a, b) pairs, those whose full shingle sets reach the threshold; (id, text) has both texts."""
    rows = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")
    return rows.select("a", "b", "left", "right").mapInArrow(_confirm, "a long, b long")


def _across(frame: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links that join components of two blocks of a cluster (or of one block)."""
    frame = frame.drop_duplicates("id")
    part = frame if frame["one"].iloc[0] == frame["two"].iloc[0] else frame[frame["block"] == frame["one"].iloc[0]]
    other = frame if len(part) == len(frame) else frame[frame["block"] == frame["two"].iloc[0]]
    sig = np.frombuffer(b"".join(other["sig"]), np.uint16).reshape(len(other), -1)
    n_b, id_b, root = other["n"].to_numpy(), other["id"].to_numpy(), other["component"].to_numpy().copy()
    texts = list(other["text"])
    sets: dict[int, np.ndarray] = {}
    up: dict[int, int] = {}

    def top(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    links = []
    for n, c, i, own, text in zip(part["n"], part["component"], part["id"], part["sig"], part["text"]):
        c = top(c)
        near = np.flatnonzero((root != c) & (100 * np.minimum(n, n_b) >= PERCENT * np.maximum(n, n_b)))
        if not len(near):
            continue
        near = near[(sig[near] == np.frombuffer(own, np.uint16)).mean(axis=1) >= MAYBE]
        mine = _set(text) if len(near) else None
        for k in near:
            if root[k] == c:
                continue
            if k not in sets:
                sets[k] = _set(texts[k])
            if _linked(mine, sets[k]):
                links.append((i, id_b[k]))
                up[root[k]] = c
                root[root == root[k]] = c
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _clusters(now: DataFrame) -> DataFrame:
    """(key, id, component, n) -> (cluster, id, component, block, one, two): what to compare with what."""
    split = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("id").alias("lead")).where("x < y")
    open_ = cut(now.join(split.select("key", "lead"), "key").select("id", "component", "n", "lead").distinct())
    cluster = components(open_.select(F.col("id").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("component", "cluster")
    # sets of n and m can be linked only if 4 * min(n, m) >= 3 * max(n, m), so their classes differ by 1 at most
    rows = open_.select("id", "component", "n").distinct().join(cluster, "id").withColumn("class", F.floor(F.log(F.col("n")) / math.log(CLASS_RATIO)))
    sizes = rows.groupBy("cluster", "component", "class").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    blocks_of = lambda m, total: F.greatest(F.lit(1), F.ceil(m / BLOCK), F.ceil(total / BLOCK_SHINGLES))
    large = blocks_of(F.col("m"), F.col("total")) > 1
    small = sizes.where(~large).groupBy("cluster", "class").agg(F.sum("m").alias("rest"), F.sum("total").alias("rest_total"))
    sizes = sizes.join(small, ["cluster", "class"], "left")
    block = F.when(large, F.struct(F.col("component").alias("of"), "class", F.pmod(F.xxhash64("id"), blocks_of(F.col("m"), F.col("total"))).alias("k"))).otherwise(
        F.struct(F.lit(-1).cast("long").alias("of"), "class", F.pmod(F.xxhash64("component"), blocks_of(F.col("rest"), F.col("rest_total"))).alias("k"))
    )
    rows = cut(rows.join(sizes, ["cluster", "component", "class"]).select("cluster", "id", "component", block.alias("block")))
    blocks = rows.select("cluster", "block", F.col("block.class").alias("class")).distinct()
    two = blocks.select("cluster", F.explode(F.array("class", F.col("class") + 1)).alias("class"), F.col("block").alias("one")).join(blocks.select("cluster", "class", F.col("block").alias("two")), ["cluster", "class"])
    two = two.where(((F.col("one.class") < F.col("two.class")) | (F.col("one") <= F.col("two"))) & ((F.col("one.of") != F.col("two.of")) | (F.col("one.of") < 0))).drop("class")
    two = two.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
    return rows.join(two, ["cluster", "block"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``."""
    source = identified(docs.select(col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")))
    base = cut(source.mapInArrow(_base, BASE_SCHEMA))
    again = cut(base.where("tag <> 0").groupBy("doc_id").agg(F.min("tag").alias("tag")))  # one row for each id that repeats
    repeated = again.limit(1).count()

    def once(rows: DataFrame) -> DataFrame:
        """One row for each id."""
        if not repeated:
            return rows.where("doc_id is not null")
        return rows.where("tag = 0 and doc_id is not null").unionByName(rows.join(again, ["doc_id", "tag"]).dropDuplicates(["doc_id"]))

    one = once(base)
    shape = one.where("n > 0").select(F.col("doc_id").alias("id"), "sa", "sb", "n")
    # written first, so that a group with very many copies is a skewed side of a plain join, which Spark splits
    copies = cut(shape.groupBy("sa", "sb", "n").agg(F.min("id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m"))
    members = cut(shape.join(copies, ["sa", "sb", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    chosen = members.where("id = rep").select("id", "n")
    rows = one.select(F.col("doc_id").alias("id"), "keys").join(chosen.select("id"), "id", "left_semi").select("id", F.posexplode("keys").alias("band", "key"))
    spread = F.xxhash64("id", "band")
    leaders = rows.groupBy("key").agg(F.min("id").alias("low"), F.min(F.struct(spread, "id")).alias("drawn"), F.max("id").alias("high")).where("low < high")
    buckets = cut(rows.select("key", "id").join(leaders.select("key", "low", F.col("drawn.id").alias("drawn")), "key"))
    pairs = buckets.select("id", F.explode(F.array("low", "drawn")).alias("lead")).where("id <> lead")
    pairs = cut(pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())
    texts = cut(once(source).select(F.col("doc_id").alias("id"), "text").join(buckets.select("id").distinct(), "id", "left_semi"))
    links = cut(confirmed(pairs, texts))
    linked = cut(components(links.unionByName(members.select(F.col("rep").alias("a"), F.col("id").alias("b")))))

    now = buckets.select("key", "id").join(linked, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")).join(chosen, "id")
    todo = _clusters(now).join(one.select(F.col("doc_id").alias("id"), "n", "sig"), "id").join(texts, "id")
    block_name = lambda c: F.concat_ws(":", F.col(f"{c}.of"), F.col(f"{c}.class"), F.col(f"{c}.k"))
    frames = todo.select("id", "component", "n", "sig", "text", F.col("cluster"), *[block_name(c).alias(c) for c in ("one", "two", "block")])
    more = cut(frames.groupBy("cluster", "one", "two").applyInPandas(_across, "a long, b long"))
    if more.limit(1).count():
        linked = components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    final = linked.groupBy("id").agg(F.min("component").alias("component"))
    out = base.select("doc_id", F.col("n").alias("n_shingles")).join(final, F.col("doc_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose document stands for its class."""
    at = free_name(docs, "_gone")
    gone = classes(docs.select("doc_id", "text")).where("not kept").select(F.col("doc_id").alias(at)).distinct()
    return docs.join(gone, col("doc_id").cast("long") == F.col(at), "left_anti").select(*columns(docs))
