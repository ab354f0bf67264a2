"""Repeated word windows by recompression.

Rounds rename a text's words: runs of one symbol become a symbol of (symbol, length), then pairs become
a symbol wherever a coin drawn from the symbols' names says left, right. A name is a hash of what it stands
for, so each task can give it alone; each round is a Spark job that gathers the rules (name -> its two parts)
of all tasks and checks that a name has one meaning in the whole corpus. If two meanings share a name, all
rounds start again with other hashes. So equal symbols are equal words, in every text.

A symbol's existence depends on a few neighbours at each round, its context; where a context lies inside a
window, equal windows hold equal symbols. Each window is handed to the highest-level symbol whose context it
holds (the least in a hash order, if several), named by the words of that context. Only names that occur
more than once in the corpus can stand in repeated windows, and the stretches of windows that share such
a symbol are compared in full:

1. count the names (partial sums first, so that a name in a third of all texts is no hot spot);
2. stretches of one name with equal fingerprints: all but the first are repeats as a whole;
3. first stretches of names with several fingerprints: their windows are compared one by one.

Fingerprints are two 64-bit numbers with different bases over the words' names. What they find is then held
against the words themselves (see verify.py); a difference would end the query with an error.

Defined cases: null or blank text has no words; fewer words than a window lose nothing; rows with a null
id keep all and hide nothing; rows that repeat an id with another text are documents of their own (ordered
by the text's hash), rows that repeat both are one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import arrays as A
from dialoom.llm import verify
from dialoom.llm.common import cut, identified, release, text_bytes

WINDOW, ROUNDS = 20, 2
WORD_BASE = 0x9E3779B97F4A7C15
SECOND_BASE = 0xC2B2AE3D27D4EB4D
#: Sets of hashes to try; one clash in a corpus is unlikely, a second set with one more so.
SEEDS = 4
_O = [A.U(x) for x in A.ODD[3000:3032]]
_KEYS = [[np.random.default_rng([seed, k]).integers(0, 1 << 64, 256, dtype=A.U) | A.U(1) for k in range(2)] for seed in range(SEEDS)]


def levels(names: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS, rules: list | None = None) -> list[tuple[np.ndarray, ...]]:
    """For each round (name, context start, context end) of the symbols, in order; contexts that leave the document end outside it.

    ``rules`` gets each round's (name, left part or symbol, right part or length) of the symbols that it names.
    """
    doc = A.ids(bounds)
    h, s, e = names, np.arange(len(names)), np.arange(1, len(names) + 1)
    cs, ce, d = s, e, doc
    out = []
    for r in range(rounds):
        if len(h) < 2:
            break
        joined = d[1:] == d[:-1]
        head = np.concatenate(([True], ~((h[1:] == h[:-1]) & joined)))
        at = np.flatnonzero(head)
        stop = np.concatenate((at[1:], [len(h)]))
        left, right = np.concatenate(([False], joined))[at], np.concatenate((joined, [False]))[stop - 1]
        size = stop - at
        ncs = np.where(left, cs[np.maximum(at - 1, 0)], bounds[d[at]] - 1)
        nce = np.where(right, ce[np.minimum(stop, len(h) - 1)], bounds[d[at] + 1] + 1)
        run, old = np.flatnonzero(size > 1), h[at]
        h = np.where(size > 1, A.mix(old * _O[0] + size.astype(A.U)), old)
        told = [(h[run], old[run], size[run].astype(A.U))]
        cs, ce, d = ncs, nce, d[at]

        joined = d[1:] == d[:-1]
        coin = (A.mix(h + _O[1 + r]) >> A.U(40)) & A.U(1)
        pair = np.concatenate(((coin[:-1] == 0) & (coin[1:] == 1) & joined, [False]))
        second = np.concatenate(([False], pair[:-1]))
        nxt = np.concatenate((np.where(joined, ce[1:], bounds[d[:-1] + 1] + 1), [bounds[-1] + 1]))
        prv = np.concatenate(([bounds[0] - 1], np.where(joined, cs[:-1], bounds[d[1:]] - 1)))
        named = h.copy()
        named[:-1] = np.where(pair[:-1], A.mix(h[:-1] * _O[10] + h[1:] * _O[11] + _O[12]), h[:-1])
        both = np.flatnonzero(pair)
        told.append((named[both], h[both], h[both + 1]))
        if rules is not None:
            rules.append(tuple(np.concatenate(x) for x in zip(*told)))
        ce = np.where(pair, np.concatenate((ce[1:], [0])), np.where(coin == 0, nxt, ce))
        cs = np.where(~pair & (coin == 1), prv, cs)
        keep = ~second
        h, cs, ce, d = named[keep], cs[keep], ce[keep], d[keep]
        out.append((h, cs, ce))
    return out


def first_least(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range [lo, hi) with a member, the first place of its least value: two ranges of the next lower power of two cover it."""
    size, out = hi - lo, np.empty(len(lo), np.int64)
    least, place, width = order, np.arange(len(order)), 1
    while True:
        at = np.flatnonzero((size >= width) & (size < 2 * width))
        a, b = lo[at], hi[at] - width
        out[at] = np.where(least[b] < least[a], place[b], place[a])
        if 2 * width > size.max(initial=0):
            return out
        place = np.where(least[width:] < least[:-width], place[width:], place[:-width])
        least, width = np.minimum(least[width:], least[:-width]), 2 * width


def anchors(names: np.ndarray, bounds: np.ndarray, window: int = WINDOW, symbols: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows, the name of the symbol that each is handed to, and which symbol of the text that is.

    A window that holds no context (it lies in a long run) is its own symbol. ``symbols``: of all levels, if they are known.
    """
    doc = A.ids(bounds)
    starts = np.flatnonzero(np.arange(len(names)) + window <= bounds[1:][doc])
    sums = A.prefix(names, WORD_BASE)
    key, node = np.zeros(len(starts), A.U), -1 - starts
    open_ = np.arange(len(starts))
    for level, (h, cs, ce) in reversed(list(enumerate(levels(names, bounds) if symbols is None else symbols))):
        if not len(open_):
            break
        p = starts[open_]
        lo, hi = np.searchsorted(cs, p), np.searchsorted(ce, p + window, "right")
        some = hi > lo
        c = first_least(A.mix(h ^ _O[20]), lo[some], hi[some])
        key[open_[some]] = A.spans(sums, cs[c], ce[c], WORD_BASE) + _O[21 + level]
        node[open_[some]] = c * ROUNDS + level
        open_ = open_[~some]
    key[open_] = A.spans(sums, starts[open_], starts[open_] + window, WORD_BASE)
    return starts, key, node


def stretches(starts: np.ndarray, node: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows of one symbol: index of the first, count, document. No two windows of a run are equal
    unless they also stand in two runs of one name, as equal windows hold the same symbol at the same place."""
    doc = np.searchsorted(bounds, starts, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (doc[1:] != doc[:-1])))[: len(starts)])
    return first, np.diff(np.concatenate((first, [len(starts)]))), doc[first]


def _named(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' names, where each document's begin, and where each word starts and ends."""
    starts, ends, bounds = A.words(data, offsets)
    return A.spans(A.prefix(_KEYS[seed][0][data]), starts, ends), bounds, starts, ends


def _prints(names: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """Both fingerprints of runs of words."""
    return [pa.array(A.signed(A.spans(A.prefix(names, base), start, end, base))) for base in (WORD_BASE, SECOND_BASE)]


#: The level under which the names of windows' symbols are counted.
SYMBOLS = -1


#: Rules that a task holds before it hands on the distinct ones.
HELD = 1_500_000


def _names(level: int, seed: int):
    """The distinct rules of a round that a task has seen. Round 1 also names the words (level 0); the last also counts windows' symbols."""

    def told(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for k, parts in held.items():
            name, other = (np.concatenate(x) for x in zip(*parts))
            if k == SYMBOLS:
                order = np.argsort(name)
                name, other = name[order], other[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(1, len(name)), bool), name[1:] != name[:-1])))
                yield _rule_rows(k, name[first], np.zeros(len(first), A.U), np.add.reduceat(other, first) if len(first) else other)
            else:
                yield _rule_rows(k, *_distinct(name, other), 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        n = 0
        for batch in batches:
            for _, _, data, offsets in A.chunks(batch.column(2)):
                names, bounds, starts, ends = _named(data, offsets, seed)
                rules: list = []
                symbols = levels(names, bounds, level, rules)
                found = [(level, *_distinct(rules[level - 1][0], _meaning(*rules[level - 1][1:])))] if len(rules) == level else []
                if level == 1:
                    other = A.spans(A.prefix(_KEYS[seed][1][data], SECOND_BASE), starts, ends, SECOND_BASE)
                    found.append((0, *_distinct(names, other + (ends - starts).astype(A.U))))
                if level == ROUNDS:
                    found.append((SYMBOLS, *np.unique(_chunk_stretches(names, bounds, symbols)[0], return_counts=True)))
                for k, name, meaning in found:
                    held.setdefault(k, []).append((name, meaning))
                    n += len(name)
                if n > HELD:
                    yield from told(held)
                    held, n = {}, 0
        yield from told(held)

    return of


def _meaning(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """What a rule says, by a hash that has nothing to do with the one that gives its name."""
    return A.mix(A.mix(left + _O[28]) * _O[29] + A.mix(right + _O[30]))


def _distinct(name: np.ndarray, meaning: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name once, and once more wherever it means something else."""
    codes = pa.array(A.signed(np.ascontiguousarray(name))).dictionary_encode().indices.to_numpy()
    first = np.empty(codes.max(initial=-1) + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    keep = np.concatenate((first, np.flatnonzero(meaning != meaning[first[codes]])))
    return name[keep], meaning[keep]


def _rule_rows(level: int, name: np.ndarray, meaning: np.ndarray, count) -> pa.RecordBatch:
    m = np.broadcast_to(np.int64(count), len(name)) if np.isscalar(count) else count
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(name), level, np.int32)), *[pa.array(A.signed(np.ascontiguousarray(x))) for x in (name, meaning)], pa.array(np.ascontiguousarray(m))], names=["level", "name", "meaning", "m"])


def names_of(rules: DataFrame) -> DataFrame:
    """(level, name, meaning, m) -> (level, name, m, clash): how often a name was told, and whether with more than one meaning."""
    each = rules.groupBy("level", "name").agg(F.min("meaning").alias("low"), F.max("meaning").alias("high"), F.sum("m").alias("m"))
    return each.select("level", "name", "m", (F.col("low") != F.col("high")).alias("clash"))


def named(docs: DataFrame, rounds: int = ROUNDS) -> tuple[int, DataFrame]:
    """The first set of hashes under which each name of each round has one meaning in all texts of (doc_id, tag, text),
    and (key) the windows' symbols that stand more than once."""
    for seed in range(SEEDS):
        for level in range(1, rounds + 1):
            rules = docs.mapInArrow(_names(level, seed), "level int, name long, meaning long, m long")
            kept = cut(names_of(rules).where(F.col("clash") | ((F.col("level") == SYMBOLS) & (F.col("m") > 1))))
            if kept.where("clash").limit(1).count():
                release(kept)
                break
            if level == rounds:
                return seed, kept.select(F.col("name").alias("key"))
            release(kept)
    raise RuntimeError("all sets of hashes give one name to two things")


def _chunk_stretches(names: np.ndarray, bounds: np.ndarray, symbols: list | None = None) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, document) of the stretches."""
    starts, key, node = anchors(names, bounds, symbols=symbols)
    first, n, doc = stretches(starts, node, bounds)
    return key[first], starts[first], n, doc


def _stretches(seed: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in A.chunks(batch.column(2)):
                names, bounds, _, _ = _named(data, offsets, seed)
                key, at, n, doc = _chunk_stretches(names, bounds)
                owner = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(A.signed(key)), *_prints(names, at, at + n + WINDOW - 1), *[batch.column(i).slice(lo, hi - lo).take(owner) for i in (0, 1)], pa.array((at - bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["key", "one", "two", "doc_id", "tag", "at", "n"],
                )

    return of


def _windows(seed: int):
    """(doc_id, tag, text, stretches) -> one row for each window of the stretches."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(3)
            for lo, hi, data, offsets in A.chunks(batch.column(2)):
                names, bounds, _, _ = _named(data, offsets, seed)
                part = rows.slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(part).to_numpy(zero_copy_only=False))
                flat = part.flatten()
                key, at, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                which = np.repeat(np.arange(len(n)), n)
                p = at[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                own, owner = p + bounds[doc[which]], pa.array(doc[which])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[which]), *_prints(names, own, own + WINDOW), *[batch.column(i).slice(lo, hi - lo).take(owner) for i in (0, 1)], pa.array(p.astype(np.int32))],
                    names=["key", "one", "two", "doc_id", "tag", "at"],
                )

    return of


_TO_SPACE = bytes(32 if A.SPACE[i] else i for i in range(256))
KINDS = {"doc_id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept": "binary", "mine": verify.DIGESTS, "theirs": verify.DIGESTS}


def _kept(names: list[str]):
    """(doc_id, tag, text, own, wanted) -> digest of the words outside the repeats, and digests of repeats and of what others repeat."""
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digests = [], verify.Digests(batch)
            for i, text in enumerate(batch.column(2)):
                words = [w for w in text.as_py().translate(_TO_SPACE).split(b" ") if w]
                own = digests.add(i, lambda a, b: b" ".join(words[a:b]))  # noqa: B023
                left = len(words)
                if len(own[0]):
                    gone = np.zeros(len(words) + 1, np.int32)
                    np.add.at(gone, own[0], 1)
                    np.add.at(gone, own[0] + own[1], -1)
                    keep = np.cumsum(gone)[:-1] == 0
                    words, left = list(compress(words, keep)), int(keep.sum())
                kept = b" ".join(words)
                out.append((len(keep) if len(own[0]) else left, (len(keep) - left) if len(own[0]) else 0, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [[]] * 4
            found = {"doc_id": batch.column(0)} | {k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols)} | digests.columns()
            yield pa.RecordBatch.from_arrays([found[x] for x in names], names=names)

    return of


PLACE = ["doc_id", "tag", "at"]


def later(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose ``by`` columns also stand at an earlier (doc_id, tag, at), with the earliest as ``first``.

    The earliest places are written first, so that the rows of one very frequent value are a skewed side of a plain
    join, which Spark splits.
    """
    first = cut(rows.groupBy(*by).agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("m")).where("m > 1").drop("m"))
    return rows.join(first, by).where(F.struct(*PLACE) > F.col("first"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text) with bytes -> (doc_id, tag, own, wanted): the runs of words that also stand earlier, and where (see verify.py)."""
    docs = docs.where("doc_id is not null")
    seed, twice = named(docs)
    every = docs.mapInArrow(_stretches(seed), "key long, one long, two long, doc_id long, tag long, at int, n int")
    flagged = cut(every.join(twice, "key"))
    match = F.struct("at", "n", F.col("first.doc_id").alias("src"), F.col("first.tag").alias("src_tag"), F.col("first.at").alias("src_at")).alias("match")
    whole = later(flagged, ["key", "one", "two"]).select("doc_id", "tag", match)
    firsts = flagged.groupBy("key", "one", "two").agg(F.min(F.struct(*PLACE, "n")).alias("f"))
    several = firsts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    todo = firsts.join(several, "key").select("f.doc_id", "f.tag", F.struct("key", "f.at", "f.n").alias("r")).groupBy("doc_id", "tag").agg(F.collect_list("r").alias("rows"))
    windows = cut(docs.join(todo, ["doc_id", "tag"]).select("doc_id", "tag", "text", "rows").mapInArrow(_windows(seed), "key long, one long, two long, doc_id long, tag long, at int"))
    single = later(windows, ["key", "one", "two"]).withColumn("n", F.lit(1)).select("doc_id", "tag", match)
    matches = cut(whole.unionByName(single).groupBy("doc_id", "tag").agg(F.collect_list("match").alias("matches")))
    release(flagged, windows)
    return verify.asked(matches, WINDOW)


def deduplicated(docs: DataFrame, text: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 and, if asked, the kept text's bytes."""
    source = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text")))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if text else [])]
    every = [*names, "mine", "theirs"]
    rows = source.join(repeats(source), ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "own", "wanted")
    return verify.finished(rows.mapInArrow(_kept(every), ", ".join(f"{n} {KINDS[n]}" for n in every)), names)
