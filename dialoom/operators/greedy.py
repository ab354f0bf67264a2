"""Greedy completion from texts, where counting all n-grams would fill the disks: only what prompts reach is counted.

The words are those that ``ngrams.Model.complete`` finds. Each step reads the texts again, once for each length of context, and
keeps only n-grams whose context is asked for the first time. Before they are shuffled, a bit for each hash of a context
leaves out nearly all others; what gets through beside is dropped by the joins. After a context whose likeliest seen
word stands n times, words that stand n - mu - 1 times can't be the best, as their share of the rest is at most mu. So shorter
contexts are only asked how often the remaining words follow them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.operators.ngrams import BEGIN, END, words
from dialoom.sources.tables import dropped, written

#: A filter's bits: sixteen for each key, up to 8 MB in all. Bytes of texts that are taken apart at once.
LEAST_BITS, MOST_BITS, PORTION = 1 << 16, 1 << 26, 1 << 21
_U = np.uint64
_BASE, _ODD = 0x9E3779B97F4A7C15, _U(0xBF58476D1CE4E5B9)
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(n: Column, total: Column, below: Column, mu: float) -> Column:
    return (n + mu * below) / (total + mu)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _ODD
    return x ^ (x >> _U(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes."""
    if not len(starts):
        return np.zeros(0, _U)
    first, last = int(starts.min()), int(ends.max())
    data, starts, ends = data[first:last], starts - first, ends - first
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * _powers(_BASE, len(data))[:-1], dtype=_U)))
    return _mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and where each begins and the last ends."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def _portions(column: pa.Array) -> Iterator[slice]:
    """Ranges of rows of about ``PORTION`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        yield slice(at, stop)
        at = stop


def _key(parts: list[np.ndarray]) -> np.ndarray:
    return reduce(lambda x, y: _mix(x * _ODD + y), parts)


def _keys(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """A hash of each row's columns, which are texts or whole numbers."""
    parts = []
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        if pa.types.is_integer(column.type):
            parts.append(column.to_numpy(zero_copy_only=False).astype(_U))
        else:
            data, at = _bytes(column)
            parts.append(_hashes(data, at[:-1], at[1:]))
    return _key(parts)


class Filter:
    """Whether a row may be one of ``keys`` (about ``count``) by its columns ``names``: one bit for each hash, as many as are broadcast whatever the keys' number."""

    def __init__(self, keys: DataFrame, names: list[str], count: int):
        bits = LEAST_BITS
        while bits < min(MOST_BITS, 16 * count):
            bits *= 2

        def places(batches):
            for batch in batches:
                at = np.unique(_keys(batch, names) & _U(bits - 1))
                longs = np.zeros(bits >> 6, _U)
                np.bitwise_or.at(longs, at >> _U(6), _U(1) << (at & _U(63)))
                i = np.flatnonzero(longs)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(longs[i].view(np.int64))], ["i", "b"])

        found = keys.select(*names).mapInArrow(places, "i long, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()  # 16 MB at most
        longs = np.zeros(bits >> 6, _U)
        longs[found["i"].to_numpy()] = found["b"].to_numpy().view(_U)
        self.names, self.longs = names, keys.sparkSession.sparkContext.broadcast(longs)

    def passes(self, key: np.ndarray) -> np.ndarray:
        longs = self.longs.value
        at = key & _U(64 * len(longs) - 1)
        return (longs[at >> _U(6)] >> (at & _U(63)) & _U(1)).astype(bool)


def among(rows: DataFrame, *filters: Filter) -> DataFrame:
    """Rows that pass one of the filters."""

    def kept(batches):
        for batch in batches:
            passes = np.zeros(batch.num_rows, bool)
            for f in filters:
                passes |= f.passes(_keys(batch, f.names))
            yield batch.filter(pa.array(passes))

    return rows.mapInArrow(kept, rows.schema)


def grams(texts: DataFrame, text: str, names: list[str], *filters: Filter) -> DataFrame:
    """The places of the texts that pass one of the filters, or all: a row of as many words as ``names``, the last the word or end there, the others before it.

    The filters' names are some of the last of ``names``, with or without the word.
    """
    width = len(names)
    begins = max(1, width - 1)
    frame = " ".join([BEGIN] * begins), f"{END} ", " "

    def taken(batches):
        for batch in batches:
            for part in _portions(batch.column(0)):
                column = pc.fill_null(batch.column(0).slice(part.start, part.stop - part.start).cast(pa.large_string()), "")
                before, after, gap = (pa.scalar(x, pa.large_string()) for x in frame)
                data, at = _bytes(pc.binary_join_element_wise(before, column, after, gap))
                blank = np.concatenate(([True], data[at[0] : at[-1]] == 32, [True]))
                edges = np.flatnonzero(blank[1:] != blank[:-1]) + at[0]
                starts, ends = edges[::2], edges[1::2]
                place = np.ones(len(starts), bool)
                first = np.searchsorted(starts, at[:-1])
                for i in range(begins):
                    place[first + i] = False
                place = np.flatnonzero(place)
                if filters:
                    said = _hashes(data, starts, ends)
                    passes = np.zeros(len(place), bool)
                    for f in filters:
                        passes |= f.passes(_key([said[place - (width - 1 - names.index(c))] for c in f.names]))
                    place = place[passes]
                yield pa.RecordBatch.from_arrays([_texts(data, starts[place - i], ends[place - i]) for i in range(width - 1, -1, -1)], names)

    return texts.select(F.col(text)).mapInArrow(taken, ", ".join(f"{c} string" for c in names))


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes as texts."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    at = np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


class _Words:
    """Best next words of texts, found when asked: ``edges`` for whole contexts, ``lower`` for shorter ones by k, each a list of tables."""

    def __init__(self, texts: DataFrame, text: str, order: int, mu: float):
        self.order, self.mu = order, mu
        self.names = [f"c{i}" for i in range(order - 1, 0, -1)]
        self.texts, self.text = texts, text
        self.ones = written(grams(texts, text, ["word"]).groupBy("word").agg(F.count("*").alias("n1")))
        size = self.ones.agg(F.count("*").alias("known"), F.sum("n1").alias("total")).first()
        self.known, self.total = size.known, size.total
        self.edges, self.lower = [], {k: [] for k in range(2, order)}
        if self.known:
            self.even, top = 1.0 / (self.known + 1), self.ones.orderBy(F.desc("n1"), "word").first()
            self.top = top.word, (top.n1 + mu * self.even) / (self.total + mu)

    def context(self, k: int) -> list[str]:
        """The columns of a k-gram's context."""
        return self.names[self.order - k :]

    def seen(self, k: int, new: DataFrame, pairs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Of new contexts: total and the most that a word has. And the k-grams that matter: of new contexts those that can be the best, and ``pairs``."""
        context = self.context(k)
        asked, count = [] if pairs is None else [Filter(pairs, [*context, "word"], pairs.count())], new.count()
        found = grams(self.texts, self.text, [*context, "word"], *[Filter(new, context, count)] * (count > 0), *asked)
        found = written(found.groupBy(*context, "word").agg(F.count("*").alias("n")))
        each = found.groupBy(*context).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
        stats = written(new.join(each, context, "left").select(*context, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("most", F.lit(0)).alias("most")))
        gap = int(self.mu * (self.top[1] if k == 2 else 1.0) + 0.5)  # a shorter context's share is at most 1, and that of a single word at most the first one's
        near = stats.where("most > 0").select(*context, F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("most") - gap), F.col("most"))).alias("n"))
        totals = stats.select(*context, "total")
        if self.lower.get(k):
            totals = totals.unionByName(_union(self.lower[k]).select(*context, "total"))
        rows = written(among(found, Filter(near, [*context, "n"], (gap + 1) * count), *asked).join(totals, context))
        dropped(found)
        return stats, rows

    def ask(self, asked: DataFrame) -> None:
        """Finds the best words after whole contexts that weren't asked before."""
        top, stats, rows, pairs = self.order, {}, {}, None
        for k in range(top, 1, -1):
            new = asked
            if k < top:
                new = asked.select(*self.context(k)).distinct()
                if self.lower[k]:
                    new = new.join(_union(self.lower[k]), self.context(k), "left_anti")
                new = written(new)
            stats[k], rows[k] = self.seen(k, new, pairs)
            if k < top:
                dropped(new)
            pairs = rows[k]
        p = None
        for k in range(2, top + 1):
            context, shorter = self.context(k), self.context(k - 1)
            if k == 2:
                below = rows[k].join(self.ones, "word").withColumn("below", mixed(F.col("n1"), F.lit(self.total), F.lit(self.even), self.mu))
                other = stats[k].select(*context, "total", F.lit(self.top[0]).alias("word"), F.lit(self.top[1]).alias("below"))
            else:
                below = rows[k].join(p.withColumnRenamed("p", "below"), [*shorter, "word"])
                other = stats[k].join(_union(self.lower[k - 1]).select(*shorter, "word", F.col("p").alias("below")), shorter).select(*context, "total", "word", "below")
            last, p = p, below.select(*context, "word", mixed(F.col("n"), F.col("total"), F.col("below"), self.mu).alias("p"))
            if k < top:
                p = written(p)
            first = lambda c: F.struct((-c).alias("m"), "word")
            likely = p.groupBy(*context).agg(F.min(first(F.col("p"))).alias("a"))
            share = F.when(F.col("total") > 0, mixed(F.lit(0), F.col("total"), F.col("below"), self.mu)).otherwise(F.col("below"))
            # where the other was seen here too, its own share is the larger of its two
            best = other.select(*context, "total", first(share).alias("b")).join(likely, context, "left").withColumn("b", F.least("a", "b"))
            best = written(best.select(*context, "total", "b.word", (-F.col("b.m")).alias("p")))
            (self.edges if k == top else self.lower[k]).append(best)
            dropped(stats[k], rows[k], *[last] * (last is not None))

    def close(self) -> None:
        dropped(self.ones, *self.edges, *(t for tables in self.lower.values() for t in tables))


def complete(texts: DataFrame, prompts: DataFrame, most: int = 8, text: str = "text", order: int = 3, mu: float = 2.0) -> DataFrame:
    """(id, prompt) -> with completion: by n-grams of ``texts`` (``order`` of 2 or more) the likeliest next word, again and again, up to ``most`` words or the end."""
    known = _Words(texts, text, order, mu)
    if not known.known:
        known.close()
        return prompts.withColumn("completion", F.lit(None).cast("string"))
    names = known.names
    start = prompts.withColumn("_w", F.concat(F.array(*[F.lit(BEGIN)] * (order - 1)), words(F.col("prompt"))))
    start = start.select(*prompts.columns, *[F.element_at("_w", -i).alias(f"c{i}") for i in range(order - 1, 0, -1)])
    walk = written(start.withColumn("said", F.expr("cast(array() as array<string>)")).withColumn("open", F.lit(True)))
    more = True
    for _ in range(most):
        if more:
            asked = walk.where("open").select(*names).distinct()
            asked = written(asked.join(_union(known.edges), names, "left_anti") if known.edges else asked)
            if more := not asked.isEmpty():
                known.ask(asked)
            dropped(asked)
        # once no context is new, none will be, as what follows the known ones was asked in the step after them
        if not more and walk.where("open").isEmpty():
            break
        on = walk.join(_union(known.edges).select(*names, F.col("word").alias("next")), names, "left")
        on = on.withColumn("open", F.col("open") & (F.col("next") != END))
        moved = [F.when(F.col("open"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(names, [*names[1:], "next"])]
        said = F.when(F.col("open"), F.array_append("said", F.col("next"))).otherwise(F.col("said"))
        before, walk = walk, written(on.select(*prompts.columns, *moved, said.alias("said"), "open"))
        dropped(before)
    known.close()
    return walk.select(*prompts.columns, F.array_join("said", " ").alias("completion"))
