"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm on islands.

Tokens are those of a public byte-level BPE, by ``tokenizers``; each worker keeps the ids of recent pre-tokens,
since the encoding of a text is that of its pre-tokens one after another; those of many texts are cut and told apart together. A text longer than
a sequence is cut into full pieces, of which the first may be shorter; full pieces are sequences already.

The others are dealt by hash into groups of about ``GROUP`` pieces. A group's chromosome is a list of
bins. Each of its islands (one task row each) starts from best-fit decreasing and from random best fits
and breeds: crossover injects whole well-filled bins of one parent into the other, removes bins that hold
a duplicate, and best-fits what that displaces, longest first; mutation empties the worst bins. Between
epochs each island's elite moves to the next island of the ring. Bins that the best island leaves poorly
filled are dissolved and their pieces packed again together, in fewer groups, until one group is left or
a level saves nothing.

Defined cases: null text is the empty text, one token long; rows that repeat an id are texts of their own
(their pieces have the same doc_id); an empty table gives an empty result. Memory: one text, and a group.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import arrays as A
from dialoom.llm.common import cut, worker_cache

SEQUENCE, GROUP = 2048, 4096
ISLANDS, EPOCHS, POPULATION, CHILDREN = 2, 2, 4, 6
#: Bins filled less than this are packed again.
POOR = SEQUENCE - 16
VOCABULARY, KEPT = "byte_bpe_50k.json", 800_000
#: Texts that are encoded together.
TEXTS = 512
#: How the vocabulary's own library splits a text before merging bytes.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Other characters than printable ASCII, its white space and Latin letters.
ODD = r"[^\t\n\v\f\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u024f]"
END = b"\0\0\0\0"
#: Kinds of bytes of texts without odd characters: letters, digits, white space, others.
LETTER, DIGIT, WHITE, OTHER = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KINDS[48:58] = DIGIT
SPACES = b"\t\n\v\f\r "
KINDS[[*SPACES]] = WHITE


#: The characters that the tokenizer's byte-level model has for bytes.
SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARS = {b: chr(b) for b in SEEN} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*SEEN}))}


class Encoder:
    """Text -> token ids as little-endian 32-bit words, with id 0 at the end.

    All ids are the tokenizer's. Texts are split here, which is faster, in numpy or, with odd characters, by ``regex``,
    unless they hold a token that the tokenizer adds to its vocabulary, or a character that it doesn't class as
    ``regex`` does: each odd one is tried when a worker first meets it. Such texts go to the tokenizer whole.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.full, self.odd = regex.compile(PRETOKEN).findall, re.compile(ODD)
        self.model = self.tokenizer.model.tokenize
        self.known: dict[bytes, bytes] = {}
        self.same: dict[str, bool] = {}

    def _classed(self, c: str) -> bool:
        """Whether the tokenizer joins a character to letters, digits and signs as ``regex`` does."""
        if c not in self.same:
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            self.same[c] = all(len(split(x + c)) == len(self.full(x + c)) for x in "a1!")
        return self.same[c]

    def _split(self, text: str) -> list[bytes] | None:
        """The pre-tokens of a text with odd characters; None where the tokenizer has to find them."""
        if any(a in text for a in self.added) or not all(map(self._classed, set(self.odd.findall(text)))):
            return None
        return [t.encode() for t in self.full(text)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, tokens: list[str]) -> list[bytes]:
        """Of pre-tokens, by the tokenizer's model alone: nothing is left to split."""
        model, space = self.model, CHARS[32]
        seen = [t.replace(" ", space) if t.isascii() and t.isprintable() else t.encode().decode("latin-1").translate(CHARS) for t in tokens]
        return [array("I", [x.id for x in model(t)]).tobytes() for t in seen]

    def _ids(self, tokens: list[bytes]) -> list[bytes]:
        """Of different pre-tokens."""
        found = list(map(self.known.get, tokens))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(gaps, self._encode([tokens[i].decode() for i in gaps])):
            found[i] = self.known[tokens[i]] = ids
        return found

    def _joined(self, tokens: list[bytes]) -> bytes:
        """The ids of pre-tokens, some of which may be equal, one after another."""
        some = list(dict.fromkeys(tokens))
        return b"".join(map(dict(zip(some, self._ids(some))).__getitem__, tokens))

    def _stretch(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts' bytes, and how many there are before each offset: each distinct pre-token is looked up once."""
        data = np.frombuffer(raw, np.uint8)
        starts = pretokens(data, offsets)
        ends = np.append(starts[1:], len(data))
        _, at, which = np.unique(A.spans(A.prefix(A.BYTE_KEYS[data]), starts, ends), return_index=True, return_inverse=True)
        moved = np.repeat(starts[at[which]] - starts, ends - starts)
        moved += np.arange(len(data))
        if not (np.array_equal((ends - starts)[at[which]], ends - starts) and np.array_equal(data[moved], data)):  # two share a fingerprint
            of: dict[bytes, int] = {}
            which = np.array([of.setdefault(raw[a:b], len(of)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
            at = np.unique(which, return_index=True)[1]
        found = self._ids([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = size[which]
        until = np.cumsum(own)
        place = np.repeat((np.cumsum(size) - size)[which] - until + own, own)
        place += np.arange(len(place))
        return np.frombuffer(b"".join(found), np.uint32)[place], np.append(0, until)[np.searchsorted(starts, offsets)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Of texts without odd characters and added tokens, about twice ``A.CHUNK`` bytes at a time.

        No pre-token holds a space behind another character than white space, so texts may be cut before such spaces.
        """
        parts = [t.encode() for t in texts]
        raw, offsets = b"".join(parts), np.cumsum([0, *map(len, parts)])
        out, bounds, done, lo = [], np.zeros(len(offsets), np.int64), 0, 0
        while lo < len(raw):
            hi = lo + 2 * A.CHUNK
            while 0 < hi < len(raw) and (raw[hi] != 32 or raw[hi - 1] in SPACES):
                hi = raw.find(b" ", hi + 1)
            hi = len(raw) if hi < 0 else min(hi, len(raw))
            inside = slice(*np.searchsorted(offsets, (lo, hi)))
            ids, before = self._stretch(raw[lo:hi], np.array([0, *(offsets[inside] - lo), hi - lo]))
            bounds[inside] = done + before[1:-1]
            out.append(ids.tobytes())
            done, lo = done + len(ids), hi
        bounds[offsets == len(raw)] = done
        ids, at = b"".join(out), (4 * bounds).tolist()
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT:
            self.known.clear()
        plain = [not self.odd.search(t) and not any(a in t for a in self.added) for t in texts]
        parts = [None if p else self._split(t) for t, p in zip(texts, plain)]
        together = iter(self._plain([t for t, p in zip(texts, plain) if p]))
        whole = iter(self._whole([t for t, p, ps in zip(texts, plain, parts) if not p and ps is None]))
        return [(next(together) if p else next(whole) if ps is None else self._joined(ps)) + END for p, ps in zip(plain, parts)]


def pretokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens (``PRETOKEN``) of texts without odd characters begin in their bytes, of which all above 127 are letters'."""
    kind = KINDS[data]
    start = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=start[1:-1])
    start[offsets] = True
    # white space before something else leaves its last character, which joins that if it is a space
    some = start[:-1] & (kind != WHITE)
    some[offsets[:-1][offsets[:-1] < len(data)]] = False
    some = np.flatnonzero(some)
    some = some[kind[some - 1] == WHITE]
    start[some - 1] = True
    start[some[data[some - 1] == 32]] = False
    # an apostrophe that begins a pre-token takes the endings of PRETOKEN
    quote = np.flatnonzero((data == 39) & start[:-1])
    left = offsets[np.searchsorted(offsets, quote, "right")] - quote
    one, two = (np.where(left > k, data[np.minimum(quote + k, len(data) - 1)], 0).astype(int) for k in (1, 2))
    takes = np.isin(one, [*b"stmd"]) + 2 * np.isin(256 * one + two, [256 * x + y for x, y in (b"re", b"ve", b"ll")])
    start[quote[takes > 0] + 1] = False
    start[(quote + 1 + takes)[takes > 0]] = True
    return np.flatnonzero(start[:-1])


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of a text's pieces."""
    first = (n - 1) % SEQUENCE + 1
    return [(0, first)] + [(s, SEQUENCE) for s in range(first, n, SEQUENCE)]


def _pieces(path: str | None):
    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = worker_cache(("packing", path), lambda: Encoder(path))
        for frame in frames:
            for lo in range(0, len(frame), TEXTS):
                part = frame.iloc[lo : lo + TEXTS]
                out = []
                for doc, uid, ids in zip(part["doc_id"], part["uid"], encode([t or "" for t in part["text"]])):
                    for k, (start, length) in enumerate(cuts(len(ids) // 4)):
                        out.append((doc, uid, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                yield pd.DataFrame(out, columns=["doc_id", "uid", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return of


class Bins:
    """Bins under construction with best-fit search: the fullest bin that still takes a piece."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.mask = 0

    def open(self, items: list[int], room: int) -> None:
        self.bins.append(items)
        self.room.append(room)
        self._file(len(self.bins) - 1, room)

    def _file(self, b: int, room: int) -> None:
        if room:
            self.by_room.setdefault(room, []).append(b)
            self.mask |= 1 << room

    def fit(self, items: list[int]) -> None:
        for i in items:
            n = self.lengths[i]
            m = self.mask >> n
            if not m:
                self.open([i], SEQUENCE - n)
                continue
            room = n + (m & -m).bit_length() - 1
            same = self.by_room[room]
            b = same.pop()
            if not same:
                self.mask ^= 1 << room
            self.bins[b].append(i)
            self.room[b] = room - n
            self._file(b, room - n)


def fitness(bins: list[list[int]], lengths: list[int]) -> tuple[int, float]:
    """Fewer bins are better, then more uneven ones, which leave larger gaps."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    return -len(bins), sum(f * f for f in fill)


def cross(a: list[list[int]], b: list[list[int]], lengths: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Bins of ``b`` into ``a``."""
    full = sorted(range(len(b)), key=lambda k: -sum(lengths[i] for i in b[k]))[: max(1, len(b) // 2)]
    taken = [b[k] for k in full if rng.random() < 0.5] or [b[full[0]]]
    inside = {i for x in taken for i in x}
    out, loose = Bins(lengths), []
    for x in taken:
        out.open(list(x), SEQUENCE - sum(lengths[i] for i in x))
    for x in a:
        if inside.isdisjoint(x):
            out.open(list(x), SEQUENCE - sum(lengths[i] for i in x))
        else:
            loose += [i for i in x if i not in inside]
    out.fit(sorted(loose, key=lambda i: -lengths[i]))
    return out.bins


def mutate(bins: list[list[int]], lengths: list[int], rng: np.random.Generator) -> list[list[int]]:
    """The worst bins and a few others are emptied and fitted again."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    gone = set(order[: 1 + len(bins) // 20]) | {int(k) for k in rng.integers(0, len(bins), 1 + len(bins) // 50)}
    out = Bins(lengths)
    for k, x in enumerate(bins):
        if k not in gone:
            out.open(list(x), SEQUENCE - sum(lengths[i] for i in x))
    out.fit(sorted((i for k in gone for i in bins[k]), key=lambda i: -lengths[i]))
    return out.bins


def evolve(lengths: list[int], population: list[list[list[int]]], rng: np.random.Generator) -> list[list[list[int]]]:
    """One epoch: the best ``POPULATION`` of the old ones and their children, best first."""
    least = -(-sum(lengths) // SEQUENCE)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    noise = rng.random(len(lengths)) * SEQUENCE / 8
    while len(population) < POPULATION:
        start = Bins(lengths)
        start.fit(down if not population else sorted(down, key=lambda i: -lengths[i] - noise[i] * len(population)))
        population.append(start.bins)
        if len(population[0]) == least:
            return population[:1]
    ranked = sorted(((fitness(p, lengths), p) for p in population), key=lambda x: x[0], reverse=True)
    for _ in range(CHILDREN):
        if -ranked[0][0][0] == least:
            break
        i, j = sorted(rng.integers(0, len(ranked), 2))
        child = mutate(cross(ranked[j][1], ranked[i][1], lengths, rng), lengths, rng)
        ranked = sorted([*ranked, (fitness(child, lengths), child)], key=lambda x: x[0], reverse=True)[:POPULATION]
    return [p for _, p in ranked]


def _pack(bins: list[list[int]], n: int) -> bytes:
    at = np.empty(n, np.int32)
    for k, x in enumerate(bins):
        at[x] = k
    return at.tobytes()


def _unpack(blob: bytes) -> list[list[int]]:
    at = np.frombuffer(blob, np.int32)
    order = np.argsort(at, kind="stable")
    return [x.tolist() for x in np.split(order, np.cumsum(np.bincount(at))[:-1])]


def _epoch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(group, island, epoch, lengths, elites) -> those with the island's new population, its elite first."""
    for frame in frames:
        out = []
        for group, island, epoch, lengths, elites in zip(frame["group"], frame["island"], frame["epoch"], frame["lengths"], frame["elites"]):
            sizes = [int(x) for x in lengths]
            rng = np.random.default_rng([int(group), int(island), int(epoch)])
            got = evolve(sizes, [_unpack(e) for e in elites], rng)
            out.append((group, island, epoch, [_pack(p, len(sizes)) for p in got], -len(got[0])))
        yield pd.DataFrame(out, columns=["group", "island", "epoch", "elites", "worth"])


def _fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(group, uids, pieces, lengths, best) -> one row for each piece: its bin, place and the bin's fill."""
    for frame in frames:
        for group, uids, numbers, lengths, best in zip(frame["group"], frame["uids"], frame["pieces"], frame["lengths"], frame["best"]):
            at, size = np.frombuffer(best, np.int32), np.asarray(lengths, np.int64)
            order = np.argsort(at, kind="stable")
            total = np.cumsum(size[order]) - size[order]
            first = np.concatenate(([0], np.flatnonzero(np.diff(at[order])) + 1))
            offset = total - np.repeat(total[first], np.diff(np.concatenate((first, [len(order)]))))
            fill = np.bincount(at, size).astype(np.int64)
            yield pd.DataFrame({"group": group, "uid": np.asarray(uids)[order], "piece": np.asarray(numbers)[order], "length": size[order], "bin": at[order].astype(np.int64), "offset": offset, "fill": fill[at[order]]})


def _level(pieces: DataFrame, groups: int, level: int) -> DataFrame:
    """(uid, piece, length) -> those with group, bin, offset, fill."""
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("uid", "piece", F.lit(level)), F.lit(groups)))
    rows = dealt.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("uid", "piece", "length"))).alias("r"))
    rows = cut(rows.select("group", F.col("r.uid").alias("uids"), F.col("r.piece").alias("pieces"), F.col("r.length").alias("lengths")))
    state = rows.select("group", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "lengths", F.expr("cast(array() as array<binary>)").alias("elites"))
    for epoch in range(EPOCHS):
        bred = state.withColumn("epoch", F.lit(epoch)).repartition(max(1, min(groups * ISLANDS, 4096)), "group", "island")
        bred = cut(bred.mapInPandas(_epoch, "group long, island int, epoch int, elites array<binary>, worth int"))
        moved = bred.select("group", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("elites", 1, 1).alias("guest"))
        state = bred.join(moved, ["group", "island"]).join(rows.select("group", "lengths"), "group").select("group", "island", "lengths", F.concat("guest", "elites").alias("elites"))
    best = bred.groupBy("group").agg(F.max_by(F.element_at("elites", 1), F.struct("worth", -F.col("island"))).alias("best"))
    return cut(rows.join(best, "group").mapInPandas(_fill, "group long, uid long, piece int, length long, bin long, offset long, fill long"))


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, uid (of the row), piece, start, length, ids_crc32."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    return cut(rows.mapInPandas(_pieces(path), "doc_id long, uid long, piece int, start long, length long, ids_crc32 long"))


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    every = pieces(docs, path)
    todo = every.where(F.col("length") < SEQUENCE).select("uid", "piece", "length")
    placed, level, left = [], 0, todo.count()
    while left:
        groups = -(-left // GROUP)
        level += 1
        got = _level(todo, groups, level)
        done = got if groups == 1 else got.where(F.col("fill") >= POOR)
        number = F.lit(level) * (1 << 56) + F.col("group") * (1 << 16) + F.col("bin")
        poor = got.where(F.col("fill") < POOR)
        rest = poor.count() if groups > 1 else 0
        if rest == left:  # nothing was filled; another level would not do better
            done, rest = got, 0
        placed.append(done.select("uid", "piece", number.alias("sequence_id"), "offset"))
        todo, left = poor.select("uid", "piece", "length"), rest
    where = every.where(F.col("length") == SEQUENCE).select("uid", "piece", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for p in placed:
        where = where.unionByName(p)
    return every.join(where, ["uid", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", F.when(F.col("length") < SEQUENCE, F.col("sequence_id")).otherwise(-1 - F.col("sequence_id")).alias("sequence_id"), "offset")
