"""Spelling variants: words one edit apart, found by generating each word's whole neighbourhood.

``words`` counts maximal runs of Latin letters. ``neighbours`` emits, for every word, all distinct strings that
one deletion, replacement or insertion of an observed letter makes of it, and hash-joins them to the vocabulary;
a candidate that is a word is a neighbour, so no distance is ever computed. ``variants`` picks each word's form
and follows forms to the root.

A neighbourhood holds about a thousand strings a word, so candidates never leave the task that makes them:
an edit at or after the k-th letter keeps the first k letters, one before it keeps the last k, and k is the
same for both words of a pair (half of the longer one). Words therefore meet by (end, longer length, k
letters), four rows a word, and these keys are dealt into buckets. A bucket whose rows exceed ``CELL`` is dealt into
square cells, (words that generate, words that are looked up), so no task holds more than its share of a hot key.
Inside a cell candidates are 64-bit sums, made for all words of a length at once; one that hits is spelled out
and compared with the word that it hit.

Defined cases: null texts have no words; a null id counts as the empty text in an occurrence's hash; rows that
repeat an id count each; runs of any length take part (a long word that shares no half with another emits
nothing, as nothing could match); ties for the form go to the smaller word in code-point order; other columns
don't matter; an empty table gives an empty result. Memory: one cell.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import cut, release

LEAST, OFTEN, EVERY, TIMES = 7, 2, 31, 10
#: Maximal runs of at least LEAST letters: a match begins where a run does, as it takes the longest.
RUN = rf"[A-Za-zÀ-ÿ]{{{LEAST},}}"
#: Rows of a bucket, and the most that one cell takes of either kind.
BUCKET, CELL = 50_000, 400_000
PAIRS = "word string, n long, near string, near_n long"


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (word, n): runs, of which one in ``EVERY`` loses a letter by the hash of its id and itself."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).where(F.length("word") >= LEAST)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """(word, n) -> four rows (word, n, first, m, key): by its beginning and end, as one of a pair whose longer word has m letters."""
    length = F.length("word")
    places = [F.struct(F.lit(first).alias("first"), (length + more).alias("m")) for first in (True, False) for more in (0, 1)]
    rows = vocabulary.select("word", "n", F.explode(F.array(*places)).alias("place")).select("word", "n", "place.*")
    k = F.expr("cast((m - 1) div 2 as int)")
    kept = F.when(F.col("first"), F.substring("word", F.lit(1), k)).otherwise(F.substring("word", length - k + 1, k))
    return rows.withColumn("key", F.xxhash64("first", "m", kept))


def _dealt(rows: DataFrame, buckets: int, cell: int) -> DataFrame:
    """Adds (bucket, maker, looked, makes, looks): the cell, and what a row does there."""
    rows = rows.withColumn("bucket", F.expr(f"pmod(key, {buckets})"))
    large = cut(rows.groupBy("bucket").count().where(F.col("count") > cell).select("bucket", F.ceil(F.col("count") / cell).cast("int").alias("parts")))
    rows = rows.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.expr("pmod(xxhash64(word), parts)").cast("int"))

    def at(maker, looked, makes, looks):
        return F.struct(maker.alias("maker"), looked.alias("looked"), makes.alias("makes"), looks.alias("looks"))

    others = F.sequence(F.lit(0), F.col("parts") - 1)
    own, true, false = F.col("part"), F.lit(True), F.lit(False)
    cells = F.concat(F.transform(others, lambda o: at(own, o, true, o == own)), F.transform(F.filter(others, lambda o: o != own), lambda o: at(o, own, false, true)))
    return rows.select("bucket", "key", "first", "m", "word", "n", F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")


def _mixed(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


class Sums:
    """64-bit sums of letters by place: sum of code(letter) * base ** place, wrapping."""

    def __init__(self, seed: int):
        self.code = _mixed(256, seed)
        self.base = _mixed(1, seed + 1)[0] | np.uint64(5)

    def powers(self, n: int) -> np.ndarray:
        out = np.full(n, self.base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    def terms(self, letters: np.ndarray) -> np.ndarray:
        return self.code[letters] * self.powers(letters.shape[1])


class Lookup:
    """The words of one length in a cell: a bit table that turns most candidates away, then their sorted sums."""

    def __init__(self, letters: np.ndarray, rows: np.ndarray, sums: Sums):
        total = sums.terms(letters).sum(1, dtype=np.uint64)
        order = np.argsort(total)
        self.total, self.rows = total[order], rows[order]
        self.clash = bool((self.total[1:] == self.total[:-1]).any())
        bits = max(8, len(rows).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.bit = np.zeros(1 << bits, bool)
        self.bit[self.total >> self.shift] = True

    def hits(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``sums`` and the rows that they hit."""
        at = np.flatnonzero(self.bit[sums >> self.shift])
        found = np.searchsorted(self.total, sums[at])
        found[found == len(self.total)] = 0
        same = self.total[found] == sums[at]
        return at[same], self.rows[found[same]]


def _letters(words: list[str]) -> np.ndarray:
    """All of one length, as Latin-1 bytes."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def neighbourhoods(letters: np.ndarray, alphabet: np.ndarray, first: bool, m: int, targets: dict[int, Lookup], sums: Sums) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(rows of ``letters``, vocabulary rows, candidates spelled out) for all edits that keep the k letters of this end.

    Of the candidates that are equal, one is made: a letter goes, or comes, at the front of its run.
    """
    n, length = letters.shape
    k = (m - 1) // 2
    base = sums.base
    terms = sums.terms(letters)
    before = np.zeros((n, length + 1), np.uint64)
    np.cumsum(terms, 1, out=before[:, 1:])
    total = before[:, -1:]
    codes, powers = sums.code[alphabet], sums.powers(length + 1)

    def spelled(rows, i, skip, put):
        for r, c in zip(rows.tolist(), put):
            w = letters[r].tobytes()
            yield (w[:i] + c + w[i + skip :]).decode("latin-1")

    def found(target, made, fits, i, skip):
        """``made``: sums by row and letter put in; ``fits``: which of them are candidates."""
        rows, letter = np.nonzero(fits)
        at, hit = target.hits(made[rows, letter] if not fits.all() else made.ravel())
        if len(at):
            put = [alphabet[x : x + 1].tobytes() for x in letter[at].tolist()] if skip < 2 else [b""] * len(at)
            yield rows[at], hit, list(spelled(rows[at], i, min(skip, 1), put))

    same = targets.get(length) if length == m else None
    shorter = targets.get(length - 1) if length == m else None
    longer = targets.get(length + 1) if length == m - 1 else None
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    for i in range(k, length + 1) if first else range(k):
        if same and i < length:
            yield from found(same, (total - terms[:, i : i + 1]) + codes * powers[i], letters[:, i : i + 1] != alphabet, i, 1)
        if shorter and i < length:
            made = before[:, i : i + 1] + (total - before[:, i + 1 : i + 2]) * inverse
            fits = np.ones((n, 1), bool) if i == 0 else letters[:, i : i + 1] != letters[:, i - 1 : i]
            yield from found(shorter, made, fits, i, 2)
        if longer:
            made = before[:, i : i + 1] + (total - before[:, i : i + 1]) * base + codes * powers[i]
            fits = np.ones(made.shape, bool) if i == 0 else letters[:, i - 1 : i] != alphabet
            yield from found(longer, made, fits, i, 0)


def _cell(alphabet: np.ndarray):
    def of(cell: pa.Table) -> pa.Table:
        word, n = np.array(cell["word"].to_pylist(), object), cell["n"].to_numpy()
        key, first, m, makes, looks = (cell[c].to_numpy() for c in ("key", "first", "m", "makes", "looks"))
        length = np.fromiter(map(len, word), np.int64, len(word))
        _, where, share = np.unique(key, return_inverse=True, return_counts=True)
        meets = share[where] > 1
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for side, longest in sorted(set(zip(first[meets].tolist(), m[meets].tolist()))):
            here = meets & (first == side) & (m == longest)
            seed = 0
            while True:
                sums = Sums(seed)
                targets = {x: Lookup(_letters(word[at].tolist()), at, sums) for x in (longest - 1, longest) if len(at := np.flatnonzero(here & looks & (length == x)))}
                if not any(t.clash for t in targets.values()):
                    break
                seed += 2
            for x in (longest - 1, longest):
                makers = np.flatnonzero(here & makes & (length == x))
                step = max(1, (1 << 21) // (x + 2 * len(alphabet)))
                for lo in range(0, len(makers), step):
                    at = makers[lo : lo + step]
                    for rows, hits, spelled in neighbourhoods(_letters(word[at].tolist()), alphabet, side, longest, targets, sums):
                        true = word[hits] == np.array(spelled, object)
                        out.append((at[rows[true]], hits[true]))
        a, b = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        columns = [pa.array(word[a], pa.string()), pa.array(n[a], pa.int64()), pa.array(word[b], pa.string()), pa.array(n[b], pa.int64())]
        return pa.table(columns, names=["word", "n", "near", "near_n"])

    return of


def neighbours(vocabulary: DataFrame, bucket: int = BUCKET, cell: int = CELL) -> DataFrame:
    """(word, n), a written table of distinct words -> (word, n, near, near_n) for all pairs one edit apart, both ways round."""
    seen = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct()
    letters = sorted(r.letter for r in seen.collect())  # at most 90: a-z and U+00C0 to U+00FF
    alphabet = np.frombuffer("".join(letters).encode("latin-1"), np.uint8)
    buckets = 4 * vocabulary.count() // bucket + 1
    rows = _dealt(_keyed(vocabulary), buckets, cell)
    return rows.groupBy("bucket", "maker", "looked").applyInArrow(_cell(alphabet), PAIRS)


def variants(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (word, form, root, n, n_near, form_n) for each word of the vocabulary."""
    vocabulary = cut(words(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = neighbours(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    rows = vocabulary.join(near, "word", "left")
    chosen = F.when(-F.col("best.minus") >= TIMES * F.col("n"), F.col("best.near"))
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), chosen.alias("form"), F.when(chosen.isNotNull(), -F.col("best.minus")).alias("form_n")))
    release(vocabulary)
    tops = roots(rows.where("form is not null").select("word", F.col("form").alias("root")))
    return rows.join(tops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root), no cycles -> the same with each root followed to the last. Each round doubles the steps taken.

    A form is ``TIMES`` as frequent as its word, so chains have under twenty steps and five rounds suffice.
    """
    at = cut(links)
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        more = after.where("moved").limit(1).count()
        release(at)
        at = after.drop("moved")
        at._cut_path = after._cut_path
        if not more:
            return at
