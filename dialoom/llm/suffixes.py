"""Repeated byte strings by per-shard suffix arrays.

Every 100-byte window is handed to the least 24-byte gram in it (in a hash order), so equal windows share
a gram. Consecutive windows of one gram make a stretch; grams that stand in one stretch only, once, can't
hold a repeated window and end here. The other stretches, with the bytes of their windows, are dealt to
shards by gram, which brings equal windows together. In a shard, equal stretches collapse into the earliest,
whose copies are repeats as a whole. A stretch that is then alone with its gram, which stands in it once, holds
no other repeat and is done. With the others the shard

- sorts its suffixes by Larsson-Sadakane refinement: first by seven bytes, then each group of equal
  suffixes by the groups that stand 7, 14, 28, 56 bytes on, until prefixes of 100 bytes are told apart;
- gets the common prefixes of neighbours by Kasai's order: a suffix whose left byte equals its
  neighbour's has its predecessor's common prefix less one, so only the others compare bytes;
- cuts the suffix array where the common prefix is under 100 and keeps the earliest window of each part.

A gram with more than ``SHARD_BYTES`` of stretches is dealt over several shards. Each such shard gives its
earliest window of each kind, in the order of a 128-bit fingerprint, and the shards are merged by binary
search; what a merge takes for equal is then held against the text itself (see verify.py). In a shard,
bytes decide: copies that collapse are compared with the stretch that stands for them.

Defined cases: null text has no bytes; texts under 100 bytes lose nothing; rows with a null id keep all
and hide nothing; rows that repeat an id with another text are documents of their own (ordered by the text's
hash), rows that repeat both are one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm import arrays as A
from dialoom.llm import verify
from dialoom.llm.common import col, cut, identified, release, text_bytes

WINDOW, GRAM = 100, 24
#: Bytes of stretches that a shard aims at; a gram with more is dealt over several shards.
SHARD_BYTES = 1 << 20
#: Windows of a stretch; where more follow one gram (in a long run of one byte), they are another stretch.
LONGEST = 4096
FIRST_DEPTH = 7
SECOND_BASE = 0xA24BAED4963EE405


def slide(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    done, out = 1, values
    while 2 * done <= width:
        out, done = np.minimum(out[:-done], out[done:]), 2 * done
    return np.minimum(out[: len(values) - width + 1], out[width - done :]) if done < width else out


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram, document, first window, windows, grams' places) of the stretches."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none.view(A.U), none, none, none, none
    sums = A.prefix(A.BYTE_KEYS[data])
    at = np.arange(len(data) - GRAM + 1)
    gram = A.spans(sums, at, at + GRAM)
    least = slide(gram, WINDOW - GRAM + 1)
    valid = np.zeros(len(least) + 1, np.int32)
    size = np.diff(offsets)
    some = size >= WINDOW
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, np.minimum(offsets[1:][some] - WINDOW + 1, len(least)), -1)
    p = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    if not len(p):
        return none.view(A.U), none, none, none, none
    key = least[p]
    leaves = gram[p] == key
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (p[1:] != p[:-1] + 1)))
    # windows of two documents are never neighbours, as a document's last 99 places start none
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(p)])))
    if n.max() > LONGEST:
        first = np.concatenate([np.arange(a, a + m, LONGEST) for a, m in zip(first.tolist(), n.tolist())])
        n = np.diff(np.concatenate((first, [len(p)])))
    last = first + n - 1
    inner = np.concatenate(([0], np.cumsum(leaves)))
    places = inner[last] - inner[first] + 1 + (n == LONGEST)
    doc = np.searchsorted(offsets, p[first], "right") - 1
    return key[first], doc, p[first] - offsets[doc], n, places


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in A.chunks(batch.column(2)):
            key, doc, at, n, places = stretches(data, offsets)
            owner = pa.array(doc)
            own = [batch.column(i).slice(lo, hi - lo).take(owner) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(A.signed(key)), *own, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(places.astype(np.int32))], names=["key", "doc_id", "tag", "at", "n", "m"])


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes at least, and their places in it.

    ``ends``: for each position, where its piece of text ends; a suffix ends there, before all others.
    """
    n = len(text)
    left = ends - np.arange(n)
    # seven bytes, zeros after the end, and how many there are, so that what ends sorts first
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(8, np.uint8))), 8)[:n]
    code = np.ascontiguousarray(eight).view(">u8").ravel().astype(A.U)
    short = np.flatnonzero(left < FIRST_DEPTH)
    code[short] &= ~A.U(0) << (A.U(8) * (A.U(8) - left[short].astype(A.U)))
    code = (code & ~A.U(255)) | np.minimum(left, FIRST_DEPTH).astype(A.U)
    order = np.argsort(code)
    code = code[order]

    def last_of_group(same: np.ndarray) -> np.ndarray:
        """same[k]: whether element k equals the one before; each element's group is named by its last place."""
        stop = np.flatnonzero(np.concatenate((~same[1:], [True])))
        return np.repeat(stop, np.diff(np.concatenate(([-1], stop))))

    group_at = last_of_group(np.concatenate(([False], code[1:] == code[:-1])))
    group = np.empty(n, np.int64)
    group[order] = group_at
    h = FIRST_DEPTH
    while h < depth:
        alone = np.concatenate((group_at[:1] == 0, group_at[1:] != group_at[:-1]))  # starts a group
        single = alone & np.concatenate((alone[1:], [True]))
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        members = order[slots]
        nxt = np.where(left[members] > h, group[np.minimum(members + h, n - 1)] + 1, 0)
        code = group_at[slots] * (n + 1) + nxt
        by = np.argsort(code)
        members, code = members[by], code[by]
        order[slots] = members
        same = np.concatenate(([False], code[1:] == code[:-1]))
        group_at[slots] = slots[last_of_group(same)]
        group[members] = group_at[slots]
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, the common prefix with the suffix before (up to where the order is told)."""
    n = len(text)
    before = np.where(place > 0, order[place - 1], -1)
    here = np.arange(n)
    start = np.concatenate(([True], ends[1:] != ends[:-1]))
    has = before >= 0
    reduced = np.zeros(n, bool)
    # the bytes on the left are equal, and neither they nor those here belong to different pieces
    reduced[1:] = has[1:] & has[:-1] & ~start[1:] & ~start[before[1:]] & (before[:-1] + 1 == before[1:]) & (text[:-1] == text[before[:-1]])
    got = np.zeros(n, np.int64)
    todo = np.flatnonzero(has & ~reduced)
    most = np.minimum(ends[todo] - todo, ends[before[todo]] - before[todo])
    length = np.zeros(len(todo), np.int64)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    packed = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(A.U).ravel()
    live = np.arange(len(todo))
    while len(live):
        a, b = todo[live] + length[live], before[todo[live]] + length[live]
        x = packed[a] ^ packed[b]
        same = np.where(x == 0, 8, 0)
        some = np.flatnonzero(x)
        low = x[some] & (~x[some] + A.U(1))
        same[some] = np.round(np.log2(low.astype(np.float64))).astype(np.int64) // 8
        length[live] += same
        live = live[(same == 8) & (length[live] < most[live])]
    got[todo] = np.minimum(length, most)
    base = np.maximum.accumulate(np.where(reduced, 0, here))
    got = np.where(reduced, np.maximum(got[base] - (here - base), 0), got)
    return got[order]


def later_windows(text: np.ndarray, bounds: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows that have an earlier equal (by ``rank``), and of the earliest of each kind.

    bounds: of the pieces; windows: how many window starts each piece has, from its start on.
    """
    piece = A.ids(bounds)
    order, place = suffix_array(text, bounds[1:][piece])
    lcp = common_prefixes(text, bounds[1:][piece], order, place)
    starts = np.arange(len(text)) - bounds[:-1][piece] < windows[piece]
    lows = np.flatnonzero(lcp < WINDOW)
    kind = np.searchsorted(lows, np.arange(len(text)), "right")
    on = starts[order]
    pos, kind = order[on], kind[on]
    first = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))[: len(kind)])
    if not len(first):
        return pos, pos
    least = np.repeat(np.minimum.reduceat(rank[pos], first), np.diff(np.concatenate((first, [len(pos)]))))
    early = rank[pos] == least
    return pos[~early], pos[early]


OUT = "kind int, key long, one long, two long, sub int, doc_id long, tag long, at int, n int"


def _ranks(*columns_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place in the order of its columns, and a row of each place; equal rows share one."""
    by = np.lexsort(columns_[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns_:
        new[1:] |= c[by][1:] != c[by][:-1]
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new) - 1
    return rank, by[new]


def alone(key: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether no other stretch has a stretch's gram, nor that gram a second place in it: equal windows share a gram, as far from their start."""
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    return (count[which] == 1) & (m == 1)


def copies_of(text: np.ndarray, bounds: np.ndarray, n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each piece, the earliest one with the same windows and bytes (itself, if there is none before)."""
    size, here = np.diff(bounds), np.arange(len(n))
    whole = A.spans(A.prefix(A.BYTE_KEYS[text]), bounds[:-1], bounds[1:])
    by = np.lexsort((place, whole, n))
    head = np.concatenate(([True], (whole[by][1:] != whole[by][:-1]) | (n[by][1:] != n[by][:-1])))[: len(by)]
    lead = np.empty(len(n), np.int64)
    lead[by] = by[np.maximum.accumulate(np.where(head, here, 0))]
    other = here[(lead != here) & (size == size[lead])]
    raw, at = memoryview(text.tobytes()), bounds.tolist()
    same = [raw[at[i] : at[i + 1]] == raw[at[j] : at[j + 1]] for i, j in zip(other.tolist(), lead[other].tolist())]
    other = other[np.asarray(same, bool)]
    out = here.copy()
    out[other] = lead[other]
    return out


def _shard(table: pa.Table) -> pa.Table:
    """The stretches of a shard -> ranges of windows that start earlier too (kind 0), and a hot shard's earliest windows (kind 1)."""
    table = table.combine_chunks()
    data, bounds = A.binary(table["bytes"].chunk(0) if table.num_rows else pa.array([], pa.binary()))
    text, bounds = data[bounds[0] : bounds[-1]], bounds - bounds[0]
    doc, tag, at, n, m, key = (table[x].to_numpy() for x in ("doc_id", "tag", "at", "n", "m", "key"))
    sub = table["sub"][0].as_py() if table.num_rows else 0
    dense, some = _ranks(doc, tag)
    place = (dense << 32) + at
    # equal pieces: the earliest stands for all, and all windows of a later one start earlier too
    lead = copies_of(text, bounds, n, place)
    copies = np.flatnonzero(place > place[lead])
    copied = np.repeat(place[copies] - np.cumsum(n[copies]) + n[copies], n[copies]) + np.arange(int(n[copies].sum()))
    kept = np.flatnonzero(lead == np.arange(len(n)))
    if not sub:  # a hot gram's other stretches are in other shards
        kept = kept[~alone(key[kept], m[kept])]
    raw, starts, stops = text.tobytes(), bounds[:-1][kept], bounds[1:][kept]
    text = np.frombuffer(b"".join([raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(stops - starts)))
    n, key, place = n[kept], key[kept], place[kept]
    piece = A.ids(bounds)
    rank = place[piece] + np.arange(len(text)) - bounds[:-1][piece]
    again, early = later_windows(text, bounds, n, rank)
    r = np.unique(np.concatenate((rank[again], copied)))
    first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1] + 1))[: len(r)])
    count = np.diff(np.concatenate((first, [len(r)])))
    zero = np.zeros(len(first), np.int64)
    owner = some[r[first] >> 32]
    cols = [zero, zero, zero, zero, zero, doc[owner], tag[owner], r[first] & 0xFFFFFFFF, count]
    if sub:
        prints = [A.spans(A.prefix(A.mix(A.BYTE_KEYS[text] + A.U(k)), base), early, early + WINDOW, base) for k, base in enumerate((A.BASE, SECOND_BASE))]
        by = np.lexsort((prints[1], prints[0]))
        e = early[by]
        owner = some[rank[e] >> 32]
        one = np.ones(len(e), np.int64)
        more = [one, key[piece[e]], A.signed(prints[0][by]), A.signed(prints[1][by]), one * sub, doc[owner], tag[owner], rank[e] & 0xFFFFFFFF, one]
        cols = [np.concatenate(x) for x in zip(cols, more)]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=[x.split()[0] for x in OUT.split(", ")])


def _merge(table: pa.Table) -> pa.Table:
    """Earliest windows of several shards of hot grams -> those that start earlier in another shard, and where.

    A shard's windows are looked up by binary search in those of the shards before, and the new ones are put in.
    """
    key, one, two, sub, doc, tag, at = (table[x].to_numpy() for x in ("key", "one", "two", "sub", "doc_id", "tag", "at"))
    kind, _ = _ranks(key, one, two)
    place, row_of = _ranks(doc, tag, at)
    by = np.lexsort((kind, sub))
    cuts_ = np.flatnonzero(sub[by][1:] != sub[by][:-1]) + 1
    known, first, late = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for part in np.split(by, cuts_):
        mine, where = kind[part], place[part]
        slot = np.searchsorted(known, mine)
        hit = np.zeros(len(mine), bool)
        inside = slot < len(known)
        hit[inside] = known[slot[inside]] == mine[inside]
        old = first[slot[hit]]
        late.append(np.stack((mine[hit], np.maximum(old, where[hit]))))
        first[slot[hit]] = np.minimum(old, where[hit])
        known, first = np.insert(known, slot[~hit], mine[~hit]), np.insert(first, slot[~hit], where[~hit])
    late = np.concatenate(late, 1) if late else np.zeros((2, 0), np.int64)
    a, b = row_of[late[1]], row_of[first[np.searchsorted(known, late[0])]]
    cols = {"doc_id": doc[a], "tag": tag[a], "at": at[a], "src": doc[b], "src_tag": tag[b], "src_at": at[b]}
    return pa.table({k: pa.array(v, pa.int32() if k.endswith("at") else pa.int64()) for k, v in cols.items()})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tag, text, stretches) -> one row for each stretch, with the bytes of its windows."""
    for batch in batches:
        for lo, hi, data, offsets in A.chunks(batch.column(2)):
            part = batch.column(3).slice(lo, hi - lo)
            doc = np.repeat(np.arange(hi - lo), pa.compute.list_value_length(part).to_numpy(zero_copy_only=False))
            flat, owner = part.flatten(), pa.array(doc)
            at, n = flat.field(3).to_numpy(zero_copy_only=False), flat.field(4).to_numpy(zero_copy_only=False)
            whole = data.tobytes()
            a = offsets[doc] + at
            bytes_ = pa.array([whole[x : x + y + WINDOW - 1] for x, y in zip(a.tolist(), n.tolist())], pa.binary())
            own = [batch.column(i).slice(lo, hi - lo).take(owner) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([flat.field(0), flat.field(1), flat.field(2), *own, flat.field(3), flat.field(4), flat.field(5), bytes_], names=["shard", "sub", "key", "doc_id", "tag", "at", "n", "m", "bytes"])


RANGES = "array<struct<at: int, n: int>>"


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text) with bytes -> those ids with ranges (first window, windows) that start earlier too, and what to verify."""
    docs = docs.where("doc_id is not null")
    marks = docs.mapInArrow(_stretches, "key long, doc_id long, tag long, at int, n int, m int")
    width = F.col("n") + F.lit(WINDOW - 1).cast("long")
    twice = marks.groupBy("key").agg(F.sum("m").alias("total"), F.sum(width).alias("size")).where("total > 1").select("key", "size")
    flagged = cut(marks.join(twice, "key"))
    size = flagged.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    hot = F.col("size") > SHARD_BYTES
    r = F.struct(
        F.when(hot, F.col("key")).otherwise(F.pmod("key", F.lit(shards))).alias("shard"),
        F.when(hot, F.pmod(F.xxhash64("doc_id", "tag", "at"), F.ceil(F.col("size") / SHARD_BYTES)) + 1).otherwise(F.lit(0)).cast("int").alias("sub"),
        "key", "at", "n", "m",
    )
    todo = flagged.select("doc_id", "tag", r.alias("r")).groupBy("doc_id", "tag").agg(F.collect_list("r").alias("rows"))
    pieces = docs.join(todo, ["doc_id", "tag"]).select("doc_id", "tag", "text", "rows").mapInArrow(_pieces, "shard long, sub int, key long, doc_id long, tag long, at int, n int, m int, bytes binary")
    found = cut(pieces.groupBy("shard", "sub").applyInArrow(_shard, OUT))
    release(flagged)
    hot_rows = found.where("kind = 1").select("key", "one", "two", "sub", "doc_id", "tag", "at").withColumn("part", F.pmod("one", F.lit(shards)))
    merged = cut(hot_rows.groupBy("part").applyInArrow(_merge, "doc_id long, tag long, at int, src long, src_tag long, src_at int"))
    ranges = found.where("kind = 0").select("doc_id", "tag", "at", "n").unionByName(merged.select("doc_id", "tag", "at", F.lit(1).alias("n")))
    out = cut(ranges.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("ranges")))
    release(found)
    if not merged.limit(1).count():
        return out.select("*", F.lit(None).cast(verify.OWN).alias("own"), F.lit(None).cast("array<struct<at: int, len: int>>").alias("wanted"))
    matches = merged.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), "src", "src_tag", "src_at")).alias("matches"))
    return out.join(verify.asked(matches, WINDOW), ["doc_id", "tag"], "full")


def _kept(names: list[str]):
    """(doc_id, tag, text, ranges, own, wanted, row) -> digest of the bytes outside the ranges, and digests to compare."""
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            ranges, digests = batch.column(3), verify.Digests(batch)
            for i, text in enumerate(batch.column(2)):
                text = text.as_py()
                digests.add(i, lambda a, b: text[a:b])  # noqa: B023
                size, runs, rest = len(text), 0, text
                if ranges[i].is_valid and len(ranges[i]):
                    flat = ranges[i].values
                    a, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                    gone = np.zeros(size + 1, np.int32)
                    np.add.at(gone, a, 1)
                    np.add.at(gone, a + n + WINDOW - 1, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((size, size - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if "kept" in names else None))
            cols = list(zip(*out)) or [[]] * 5
            done = {"doc_id": batch.column(0), "row": batch.column(batch.num_columns - 1)} | {k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols)} | digests.columns()
            yield pa.RecordBatch.from_arrays([done[x] for x in names], names=names)

    return of


def _results(source: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, text, row if asked for) -> the columns ``names``, once what merges found is verified."""
    kinds = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "string", "mine": verify.DIGESTS, "theirs": verify.DIGESTS}
    if "row" in names:
        kinds["row"] = source.schema["row"].dataType.simpleString()
    every, source = [*names, "mine", "theirs"], identified(source)
    rows = source.join(repeats(source.select("doc_id", "tag", "text")), ["doc_id", "tag"], "left").select("doc_id", "tag", "text", "ranges", "own", "wanted", *(["row"] if "row" in names else []))
    return verify.finished(rows.mapInArrow(_kept(every), ", ".join(f"{n} {kinds[n]}" for n in every)), names)


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _results(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text")), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def rewritten(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with texts (and n_chars, if there) without the bytes that start earlier.

    A character of which a repeat leaves only a part goes as a whole; a null text stays null, and a text that
    loses nothing keeps its n_chars.
    """
    row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], F.col("text").isNull().alias("blank"))
    done = _results(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"), row.alias("row")), ["n_removed", "kept", "row"])
    text = F.when(~F.col("row.blank"), F.col("kept"))
    changed = F.col("n_removed") > 0

    def of(i: int, c: str):
        own = F.col(f"row.c{i}") if c != "text" else text
        return F.when(changed, F.length("kept").cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own

    return done.select(*[of(i, c).alias(c) for i, c in enumerate(docs.columns)])
