"""Operators on small tables: against plain versions, exact round trips, and odd rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
from conftest import DATA, rows_of

from dialoom.llm import arrays as A
from dialoom.llm import common, licenses, minhash, mixing, ogg, packing, quality, queries, recompression, suffixes, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("aeiounrstlé") for _ in range(rng.randint(1, 9))) for _ in range(300)]


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus() -> list[tuple]:
    passage, base = prose(60), prose(120)
    texts = [prose(rng.randint(1, 150)) for _ in range(40)]
    texts += [prose(30) + " " + passage + " " + prose(rng.randint(0, 40)) for _ in range(12)]
    for _ in range(12):  # near copies of one text, at all distances
        words = base.split()
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = prose(1)
        texts.append(" ".join(words))
    texts += [base, base.upper(), base.replace(" ", "\n"), "ja " * 400, "ab" * 500, "x" * 700, prose(5000), "", " \t\n", "wort", "a b c d", "a b c d", None]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


ROWS = corpus()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, empty, spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(docs).collect()}
    assert got == brute.near_classes(PAIRS)
    assert minhash.classes(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.classes(odd).collect() if r.doc_id) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v[1] == k}


def test_near_duplicates_of_repeated_ids(spark):
    a, b = prose(60), prose(60)
    rows = [(1, a), (1, a), (2, a + " x"), (3, b), (3, prose(70)), (4, None), (5, ""), (None, a), (6, "a b c"), (7, "A b\nc")]
    frame = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, `_gone` string, `a.b` double")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.classes(frame).collect()))
    assert got == sorted([(1, 56, 1, True), (1, 56, 1, True), (2, 57, 1, False), (3, 56, 3, True), (3, 66, 3, True), (4, 0, 4, True), (5, 0, 5, True), (0, 56, None, True), (6, 1, 6, True), (7, 1, 6, False)])
    kept = minhash.deduplicated(frame)
    assert kept.columns == frame.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 1, 3, 3, 4, 5, 6]


def test_near_duplicates_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 2)  # clusters of many blocks
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(docs).collect()}
    assert got == brute.near_classes(PAIRS)


def test_signatures_are_unbiased():
    a, b = prose(400).split(), prose(400).split()
    one, two = " ".join(a), " ".join(a[:340] + b[:60])
    x, y = (minhash._set(t.encode()) for t in (one, two))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    sig = [np.concatenate([((s[:, None] * minhash._FACTORS + minhash._SHIFTS).min(0)), ((s[:, None] * minhash._FACTORS + minhash._SHIFTS).max(0))]) for s in (x, y)]
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15


def test_word_repeats(docs, empty):
    got = {r[0]: tuple(r[1:]) for r in recompression.deduplicated(docs).collect()}
    assert got == brute.word_repeats(PAIRS)
    assert recompression.deduplicated(empty).count() == 0


def test_byte_repeats(docs, empty):
    got = {r[0]: tuple(r[1:]) for r in suffixes.deduplicated(docs).collect()}
    assert got == brute.byte_repeats(PAIRS)
    assert suffixes.deduplicated(empty).count() == 0
    again = suffixes.rewritten(docs)
    assert again.columns == docs.columns and again.count() == len(ROWS)
    assert all((r.text or "").encode("utf-8") is not None and (r.text is None or r.n_chars == len(r.text)) for r in again.collect())


def test_hot_grams(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 800)  # grams are dealt over several shards, and merged
    got = {r[0]: tuple(r[1:]) for r in suffixes.deduplicated(docs).collect()}
    assert got == brute.byte_repeats(PAIRS)


#: Rows that repeat an id: with the same text, and with others.
TWINS = [(1, "long " * 70 + "x"), (1, "short"), (1, "long " * 70 + "x"), (2, None), (3, "long " * 90), (3, prose(80)), (4, prose(50)), (4, ""), (None, "long " * 60)]


def twins(brute_of):
    """By the definition: documents are (id, text) in the order of id and the text's hash, equal ones are one."""
    import xxhash

    def tag(t):
        return int.from_bytes(xxhash.xxh64((t or "").encode(), seed=42).digest(), "big", signed=True)

    once = sorted({(i, t or "") for i, t in TWINS if i is not None}, key=lambda r: (r[0], tag(r[1])))
    found = brute_of([(k, t) for k, (_, t) in enumerate(once)])
    return sorted(((i, *found[once.index((i, t or ""))]) for i, t in TWINS if i is not None), key=repr)


@pytest.mark.parametrize("operator, plain", [(recompression, brute.word_repeats), (suffixes, brute.byte_repeats)])
def test_repeated_ids(operator, plain, spark):
    got = sorted((tuple(r) for r in operator.deduplicated(spark.createDataFrame(TWINS, "doc_id long, text string")).collect()), key=repr)
    want = twins(plain)
    assert [r for r in got if r[0] is not None] == want
    assert [r[2] for r in got if r[0] is None] == [0]


def test_symbols_of_windows_are_found_once(monkeypatch):
    """The least symbol of each range is the first of its equals, and a task names the symbols of the last round once."""
    import pyarrow as pa

    draw = np.random.default_rng(4)
    order = draw.integers(0, 9, 200).astype(A.U)
    lo = draw.integers(0, 180, 500)
    hi = np.minimum(lo + draw.integers(1, 70, 500), 200)
    assert recompression.first_least(order, lo, hi).tolist() == [a + int(np.argmin(order[a:b])) for a, b in zip(lo, hi)]
    assert recompression.first_least(order[:0], lo[:0], lo[:0]).tolist() == []
    calls, real = [], recompression.levels
    monkeypatch.setattr(recompression, "levels", lambda *x: calls.append(1) or real(*x))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([prose(300).encode()], pa.binary())], names=["doc_id", "tag", "text"])
    assert sum(b.num_rows for b in recompression._names(recompression.ROUNDS, 0)(iter([batch]))) > 0 and len(calls) == 1


def test_components_end_with_stars(spark, monkeypatch):
    from dialoom.llm import components

    written, real = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(1) or real(df))

    def run(pairs):
        written.clear()
        found = components.components(spark.createDataFrame(pairs, "a long, b long")).collect()
        assert len({r.id for r in found}) == len(found)
        return {r.id: r.component for r in found}, len(written)

    assert run([(5, 1), (1, 7), (9, 1), (1, 9), (4, 3), (8, 8)]) == ({1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}, 1)  # stars need no round
    assert run([]) == ({}, 1)
    draw = random.Random(6)
    names = draw.sample(range(1000), 60)
    pairs = list(zip(names[:40], names[1:40])) + [(draw.choice(names[40:50]), draw.choice(names[50:])) for _ in range(12)]
    want = {x: x for p in pairs for x in p}
    for _ in names:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert run(pairs)[0] == want


def test_names_have_one_meaning(spark):
    rows = spark.createDataFrame([(1, 1, 2, 1), (1, 1, 2, 1), (1, 4, 2, 1), (1, 4, 5, 1), (0, 4, 9, 2)], "level int, name long, meaning long, m long")
    some = recompression._distinct(np.array([7, 8, 7, 7], A.U), np.array([1, 2, 1, 3], A.U))
    assert sorted(zip(*(x.tolist() for x in some))) == [(7, 1), (7, 3), (8, 2)] and len(recompression._distinct(np.zeros(0, A.U), np.zeros(0, A.U))[0]) == 0
    assert sorted(tuple(r) for r in recompression.names_of(rows).collect()) == [(0, 4, 2, False), (1, 1, 2, False), (1, 4, 2, True)]


def test_another_set_of_hashes_after_a_clash(docs, monkeypatch):
    clash, seen = recompression.names_of, []

    def names_of(rules):
        seen.append(1)
        return clash(rules).withColumn("clash", F.lit(len(seen) == 2))

    monkeypatch.setattr(recompression, "names_of", names_of)
    assert {r[0]: tuple(r[1:]) for r in recompression.deduplicated(docs).collect()} == brute.word_repeats(PAIRS) and len(seen) == 4


def test_rules_spell_out_symbols():
    names = A.mix(np.array([rng.randrange(1, 5) for _ in range(400)], dtype=A.U))
    told: list = []
    last = recompression.levels(names, np.array([0, 150, 150, 400]), 3, told)[-1]
    meaning = {n: (a, b) for level in told for n, a, b in zip(*(x.tolist() for x in level))}

    def spell(n):
        if n not in meaning:
            return [n]
        a, b = meaning[n]
        return spell(a) * b if b < 400 else spell(a) + spell(b)

    assert sum((spell(n) for n in last[0].tolist()), []) == names.tolist()


def test_verification():
    from dialoom.llm import verify

    match = tuple(np.array(x) for x in ([5, 6, 40], [1, 1, 300], [7, 7, 7], [0, 0, 0], [250, 251, 0]))
    assert sorted(verify.pieces(match, 20)) == [(7, 0, 0, 256, 40), (7, 0, 250, 6, 5), (7, 0, 256, 15, 11), (7, 0, 256, 63, 296)]


def test_verification_finds_differences(spark):
    from dialoom.llm import verify

    one = {"src": 1, "src_tag": 0, "src_at": 5, "len": 9}
    rows = lambda a, b: spark.createDataFrame([([one | {"digest": a}], [one | {"digest": b}])], f"mine {verify.DIGESTS}, theirs {verify.DIGESTS}")
    verify.agree(rows(b"x", b"x"))
    with pytest.raises(RuntimeError):
        verify.agree(rows(b"x", b"y"))


def test_rewritten_keeps_all_columns(spark):
    rows = [(1, prose(60), 5, "a", None), (2, None, 6, "b", 0), (3, "", 7, None, 0)]
    rows += [(4, rows[0][1] + " more", 8, "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` long, row string, n_chars long")
    got = {r[0]: tuple(r) for r in suffixes.rewritten(docs).collect()}
    assert suffixes.rewritten(docs).columns == docs.columns
    assert got == {1: rows[0], 2: rows[1], 3: rows[2], 4: (4, " more", 8, "c", 5)}


def test_copies_are_compared():
    text = np.frombuffer(b"abcdeabcdeabcdxabcde", np.uint8)
    got = suffixes.copies_of(text, np.array([0, 5, 10, 15, 20]), np.array([1, 1, 1, 2]), np.array([9, 3, 1, 0]))
    assert got.tolist() == [1, 1, 2, 3]  # equal bytes with as many windows, the earliest place stands
    assert suffixes.copies_of(text[:0], np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)).tolist() == []


def test_lone_stretches_are_not_sorted(monkeypatch):
    """Of stretches without another of their gram only those that hold it twice are sorted; hot shards sort all."""
    import pyarrow as pa

    assert suffixes.alone(np.array([5, 6, 6, 7]), np.array([1, 1, 1, 2])).tolist() == [True, False, False, False]
    draw = random.Random(5)
    a, b = (bytes(draw.choices(b"abcdefgh", k=130)) for _ in range(2))
    c = b[20:] + b"x" * 9
    rows = [(1, 1, a), (1, 2, a), (2, 3, b), (2, 4, c), (3, 5, b"xyz" * 50)]
    sizes, real = [], suffixes.later_windows
    monkeypatch.setattr(suffixes, "later_windows", lambda text, *x: sizes.append(len(text)) or real(text, *x))
    for sub in (0, 1):
        cols = {"key": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "tag": [0] * 5, "at": [0] * 5, "n": [len(r[2]) - 99 for r in rows], "m": [1, 1, 1, 1, 2], "sub": [sub] * 5, "bytes": [r[2] for r in rows]}
        got = suffixes._shard(pa.table({k: pa.array(v, pa.binary() if k == "bytes" else pa.int32() if k in ("at", "n", "m", "sub") else pa.int64()) for k, v in cols.items()})).to_pylist()
        assert sorted((r["doc_id"], r["at"], r["n"]) for r in got if r["kind"] == 0) == [(2, 0, 31), (4, 0, 11), (5, 3, 48)]
    assert sizes == [len(b) + len(c) + 150, len(a) + len(b) + len(c) + 150]


def test_merging_shards():
    import pyarrow as pa

    rows = [(1, 5, 5, 1, 3, 0, 10), (1, 5, 5, 2, 2, 0, 40), (1, 5, 5, 3, 2, 0, 7), (1, 6, 5, 2, 1, 0, 0), (2, 5, 5, 3, 9, 0, 1)]
    cols = dict(zip(("key", "one", "two", "sub", "doc_id", "tag", "at"), map(list, zip(*rows))))
    got = suffixes._merge(pa.table({k: pa.array(v, pa.int32() if k in ("sub", "at") else pa.int64()) for k, v in cols.items()})).to_pylist()
    assert sorted((r["doc_id"], r["at"], r["src"], r["src_at"]) for r in got) == [(2, 40, 2, 7), (3, 10, 2, 7)]


def test_suffix_array():
    for text in (b"banana" * 40, bytes(rng.randrange(3) for _ in range(500)), b"a" * 300):
        data = np.frombuffer(text, np.uint8)
        ends = np.full(len(data), len(data))
        order, place = suffixes.suffix_array(data, ends, depth=len(data))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffixes.common_prefixes(data, ends, order, place)
        want = [0] + [len(os.path.commonprefix([text[a:], text[b:]])) for a, b in zip(order[:-1], order[1:])]
        assert lcp.tolist() == want


def test_common_prefixes_of_pieces():
    passage = bytes(rng.randrange(99, 123) for _ in range(150))
    # equal suffixes may stand in either order
    for pieces in ([b"A" + passage, b"B" + passage], [b"B" + passage, b"A" + passage], [passage, b"A" + passage], [b"A" + passage, passage], [b"ab" * 80, b"b" + b"ab" * 80, b"a" * 130, b"a" * 130 + b"b"]):
        text, bounds = b"".join(pieces), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        data, ends = np.frombuffer(text, np.uint8), np.repeat(bounds[1:], np.diff(bounds))
        order, place = suffixes.suffix_array(data, ends)
        tails = [text[i : ends[i]] for i in order]
        assert suffixes.common_prefixes(data, ends, order, place).tolist() == [0] + [len(os.path.commonprefix(x)) for x in zip(tails[:-1], tails[1:])]
        again, early = suffixes.later_windows(data, bounds, np.diff(bounds) - 99, np.arange(len(data)))
        starts = [i for i in range(len(data)) if i + 100 <= ends[i]]
        firsts = {}
        for i in starts:
            firsts.setdefault(text[i : i + 100], i)
        assert sorted(early) == sorted(firsts.values()) and sorted(again) == [i for i in starts if i not in set(firsts.values())]


def test_ogg_round_trip(docs, spark, empty):
    media = docs.select("doc_id", "text", ogg.media_column("text").alias("media"))
    got = {r.doc_id: r for r in media.select("doc_id", ogg.read_column(F.col("media")).alias("m")).select("doc_id", "m.*").collect()}
    for i, t in PAIRS:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.intact) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), True)
    rows = ogg.packet_rows(media.select("doc_id", "media"))
    assert rows.where(F.col("serial") == ogg.SAMPLES).count() == rows.where(F.col("serial") == ogg.MARKS).count()
    assert empty.select(ogg.media_column("text")).count() == 0


def test_ogg_damage():
    assert ogg.checksum(b"") == 0
    slow = 0
    for byte in b"OggS and more":
        slow ^= byte << 24
        for _ in range(8):
            slow = (slow << 1 ^ (0x04C11DB7 if slow >> 31 else 0)) & 0xFFFFFFFF
    assert ogg.checksum(b"OggS and more") == slow
    media = bytearray(ogg.encode(b"word " * 9000))
    assert ogg.read(bytes(media))["intact"]
    media[20_000] ^= 1
    got = ogg.read(bytes(media))
    assert not got["intact"] and "bad=1" in got["feature"] and got["payload_bytes"] < 45_000
    whole = ogg.encode(b"word " * 900)
    at = [i for i in range(len(whole)) if whole.startswith(b"OggS", i)]
    lost = ogg.read(whole[at[1] :])  # without the samples' header: all samples are there
    assert (lost["n_bytes"], lost["payload_bytes"], lost["intact"]) == (4500, 4608, False)
    for page, flip in ((0, 30), (1, 30), (1, 24), (2, 60)):
        hurt = bytearray(whole)
        hurt[at[page] + flip] ^= 1
        got = ogg.read(bytes(hurt))
        assert not got["intact"] and got["n_bytes"] == (None if page == 1 else 4500) and got["payload_bytes"] == (4608 if page < 2 else 4608 - 4608 % 960 if got["payload_bytes"] else 0)
    for i in range(0, len(whole), 7):  # cut and bent anywhere
        ogg.read(whole[:i]), ogg.read(whole[i:])
    assert not ogg.read(b"")["intact"] and not ogg.read(b"OggS" * 9)["intact"]


def test_packing(docs, empty, spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    frame = packing.packed(docs).toPandas()
    total = 0
    for i, t in PAIRS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for r in frame[frame["doc_id"] == i].sort_values("piece").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length <= 2048 and (r.piece == 0 or r.length == 2048)
            at += r.length
        assert at == len(ids)
    for _, g in frame.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    assert frame["sequence_id"].nunique() <= math.ceil(total / 2048) + 1
    assert packing.packed(empty).count() == 0
    twice = packing.packed(spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, text string"))
    assert twice.count() == 3 and twice.select("sequence_id", "offset").distinct().count() == 3


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    encode = packing.Encoder()
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c} {c}b{c}{c}'s {c}'s  {c}" for c in points] + ["a <|endoftext|> b<|endoftext|>", "<|endoftext", "", "it''s  \n\n x's \t'll", prose(50) + "\u0558" + prose(50)]
    for lo in range(0, len(texts), 20_000):
        part = texts[lo : lo + 20_000]
        want = tokenizer.encode_batch(part, add_special_tokens=False)
        assert [t for t, w, g in zip(part, want, encode(part)) if np.frombuffer(g, "<u4").tolist() != w.ids + [0]] == []


def test_texts_are_split_as_one(monkeypatch):
    """Texts of ordinary characters, cut and looked up together, get the library's ids; each pre-token goes there once."""
    encode, draw = packing.Encoder(), random.Random(3)
    pick = [" ", " ", "\n", "\t", "'", "'s", "'re", "'l", "'ll", "r", "e", "v", "t", "d", "m", "é", "1", "_", "!", "ab"]
    texts = ["".join(draw.choices(pick, k=draw.randint(0, 12))) for _ in range(20_000)] + [a + b + c for a in pick for b in pick for c in pick]
    sent = []
    library = encode.tokenizer.encode_batch_fast
    want = [e.ids + [0] for e in library(texts, add_special_tokens=False)]
    pre = {t for text in texts for t in encode.full(text)}
    real = packing.Encoder._encode
    monkeypatch.setattr(packing.Encoder, "_encode", lambda self, new: sent.append(list(new)) or real(self, new))
    assert [np.frombuffer(g, "<u4").tolist() for g in encode(texts)] == want
    assert sorted(t for new in sent for t in new) == sorted(pre)
    data = np.frombuffer(b"it's a\n b", np.uint8)
    assert packing.pretokens(data, np.array([0, 0, 3, len(data), len(data)])).tolist() == [0, 2, 3, 4, 6, 7]
    # texts cut at 100 bytes
    monkeypatch.setattr(packing.A, "CHUNK", 100)
    some = ["".join(texts[i : i + 40]) for i in range(0, 400, 40)] + ["", " ", "a" * 300, " " * 300, "a" * 99 + "  b"]
    assert [np.frombuffer(g, "<u4").tolist() for g in encode(some)] == [e.ids + [0] for e in library(some, add_special_tokens=False)]
    # equal fingerprints of different pre-tokens do no harm
    monkeypatch.setattr(packing.A, "spans", lambda sums, start, end: np.zeros(len(start), np.uint64))
    assert [np.frombuffer(g, "<u4").tolist() for g in packing.Encoder()(texts[:500])] == want[:500]


def test_pretokens_skip_what_splits_texts(monkeypatch):
    """Pre-tokens go to the tokenizer's model at once, and get the ids that the tokenizer gives them."""
    encode = packing.Encoder()
    pre = [chr(c) for c in range(256)] + [f" {w}" for w in prose(900).split()] + ["'s", " '", " 12", " ?!", " é\u024f", "  ", "\n\n ", "\u0558", "\U0001f600"]
    want = [e.ids for e in encode.tokenizer.encode_batch(pre, add_special_tokens=False)]
    monkeypatch.setattr(encode, "_whole", lambda texts: [] if not texts else 1 / 0)
    assert [np.frombuffer(g, "<u4").tolist() for g in encode._encode(pre)] == want
    assert [np.frombuffer(g, "<u4").tolist() for g in encode(["  it's 12", "é"])] == [encode.tokenizer.encode(t, add_special_tokens=False).ids + [0] for t in ("  it's 12", "é")]


def test_genetic_packing_covers_all():
    lengths = [rng.randint(1, 2047) for _ in range(400)]
    g = np.random.default_rng(1)
    population = packing.evolve(lengths, [], g)
    better = packing.evolve(lengths, population, g)
    for bins in better:
        assert sorted(i for b in bins for i in b) == list(range(400)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(better[0]) <= len(population[0])


def test_mixing(docs, empty, spark):
    rows = mixing.mix(docs).select("doc_id", "source", "mix.*").collect()
    total = sum(r.size for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.size * r.copies
        assert 0 <= r.copies <= 3 and r.size == len((dict(PAIRS)[r.doc_id] or "").split())
    assert sum(s[1] for s in by.values()) == pytest.approx(total)
    assert all(s[1] <= 3 * s[0] + 1e-9 for s in by.values())
    again = mixing.mixed(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in rows)
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 9, 9, 7, 8), (1, "a b", "x", 9, 9, 7, 8)], "doc_id long, text string, source string, size long, mix long, `a.b` long, c0 long")
    assert mixing.mix(clash).select("size", "mix.copies").collect() == [(9, 1), (9, 1)]
    assert mixing.mixed(clash).columns == clash.columns and [tuple(r) for r in mixing.mixed(clash).collect()] == [(1, "a b", "x", 9, 9, 7, 8)] * 2


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (5000 if i % 41 == 0 else rng.randint(1, 400)), f"s{i % 5 if i % 3 else 0}") for i in range(300)]
    taken = {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("source", "mix.*").collect():
        s = taken.setdefault(r.source, [r.target, 0])
        s[1] += r.size * r.copies
    assert all(abs(w - t) <= 0.1 * t for t, w in taken.values()), taken


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100, 1), ("b", 100, 1), ("c", 1000, 1), ("d", 10, 1)], "key string, source_size long, docs long")
    got = {r.key: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"a": 300.0, "b": 300.0, "c": pytest.approx(580.0), "d": 30.0}


def test_top_k(spark):
    g = np.random.default_rng(3)
    v = (g.normal(size=(300, 8)) * g.exponential(size=(300, 1))).astype("float32")
    v[10:40] = v[5]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (950, [None] * 8), (951, [float("nan")] * 8), (952, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 50 == 0).collect())
    x = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 300, 50):
        order = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2
    plan = topk.search(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_top_k_waves(spark, monkeypatch):
    """Many blocks, so that pairs of them are left out, against all products; repeated ids and ties."""
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    g = np.random.default_rng(8)
    v = (g.normal(size=(600, 6)) * g.exponential(size=(600, 1)) ** 2).astype("float32")
    v[100:130] = v[99]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    df = spark.createDataFrame([*rows, rows[7], (20, [9e9] * 6), (None, rows[3][1])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(df, F.col("vec_id") % 10 == 0).collect())
    x = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 600, 10):
        order = sorted((-int(x[q] @ x[i]), i) for i in range(600) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert got == sorted(want)


def test_top_k_refuses_overflow(spark):
    for big in (1e17, 1e12):
        df = spark.createDataFrame([(0, [big] * 4), (1, [big] * 4)], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="2\\*\\*54|64 bits"):
            topk.search(df, F.col("vec_id") == 0).collect()


def test_licenses(spark, empty):
    rows = [
        (1, "Released under the MIT License."), (2, "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), (3, "cc-by-nc 4.0, CC BY NC"),
        (4, "the license is under the hood"), (5, None), (6, ""), (7, "Licensed under the Apache License, Version 2.0 / apache license version 2"), (7, "Licensed under the Apache License, Version 2.0 / apache license version 2"),
    ]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got}
    assert len(got) == 8
    assert by[1] == (5, 1, 1, 1, "mit", "mit", 1.0)
    assert by[2] == (14, 0, None, None, "", "gpl", 1.0)
    assert by[3] == (8, 2, 0, 5, "cc-by-nc", "cc-by-nc", 1.0)
    assert by[4] == (6, 0, None, None, "", "", 0.0) and by[5] == by[6] == (0, 0, None, None, "", "", 0.0)
    assert by[7] == (12, 2, 3, 8, "apache-2", "apache-2", 1.0)
    assert licenses.scan(empty).count() == 0


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"
    rows = [
        (1, mit), (2, "x\n\n * some other words. " + mit.replace(", ", ",\n * \n * ") + " (the Software)\nand more"), (3, mit.replace(" ", "\n")), (4, mit.replace("copy\n", "copy\n" + "other words\n" * 15)),
        (5, "released\nunder the\r\nMIT license"), (6, "released under the\nfour words between them\nMIT license"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[3] == ("mit", 1.0) and got[4] == got[6] == ("", 0.0) and got[5] == ("mit", 1.0)
    for k, (label, notice) in enumerate(licenses.NOTICES):
        words = notice.split()
        wrapped = [(i, "\n".join(" ".join(words[j : j + i]) for j in range(0, len(words), i))) for i in (1, 2, 5, 11)]
        assert all(label in r.labels.split(",") and r.score == 1.0 for r in licenses.scan(spark.createDataFrame(wrapped, "doc_id long, text string"), {}, licenses.NOTICES[k : k + 1]).collect())


def test_scattered_words_are_no_notice(spark):
    far = lambda notice, n: " ".join(w + " word" * n for w in notice.split())
    gpl = "this work is licensed under the gnu general public license version 3"
    torn = gpl.replace("under", "under" + " other" * 180)
    rows = [(1, far("released under the mit license", 60)), (2, torn), (3, gpl), (4, "long " * 30_000 + gpl + " words" * 30_000), (5, far("released under the mit license", 60).replace(" ", "\n")), (6, None)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, labels string")).collect()}
    assert got == {1: ("", 0.0), 2: ("", 0.0), 3: ("gpl", 1.0), 4: ("gpl", 1.0), 5: ("", 0.0), 6: ("", 0.0)}


def test_line_breaks_do_not_matter(spark):
    rows = []
    for k, (_, notice) in enumerate(licenses.NOTICES):
        words = [w for x in notice.split() for w in ([x, "other"] if rng.random() < 0.3 else [x]) if w == "other" or rng.random() < 0.97]
        rows.append((2 * k, prose(20) + " " + " ".join(words) + " " + prose(20)))
        rows.append((2 * k + 1, "".join(c if c != " " or rng.random() < 0.6 else "\n" for c in rows[-1][1])))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] for k in range(len(licenses.NOTICES))) and sum(bool(x) for x, _ in got.values()) > len(licenses.NOTICES)


def test_null_media(spark):
    frame = spark.createDataFrame([(1, None, "s"), (2, "a text", "t")], "doc_id long, text string, serial string")
    media = frame.select("doc_id", "serial", F.when(F.col("text").isNotNull(), ogg.media_column("text")).alias("media"))
    got = {r.doc_id: r.m for r in media.select("doc_id", ogg.read_column(F.col("media")).alias("m")).collect()}
    assert got[1].n_bytes is None and got[1].feature is None and got[2].n_bytes == 6 and got[2].intact
    packets = ogg.packet_rows(media)
    assert packets.columns == ["doc_id", "serial", "_serial", "packet", "granule", "seconds"] and {r.doc_id for r in packets.collect()} == {2}


def test_toxicity(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 30)
    bad = ["trash", "scummy", "idiotic"]
    texts, labels = [], []
    for i in range(360):
        words = prose(80).split()
        if i % 3 == 0:
            for w in rng.sample(bad, 2):
                words[rng.randrange(80)] = w
        texts.append(" ".join(words)), labels.append(int(i % 3 == 0))
    model = toxicity.train([toxicity.bag(t) for t in texts], np.array(labels))
    held = [prose(60) for _ in range(30)] + [prose(30) + " trashh scummyy " + prose(20) + " idiotics" for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*held, None, ""])], "id int, text string")
    got = [r.score for r in toxicity.scored(df, model).orderBy("id").collect()]
    assert sum(s < 0.5 for s in got[:30]) >= 28 and sum(s >= 0.5 for s in got[30:60]) >= 28
    assert got[60] == got[61] and 0 <= got[60] <= 1
    assert toxicity.train([toxicity.bag(texts[0])], np.array([1])) is None and toxicity.scored(df, None).first().score == 0.0


def test_training_holds_its_sample_once():
    """The driver's share: bags are numbered and weighed in place."""
    import tracemalloc

    g = np.random.default_rng(2)
    ids = np.concatenate([np.sort(g.choice(toxicity.BUCKETS, 1000, replace=False)) for _ in range(4000)]).astype(np.int32)
    shares, bounds, labels = np.full(len(ids), 0.001, np.float32), np.arange(4001) * 1000, np.arange(4000) % 2
    tracemalloc.start()
    toxicity._train(ids, shares, bounds, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < ids.nbytes + shares.nbytes


def test_training_sample_comes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "SAMPLE_ROWS", 8)
    texts = [prose(30) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(60)], "doc_id long, toxic int")
    paths = []
    real = common.cut
    monkeypatch.setattr(common, "cut", lambda df: paths.append(df.rdd.getNumPartitions()) or real(df))
    known, sizes, values = common.labelled_sample(docs, labels, "toxic", (25, 15), common.text_bytes())
    got = dict(values)
    assert known.tolist() == [0] * 25 + [1] * 15 and sorted(got) == list(range(40)) and [len(got[i]) for i in range(40)] == sizes.tolist()
    of = {t.encode(): i % 3 % 2 for i, t in enumerate(texts)}
    assert [of[got[i]] for i in range(40)] == known.tolist() and len(set(got.values())) == 40 and paths == [5]


def test_grams():
    words = ["a", "añb", "trash", "trassh", "x" * 40]
    found, bounds = toxicity.grams(words)
    sets = [set(found[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    for w, got in zip(words, np.diff(bounds).tolist()):
        marked = f"<{w}>"
        assert got == 1 + sum(max(0, len(marked) - n + 1) for n in range(3, 6))
    one = [toxicity.grams([w])[0].tolist() for w in words]
    assert [sorted(x) for x in one] == [sorted(found[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert len(sets[2] & sets[3]) >= 4 and toxicity.grams([])[1].tolist() == [0]
    ids, share = toxicity.bag("Trash trash a")
    assert share.sum() == pytest.approx(1.0) and toxicity.bag(" ,")[0].size == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
@pytest.mark.parametrize("sf, recall, false, right", [("sf0.01", 0.6, 0.03, 0.97), ("sf0.1", 0.88, 0.02, 0.99)])
def test_held_out(sf, recall, false, right, spark):
    """Of both classifiers, by their queries, on the labels that they don't learn from."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    seen = queries.op2_toxicity(spark, f"/root/testdata/{sf}").join(labels, "doc_id").where("held_out and toxic is not null").toPandas()
    assert seen["predicted"].isin([0, 1]).all() and seen["score"].between(0, 1).all() and ((seen["score"] >= 0.5) == (seen["predicted"] == 1)).all()
    toxic = seen[seen["toxic"] == 1]
    assert toxic["predicted"].mean() >= recall and seen[seen["toxic"] == 0]["predicted"].mean() <= false
    seen = queries.op10_quality(spark, f"/root/testdata/{sf}").join(labels, "doc_id").where("held_out and quality is not null").toPandas()
    assert (seen["predicted"] == seen["quality"]).mean() >= right


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_odd_rows(operator, label, spark, empty):
    rows = [(i, ("trash scum " if i % 2 else "") + prose(40)) for i in range(40)] + [(0, prose(9)), (0, prose(9)), (None, "x"), (90, None), (91, ""), (92, "long " * 200_000)]
    docs = spark.createDataFrame([(*r, 1.0, "k") for r in rows], "doc_id long, text string, score double, `a.b` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (1, None), (2, 7), (92, 0)], f"doc_id long, {label} int")
    model = operator.fit(docs, labels, F.lit(True))
    got = operator.scored(docs, model)
    assert got.columns == docs.columns and got.count() == len(rows) and got.where("score between 0 and 1").count() == len(rows)
    again = operator.scored(docs, operator.fit(docs, labels, F.lit(True)))
    assert sorted(r.score for r in got.collect()) == sorted(r.score for r in again.collect())
    assert operator.fit(empty, labels, F.lit(True)) is None and operator.scored(empty, model).count() == 0
    assert operator.fit(docs, labels.limit(0), F.lit(True)) is None


def test_quality(spark):
    good = [prose(rng.randint(40, 200)) for _ in range(150)]
    junk = [" ".join([w for w in prose(4).split() for _ in range(20)]) for _ in range(75)] + [prose(60).upper().replace(" ", "!! ") for _ in range(75)]
    model = quality.train([t.encode() for t in good[:110] + junk[:40] + junk[75:115]], np.array([1] * 110 + [0] * 80))
    held = good[110:] + junk[40:75] + junk[115:]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*held, None, ""])], "id int, text string")
    got = [r.score for r in quality.scored(df, model).orderBy("id").collect()]
    right = [(s >= 0.5) == (i < 40) for i, s in enumerate(got[: len(held)])]
    assert sum(right) / len(right) > 0.9 and got[-1] == got[-2]
    assert quality.train([b"a"], np.array([1])) is None


def test_attention_gradients():
    g = np.random.default_rng(2)
    x, bounds, y = g.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3, 9]), np.array([1, 0, 1])
    first = np.array([0, 4, 4, 10, 12, 14, 16, 18, 20, 24])
    ids = g.integers(0, 5, 24)
    model = quality.Model(g, np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    run = lambda: model.forward(x, bounds, ids, first)
    loss = lambda: -np.mean(np.where(y == 1, np.log(p := run()["p"]), np.log(1 - p)))
    grads = model.gradients(run(), y, bounds)
    for k, w in model.w.items():
        for at in {tuple(0 for _ in w.shape), tuple(min(3, n - 1) for n in w.shape)}:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert grads[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name, plain", [("op5_minhash_dedup", brute.near_classes), ("op6_recompression_dedup", brute.word_repeats), ("op8_suffix_array_dedup", brute.byte_repeats)])
def test_queries_by_brute_force(name, plain, spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = plain(rows)
    columns = {"op5_minhash_dedup": ("n_shingles", "component_id"), "op6_recompression_dedup": ("n_words", "n_removed", "kept_sha256"), "op8_suffix_array_dedup": ("n_bytes", "n_removed", "n_spans", "kept_sha256")}[name]
    got = queries.QUERIES[name](spark, DATA).collect()
    assert {r.doc_id: tuple(r[c] for c in columns) for r in got} == want and len(got) == len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_media_and_packing_queries(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op1_ogg_media(spark, DATA).collect()
    for r in got:
        raw = (rows[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and "intact=1" in r.feature
    packed = queries.op4_pack_sequences(spark, DATA).groupBy("doc_id").agg(F.sum("length").alias("n"), F.min("start").alias("a")).collect()
    assert len(got) == len(packed) == len(rows) and all(r.a == 0 and r.n >= 1 for r in packed)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(name, spark, duck):
    assert rows_of(queries.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck.execute(queries.ORACLES[name]).df())
