"""The codec, the divergence audit and the spelling variants: against the library, SQL and plain loops, and on odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import struct
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from conftest import DATA, rows_of

from dialoom.llm import bpe, divergence, queries, spelling

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(11)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def digest(library, text: str) -> tuple:
    ids = library.encode(text, add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def odd_texts() -> list[str]:
    letters = "aaaabcdeésßñ'.,!?0123 \n\t\r\x0b\x0c\x1c\x1f\x85\xa0<|>́ͅ​ İΣςσǅﬁẞ中😀№²½٣"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(rng.choice(["a", "b", "t", "th", "in"]) for _ in range(40)) for _ in range(500)]
    texts += [chr(x) for x in range(0x20, 0x2200)] + ["<|endoftext|>a<|startoftext|><|endoftext|>", "<|endoftext", "a" * 5000, "ha" * 999, "it's they'll I'd 'sS", "", " ", "</w>"]
    return texts


def test_codec_is_the_librarys(library):
    own = bpe.codec()
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids)}I", own.encode(text))) == ids, text
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_codec_forgets(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    monkeypatch.setattr(bpe, "LONG", 4)
    own = bpe.Codec()
    for text in ["one two three four, five one two", "one two", "six, seven! eight one", "encyclopaedia encyclopaedia one"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_only_reachable_tokens_and_compatible_pairs():
    """Rules ab, abab out of ab ab, and one that the order of rules never lets happen: bab of b and ab needs a b left alone."""
    tokens = {0: "a", 1: "b", 2: "ab", 3: "ba", 4: "abab", 5: "aba"}
    merges = bpe.Merges(tokens, {(0, 1): 2, (1, 0): 3, (2, 2): 4, (0, 3): 5})

    def merged(text: str) -> list[int]:
        """As encoding is defined: the first rule, leftmost place, until none applies."""
        ids = [0 if c == "a" else 1 for c in text]
        while True:
            ways = [(merges.rules[pair], k) for k, pair in enumerate(zip(ids, ids[1:])) if pair in merges.rules]
            if not ways:
                return ids
            made, k = min(ways)
            ids[k : k + 2] = [made]

    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(400)]
    assert [merges.encode(t) for t in texts] == [merged(t) for t in texts]
    assert 5 not in [t for _, t in merges.automaton.values()]  # aba is ab, a
    with pytest.raises(ValueError):
        bpe.Merges(tokens, {(0, 1): 2, (2, 4): 3})


def test_codec_columns(spark, library):
    docs = spark.createDataFrame([(1, "A b", 7), (1, "A b", 7), (None, None, None), (2, "", 0), (3, "long words " * 30_000, 1)], "`ids` int, text string, `a.b` int")
    coded = bpe.encoded(docs)
    assert coded.columns == ["ids", "text", "a.b", "_ids"]
    back = bpe.decoded(coded, ids="_ids").collect()
    assert sorted(r.decoded[:12] for r in back) == ["", "", "a</w> b</w>", "a</w> b</w>", "long</w> wor"]
    assert next(len(r._ids) for r in back if r.ids == 3) == 60_000
    assert bpe.digests(docs.limit(0).withColumnRenamed("ids", "doc_id")).count() == 0
    rows = [(1, "Ünï "), (1, "Ünï "), (None, None), (2, "")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, *r[1:]) for r in got) == sorted((i or 0, *digest(library, t or "")) for i, t in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_codec_query(spark, library):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in queries.op11_bpe_codec(spark, DATA).collect()} == {(r.doc_id, *digest(library, r.text or "")) for r in rows}


def audit(rows: list[tuple], least: int = 3, top: int = 200) -> set[tuple]:
    """[(text, lang, source)] -> the rows of the divergence audit, by plain loops over exact integers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        all_of = Counter()
        for s in sources:
            all_of.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(all_of)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def letters(n: int) -> str:
    return " ".join(rng.choice(["Apfel", "apfel", "été", "ÉTÉ", "x1y", "q-r", "naïve", "the", "The", "ﬁn", "zwölf", "日本"]) for _ in range(n))


AUDITED = [(letters(rng.randint(0, 30)), rng.choice(["de", "fr", None]), rng.choice(["s1", "s2", "s3", "é", "Z", None])) for _ in range(120)]
AUDITED += [(None, "de", "s1"), ("", "xx", "alone"), ("rare once", "yy", "a"), (None, "yy", "b"), ("!!! 123 \x00", "yy", "c"), ("long " * 100_000, "de", "s2"), ("same the same", "zz", "a"), ("same the same", "zz", "a"), ("same", "zz", "b")]


def test_divergence(spark, monkeypatch):
    frame = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(AUDITED)], "doc_id long, text string, lang string, source string, `n` int").repartition(5)
    assert {tuple(r) for r in divergence.audited(frame).collect()} == audit(AUDITED)
    monkeypatch.setattr(divergence, "HELD", 20)  # tasks hand on what they have, again and again
    found = divergence.audited(frame, 2, 3).collect()
    assert {tuple(r) for r in found} == audit(AUDITED, 2, 3) and len(found) == len(set(found))
    assert divergence.audited(frame.limit(0)).count() == 0


def test_shares_of_large_counts(spark):
    rows = [(0, 0, 1), (6, 10, 3), (8_000_000_000_000, 8_000_000_000_000, 5), (3, 7_000_000_000_000, 90), (12_345_678_901, 98_765_432_109, 7)]
    frame = spark.createDataFrame(rows, "n long, total long, terms long")
    got = [r[0] for r in frame.select(divergence.share(frame.n, frame.total, frame.terms)).collect()]
    assert got == [1 + 10**9 * (n + 1) // (total + terms) for n, total, terms in rows]


def test_matches_are_the_regexps():
    texts = [t.encode() for t in odd_texts()]
    matches, sizes = divergence._runs(texts)
    want = [re.findall(divergence.TERM, t.decode().translate(UPPER)) for t in texts]
    assert sizes.tolist() == list(map(len, want)) and [m.decode() for m in matches.to_pylist()] == [x for w in want for x in w]


def variants(rows: list[tuple]) -> set[tuple]:
    """[(doc_id, text)] -> the rows of the spelling variants, by plain loops."""
    seen = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += len(run) >= 7
    n = {w: k for w, k in seen.items() if k >= 2}
    alphabet = set("".join(n))
    near, form = {}, {}
    for w in n:
        made = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in alphabet for k in (0, 1)}
        near[w] = sorted((made & set(n)) - {w}, key=lambda x: (-n[x], x))
        form[w] = near[w][0] if near[w] and n[near[w][0]] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def edited(w: str) -> str:
    i, c = rng.randrange(len(w) + 1), rng.choice("abeéx")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])


def spelled() -> list[tuple]:
    words = ["".join(rng.choice("abeéx") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ababababa", "Übermaß×÷", "letter" * 40, "letter" * 39 + "lettex"]
    words += [edited(rng.choice(words)) for _ in range(150)]
    words += [edited(w) for w in words[-60:]]
    often = [w for w in words for _ in range(rng.choice([1, 2, 2, 3, 25, 300]))]
    rng.shuffle(often)
    rows = [(i, " ".join(often[k : k + 40]).title() if i % 3 else "|".join(often[k : k + 40])) for i, k in enumerate(range(0, len(often), 40))]
    return [*rows, (None, "nullable Nullable 7 nullable"), (0, None), (0, ""), (0, "repeats repeats"), (0, "repeats repeats"), (1, "z" * 20_000 + " " + "z" * 20_000)]


SPELLED = spelled()


def test_spelling(spark):
    frame = spark.createDataFrame([(*r, "w", 3) for r in SPELLED], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.variants(frame).collect()
    want = variants(SPELLED)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(w[1] and w[2] != w[1] for w in want)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_spelling_in_cells(spark):
    words = sorted({w for w, *_ in variants(SPELLED)})
    frame = spelling.cut(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long"))
    whole = spelling.neighbours(frame).collect()
    split = spelling.neighbours(frame, bucket=400, cell=30).collect()  # each bucket is dealt into many cells
    assert sorted(map(tuple, whole)) == sorted(map(tuple, split)) and len(set(whole)) == len(whole)


def test_each_candidate_is_made_once():
    """All candidates that keep an end, by hashing them into a lookup of everything that can be made."""
    alphabet = np.frombuffer("abé".encode("latin-1"), np.uint8)
    for word in ("aabbaéa", "abababab", "aaaaaaa"):
        made = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in "abé" for k in (0, 1)}
        made.discard(word)
        sums, out = spelling.Sums(3), []
        for m in (len(word), len(word) + 1):
            for first in (True, False):
                targets = {}
                for n in {m - 1, m}:
                    of = sorted(x for x in made if len(x) == n)
                    if of:
                        targets[n] = spelling.Lookup(spelling._letters(of), np.arange(len(of)), sums)
                for _, _, made_here in spelling.neighbourhoods(spelling._letters([word]), alphabet, first, m, targets, sums):
                    out += made_here
        assert sorted(out) == sorted(made)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_spelling_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.op13_spelling_variants(spark, DATA).collect()} == variants(rows)


def test_rows_compare(spark):
    """The oracle of the audit reads the same table as its query."""
    import duckdb

    frame = spark.createDataFrame(AUDITED, "text string, lang string, source string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    assert rows_of(divergence.audited(frame).toPandas()) == rows_of(con.execute(divergence.ORACLE).df())
