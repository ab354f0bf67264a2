"""Byte-pair encoding by dynamic programming over prefixes, and decoding, with ids as the vocabulary's own library gives them.

A text is normalised and cut into pieces by the vocabulary's rules. Within a piece, no merge is ever carried out: an
automaton over the vocabulary reports every token that is a suffix of each prefix, and of these exactly one can end
the prefix's encoding, the one that is compatible with the last token of the prefix before it. Two tokens are compatible if
encoding their joined text gives these two again, which the edges of their merge trees tell: at no time may the
pieces that then touch merge before either grows. So one token is stored for each prefix, and
back-pointers from the whole piece give its ids. Tokens that their own text doesn't encode to are left out.

Each worker keeps the ids of recent words and pieces; pieces and texts of any length take part, in time that grows with their
length. Strings of the vocabulary's added tokens give those tokens.

Defined cases: null text is the empty text, without ids, decoded to the empty text; rows that repeat an id are
encoded each; columns of any name pass through; an empty table gives an empty result. Memory: one batch of texts and
``KEPT`` words and pieces. Vocabularies with other kinds of rules are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import columns, free_name, worker_cache

VOCABULARY = "word_bpe_49k.json"
#: Words and pieces, and pairs of tokens, that a worker remembers; those longer than LONG are not.
KEPT, PAIRS, LONG = 600_000, 2_000_000, 64
#: Characters that all engines class alike, and as one of them white space.
ORDINARY = bytes([*range(9, 14), *range(32, 127)])
NEVER = 1 << 62


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Merges:
    """A merge table: which tokens can stand side by side, and the automaton of those that can stand at all.

    ``tokens``: id -> symbols, one character each; ``rules``: (left id, right id) -> id of the merged token. A rule of
    a smaller id goes first, the leftmost place first.
    """

    def __init__(self, tokens: dict[int, str], rules: dict[tuple[int, int], int]):
        import ahocorasick

        self.rules, self.known = rules, {}
        parts = {t: pair for pair, t in rules.items()}
        if len(parts) < len(rules) or any(max(pair) >= t for pair, t in rules.items()):
            raise ValueError("each token must come of one rule, whose parts have smaller ids")
        #: A token's first and last part, and theirs, from one symbol up to the token itself.
        self.first: dict[int, tuple[int, ...]] = {}
        self.last: dict[int, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for t in sorted(tokens):
            a, b = parts.get(t, (None, None))
            self.first[t] = (*self.first[a], t) if t in parts else (t,)
            self.last[t] = (*self.last[b], t) if t in parts else (t,)
            if t not in parts or self._touch(a, b) == t:
                self.automaton.add_word(tokens[t], (len(tokens[t]), t))
        self.automaton.make_automaton()

    def _touch(self, a: int, b: int) -> int | None:
        """What first merges across the border of ``a`` and ``b``; None if they stay apart.

        Both grow from their symbols in the order of ids. A merge across takes place if its rule comes before the one
        that takes up its left part (at equal rank the place to the left goes first), and not after the right part's.
        """
        left, right = self.last[a], self.first[b]
        i = j = 0
        while True:
            taken = left[i + 1] if i + 1 < len(left) else NEVER
            grown = right[j + 1] if j + 1 < len(right) else NEVER
            across = self.rules.get((left[i], right[j]), NEVER)
            if across < taken and across <= grown:
                return across
            if taken == grown == NEVER:
                return None
            if taken <= grown:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the joined text of two tokens gives them again."""
        pair = a << 32 | b
        if len(self.known) > PAIRS:
            self.known.clear()
        self.known[pair] = found = self._touch(a, b) is None
        return found

    def encode(self, symbols: str) -> list[int]:
        """The ids of a piece: for each prefix its last token, found once; then back from the end."""
        last, back, done, known = [0] * (len(symbols) + 1), [0] * (len(symbols) + 1), 0, self.known
        for end, (length, token) in self.automaton.iter(symbols):
            end += 1
            if end > done:
                start = end - length
                fits = not start or known.get(last[start] << 32 | token)
                if fits is None:
                    fits = self.compatible(last[start], token)
                if fits:
                    last[end], back[end], done = token, start, end
        out, at = [], len(symbols)
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]


class Codec:
    """Text -> ids -> text, by a tokenizer file."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = path or public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        model, added, cut = rules["model"], rules["added_tokens"], rules["pre_tokenizer"]["pretokenizers"]
        plain = all(not (a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]) for a in added)
        if model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or rules["decoder"] or rules["truncation"] or rules["padding"] or not plain or [c["type"] for c in cut] != ["Split", "ByteLevel"] or cut[0]["behavior"] != "Removed":
            raise ValueError(f"{path} has rules that this codec doesn't know")
        self.library = Tokenizer.from_file(path)
        self.normalised = self.library.normalizer.normalize_str
        self.pieces = regex.compile(cut[0]["pattern"]["Regex"]).findall
        self.added = {a["content"]: array("I", [a["id"]]).tobytes() for a in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.names = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in added}
        self.letters, self.end = byte_letters(), model["end_of_word_suffix"] or ""
        self.merges = Merges(
            {i: self._symbols(bytes(self.letters[c] for c in t.removesuffix(self.end)), t.endswith(self.end)) for t, i in model["vocab"].items()},
            {(model["vocab"][a], model["vocab"][b]): model["vocab"][a + b] for a, b in model["merges"]},
        )
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.same: dict[str, bool] = {}

    @staticmethod
    def _symbols(data: bytes, ends: bool) -> str:
        """One character for each byte; the byte that ends a word is another symbol than the same byte before."""
        return data[:-1].decode("latin-1") + chr(data[-1] + 256 * ends)

    def _classed(self, c: str) -> bool:
        """Whether the library cuts around a character as ``regex`` does."""
        if c not in self.same:
            cut = self.library.pre_tokenizer.pre_tokenize_str
            self.same[c] = all(len(cut(x + c)) == len(self.pieces(x + c)) for x in "a1!")
        return self.same[c]

    def _ids(self, piece: str | bytes) -> bytes:
        data = piece.encode() if isinstance(piece, str) else piece
        return array("I", self.merges.encode(self._symbols(data, True))).tobytes()

    def _cut(self, text: str) -> bytes:
        """The ids of a text's pieces, each found once."""
        plain = text.isascii()
        text = text.lower() if plain else self.normalised(text)
        known, out = self.known, []
        for piece in [text] if plain and text.isalpha() else self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self._ids(piece)
                if len(piece) <= LONG:
                    if len(known) > KEPT:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """A text without added tokens, by its words between white space, which no rule looks beyond."""
        odd = set(text.encode().translate(None, ORDINARY).decode())
        if not all(map(self._classed, odd)):
            cut = self.library.pre_tokenizer.pre_tokenize_str(self.normalised(text))
            return b"".join(self._ids(bytes(map(self.letters.__getitem__, p))) for p, _ in cut)
        if any(map(str.isspace, odd)):
            return self._cut(text)
        parts, words = text.split(), self.words
        new = set(parts).difference(words)
        if not new:
            return b"".join(map(words.__getitem__, parts))
        if len(words) > KEPT:
            words.clear()
            new = set(parts)
        here = {w: self._cut(w) for w in new}
        words.update((w, ids) for w, ids in here.items() if len(w) <= LONG)
        return b"".join(here[w] if w in here else words[w] for w in parts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit words."""
        if "<" not in text and all("<" in a for a in self.added):
            return self._plain(text)
        return b"".join(self.added[x] if k % 2 else self._plain(x) for k, x in enumerate(self.marks.split(text)))

    def decode(self, ids: bytes) -> str:
        """Without a decoder of its own, a vocabulary's tokens are joined by spaces."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


def codec(path: str | None = None) -> Codec:
    """This process's codec of a vocabulary, made once."""
    return worker_cache(("bpe", path), lambda: Codec(path))


def _column(of: Callable[[Codec, object], object], returns: str, path: str | None, source: str | Column) -> Column:
    """A column made of another, row by row in Arrow batches."""

    @F.pandas_udf(returns)
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for batch in batches:
            yield pd.Series([of(own, x) for x in batch], dtype=object)

    return made(source)


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array<int>) of each text; a column of that name gives way to an underscored one."""
    made = _column(lambda own, x: array("I", own.encode(x or "")).tolist(), "array<int>", path, text)
    return docs.select(*columns(docs), made.alias(free_name(docs, ids)))


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text`` of each row's ids; null ids give the empty text."""
    made = _column(lambda own, x: own.decode(array("I", [] if x is None else x).tobytes()), "string", path, ids)
    return rows.select(*columns(rows), made.alias(free_name(rows, text)))


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded."""

    @F.pandas_udf(DIGEST)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(x or "") for x in batch]
            hashes = [[len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(own.decode(x).encode()).hexdigest()] for x in ids]
            yield pd.DataFrame(hashes, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", of("text").alias("digest")).select("doc_id", "digest.*")
