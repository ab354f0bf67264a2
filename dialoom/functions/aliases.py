"""Other ways to write a name: without or with the usual beginnings and endings, numerals as words.

Two writings of a name share a key: what is left without a beginning and an ending, its numerals said. A text and
a known value that share one are held against each other word by word, so nothing is enumerated.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import fixed

_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = ((10**9, "billion"), (10**6, "million"), (10**3, "thousand"))


def number_words(n: int) -> str:
    """An English cardinal: 121 is one hundred and twenty-one, 1200 one thousand, two hundred, 1005 one thousand and five."""
    if n < 20:
        return _ONES[n]
    if n < 100:
        return _TENS[n // 10] + (f"-{_ONES[n % 10]}" if n % 10 else "")
    if n < 1000:
        return f"{_ONES[n // 100]} hundred" + (f" and {number_words(n % 100)}" if n % 100 else "")
    for scale, name in _SCALES:
        if n >= scale:
            rest = n % scale
            join = " and " if rest < 100 else ", "
            return f"{number_words(n // scale)} {name}" + (join + number_words(rest) if rest else "")
    raise AssertionError(n)


def digit_words(token: str) -> str:
    return " ".join(_ONES[int(d)] for d in token)


#: Ways to say a numeral: as it is, as a number, or digit by digit.
SAY = (str, lambda t: number_words(int(t)), digit_words)


def is_numeral(token: str) -> bool:
    return token.isascii() and token.isdigit() and len(token) <= 12


def said(text: str, say) -> str:
    """``text`` with its numerals in one way."""
    return " ".join(say(t) if is_numeral(t) else t for t in text.split()) if any(map(is_numeral, text.split())) else text


def stems(text: str) -> set[str]:
    """``text`` with and without a usual beginning and ending."""
    begun = [text, *(text[len(p) :] for p in fixed.NAME_PREFIXES if text.startswith(p))]
    return {*begun, *(x[: len(x) - len(s)] for x in begun for s in fixed.NAME_SUFFIXES if x.endswith(s))}


def keys(text: str) -> list[str]:
    """What all writings of a name have in common: its stems, all numerals said as numbers, or all digit by digit."""
    return sorted({f"{k}{said(stem, SAY[k])}" for stem in stems(text) for k in (1, 2)})


def says(stem: str, other: str) -> bool:
    """Whether ``other`` is ``stem`` but for numerals that are said, all in one way; others may stand as they are."""

    def follows(say) -> bool:
        want = other.split()
        at = 0
        for token in stem.split():
            words = say(token).split() if is_numeral(token) else [token]
            if want[at : at + 1] != [token] and want[at : at + len(words)] != words:
                return False
            at += 1 if want[at : at + 1] == [token] else len(words)
        return at == len(want)

    return stem == other or any(map(is_numeral, stem.split())) and any(map(follows, SAY[1:]))


def is_written(text: str, value: str) -> bool:
    """Whether ``value`` is another writing of ``text``: other beginning or ending, numerals said."""
    return any(says(stem, other) for stem in stems(text) for other in stems(value))


def writings(text: str) -> list[str]:
    """The texts that a misspelled name is compared by: each stem with each beginning and ending, numerals in each of the three ways."""
    begun = {b + stem for stem in stems(text) for b in ("", *(p for p in fixed.NAME_PREFIXES if not stem.startswith(p)))}
    ended = {x + e for x in begun for e in ("", *(s for s in fixed.NAME_SUFFIXES if not x.endswith(s)))}
    return sorted({said(x, say) for x in ended for say in SAY} - {""})


def _column(f, returns: str):
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if None in row else f(*row) for row in zip(*columns)], dtype=object)

    return lambda *columns: F.pandas_udf(of, returns)(*columns)


def key_column(text: Column) -> Column:
    return _column(keys, "array<string>")(text)


def written_column(text: Column, value: Column) -> Column:
    return _column(is_written, "boolean")(text, value)


def writings_column(text: Column) -> Column:
    return _column(writings, "array<string>")(text)
