"""Approximate string comparison: indel ratio and partial ratio, 0 to 100.

ratio(a, b) = 100 * 2 * LCS / (|a| + |b|), rounded half to even; two empty strings are equal.
partial(a, b) is the best ratio of the shorter string with a window of its length in the longer one; an
empty string against another scores 0. The longest common subsequence is found with one machine-word
step per character of the longer string (bit parallel), in Arrow-batched functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> int:
    if a == b:
        return 100
    return round(200 * lcs(a, b) / (len(a) + len(b)))


def partial(a: str, b: str) -> int:
    if a == b:
        return 100
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    if a in b:
        return 100
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1))


def _pairwise(f):
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, int] = {}
        out = []
        for pair in zip(a, b):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else f(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="Int32")

    return of


def ratio_column(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_pairwise(ratio), "int")(a, b)


def partial_column(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_pairwise(partial), "int")(a, b)


def ratio_by_fold(a: Column, b: Column) -> Column:
    """The same ratio in higher-order functions alone: a row of the dynamic program is folded over ``a``. A cross-check."""
    bs = F.filter(F.split(b, ""), lambda c: c != "")
    zeros = F.transform(F.concat(F.array(F.lit("")), bs), lambda _: F.lit(0))

    def step(row, ch):
        cells = F.sequence(F.lit(1), F.size(bs))
        grown = F.aggregate(
            F.filter(cells, lambda j: j <= F.size(bs)),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(F.when(F.element_at(bs, j) == ch, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(acc, -1))))),
        )
        return F.when(F.size(bs) > 0, grown).otherwise(row)

    common = F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), zeros, step), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100)).otherwise(F.bround(F.lit(200.0) * common / total, 0)).cast("int")
