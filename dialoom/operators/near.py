"""Approximate joins of short texts: pairs at an indel ratio of ``least`` or more, found by an index of letter pairs.

Two texts at that ratio differ by few deletions and insertions, each of which destroys at most two of a text's
letter pairs. So if both texts' pairs are put in one order, rarest first, a bounded beginning of each
must share a pair. Only texts that do, and whose lengths allow the ratio, meet in the comparison; all others
are told apart by an equality join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions.fuzzy import ratio_column


def letter_pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring characters; a text of one character is its own."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(2))))


def lost(least: int) -> float:
    """The share of its length that a text can lose in pairs, at most, to one at a ratio of ``least``.

    With n letters, m in the other and c in common, 2c >= x(n + m), what goes is 2(n - c) + (m - c) pairs; most for
    the shortest m, which is c. Under a half of n, so that a pair of any text is left.
    """
    x = (least - 0.5) / 100
    out = 2 - 2 * x / (2 - x)
    if out >= 0.5:
        raise ValueError("the index needs a ratio of 87 or more")
    return out


def _begun(texts: DataFrame, by: list[str], text: str, counts: DataFrame, least: int) -> DataFrame:
    """(by, text, pair) for the rarest pairs of each text, as many as it can lose and one."""
    rows = texts.select(*by, text, F.explode(letter_pairs(F.col(text))).alias("pair")).join(counts, "pair", "left")
    ranked = rows.groupBy(*by, text).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("pairs"))
    most = F.floor(F.length(text) * lost(least) + 1e-9).cast("int") + 1
    return ranked.select(*by, text, F.explode(F.slice("pairs", F.lit(1), most)).alias("p")).select(*by, text, F.col("p.pair").alias("pair"))


def near_pairs(left: DataFrame, right: DataFrame, a: str, b: str, by: Sequence[str] = (), least: int = 90) -> DataFrame:
    """(by, a, b, score): distinct values of ``left.a`` and ``right.b`` that agree in ``by`` and whose ratio is ``least`` or more.

    Nulls match nothing; an empty text is near the empty one only.
    """
    by = list(by)
    mine = left.select(*by, F.col(a).alias("_a")).where(F.col("_a").isNotNull()).distinct()
    others = right.select(*by, F.col(b).alias("_b")).where(F.col("_b").isNotNull()).distinct()
    counts = others.select(F.explode(letter_pairs(F.col("_b"))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    met = _begun(mine, by, "_a", counts, least).join(_begun(others, by, "_b", counts, least), [*by, "pair"])
    share = (least - 0.5) / 100
    fits = F.greatest(F.length("_a"), F.length("_b")) * (share / (2 - share)) <= F.least(F.length("_a"), F.length("_b")) + 1e-9
    pairs = met.where(fits).select(*by, "_a", "_b").distinct()
    return pairs.withColumn("score", ratio_column("_a", "_b")).where(F.col("score") >= least).select(*by, F.col("_a").alias(a), F.col("_b").alias(b), "score")
