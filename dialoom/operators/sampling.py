"""Deterministic sampling, splits and mixtures; every order is by a hash that other engines compute too."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions.text import portable_order
from dialoom.operators.ranking import ranked


def head_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """int(n * share) rows: under 1 the first in shuffled order, over 1 whole copies and then the rest's head."""
    whole = math.ceil(share) - 1
    part = share - whole
    rows = ranked(df, key, seed, "_k", "_n")
    copies = F.lit(whole) + (F.col("_k") <= F.floor(F.col("_n") * F.lit(float(part)))).cast("int")
    return rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies)))).drop("_n", "_k")


def mixture(parts: dict[str, tuple[DataFrame, float]], key: str, seed: int = 42) -> DataFrame:
    """All modes' shares after one another, with the mode's name."""
    out = None
    for mode, (df, share) in parts.items():
        own = head_share(df, key, share, seed).withColumn("mode", F.lit(mode))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def split(df: DataFrame, key: str, held: int, seed: int = 42) -> DataFrame:
    """``df`` with column split: ``held`` groups go to validation, the others to train."""
    groups = df.select(key).distinct().withColumn("_o", portable_order(F.col(key), seed))
    chosen = groups.orderBy("_o", key).limit(held).select(key, F.lit("validation").alias("_v"))
    return df.join(chosen, key, "left").withColumn("split", F.coalesce("_v", F.lit("train"))).drop("_v")


def sample_groups(df: DataFrame, key: str, n: int, seed: int = 42, replacement: bool = False) -> DataFrame:
    """Rows of ``n`` drawn groups; drawn with replacement, repeats make it fewer groups."""
    groups = df.select(key).distinct()
    if not replacement:
        return df.join(groups.orderBy(portable_order(F.col(key), seed), key).limit(n), key, "left_semi")
    m = groups.count()
    places = ranked(groups, key, seed, "k").withColumn("k", F.col("k") - 1)
    draws = df.sparkSession.range(n).select((F.conv(portable_order(F.col("id"), seed), 16, 10).cast("long") % max(m, 1)).alias("k")).distinct()
    return df.join(places.join(draws, "k").select(key), key, "left_semi")


def random_k(queries: DataFrame, pool: DataFrame, q: str, p: str, k: int, seed: int = 42) -> DataFrame:
    """(q, p, rank): ``k`` pool rows for each query, without replacement, fewer if the pool is smaller.

    Each query draws places in the pool's shuffled order by hashes of its own and keeps its first ``k`` distinct
    ones of 4 k + 32, so it meets that many pool rows, not all. A pool of no more rows is ordered for each query.
    """
    n, draws = pool.count(), 4 * k + 32
    if n <= draws:
        each = queries.select(q).join(pool.select(p), F.lit(True))  # at most ``draws`` rows a query
        place = Window.partitionBy(q).orderBy(portable_order(F.concat_ws(":", F.col(q), F.col(p)), seed), p)
        return each.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    places = ranked(pool.select(p), p, seed, "_k").withColumn("_k", F.col("_k") - 1)
    # drawn within a query's own row, in the order of draws, so that no task holds more than that
    drawn = F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda j: F.conv(portable_order(F.concat_ws(":", F.col(q), j), seed), 16, 10).cast("long") % n)
    first = queries.select(q).distinct().select(q, F.posexplode(F.slice(F.array_distinct(drawn), 1, k)).alias("_at", "_k"))
    return first.join(places, "_k").select(q, p, (F.col("_at") + 1).alias("rank"))


def at_positions(df: DataFrame, positions: tuple[int, ...], *order: str) -> DataFrame:
    """The rows at ``positions`` (from 0) of the order; of the rest no task sees more than the last position asked for."""
    if not positions:
        return df.limit(0)
    head = df.orderBy(*order).limit(max(positions) + 1)
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return head.withColumn("_place", place).where(F.col("_place").isin(*positions)).drop("_place")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(portable_order(F.col(key), seed), key)


def jobs(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``df`` with column chunk: groups dealt in shuffled order, ``size`` a chunk; for write.partitionBy."""
    groups = df.select(key).distinct()
    chunk = ranked(groups, key, seed, "_k").select(key, F.floor((F.col("_k") - 1) / size).cast("int").alias("chunk"))
    return df.join(chunk, key)
