"""Turn-ordered operators: context, history, carried values, waves of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.operators.ranking import ranked


def previous(column: str, by: str, order: str) -> Column:
    """The value at the turn before, by position (not by number)."""
    return F.lag(column).over(W.partitionBy(by).orderBy(order))


def context(columns: list[str], by: str, order: str, k: int) -> Column:
    """Structs of the (at most) ``k`` turns before, oldest first."""
    return F.collect_list(F.struct(*columns)).over(W.partitionBy(by).orderBy(order).rowsBetween(-k, -1))


def history(columns: list[str], by: str, order: str) -> Column:
    """Structs of all turns before."""
    return F.collect_list(F.struct(*columns)).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))


def running_mean(column: str, by: str, order: str) -> Column:
    return F.avg(F.col(column).cast("double")).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def contiguous(by: str, order: str) -> Column:
    """Whether every turn number so far equals its position."""
    w = W.partitionBy(by).orderBy(order)
    return F.min((F.row_number().over(w) - 1 == F.col(order)).cast("int")).over(W.partitionBy(by)) == 1


def gathered(df: DataFrame, by: str, order: str, *columns: str) -> DataFrame:
    """(by, turns): each dialogue's turns (at, said) in order; of a repeated turn number the largest row counts."""
    one = df.groupBy(by, F.col(order).alias("at")).agg(F.max(F.struct(*columns)).alias("said"))
    return one.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("at", "said"))).alias("turns"))


def pairs(df: DataFrame, order: Column, column: str, by: str) -> DataFrame:
    """Non-overlapping pairs (first, second) of consecutive rows; a last single row is left out."""
    w = W.partitionBy(by).orderBy(order)
    rows = df.select(by, F.row_number().over(w).alias("n"), F.col(column).alias("first"), F.lead(column).over(w).alias("second"))
    return rows.where((F.col("n") % 2 == 1) & F.col("second").isNotNull()).drop("n")


def waves(df: DataFrame, by: str, order: str, partitions: int = 1, batch: int = 16, warmup: int = 0, seed: int = 42) -> DataFrame:
    """``df`` with part, position and batch: dialogues dealt to parts by a seeded order, then by ascending turn.

    A part's first ``warmup`` turns are batches of one. Positions run over (turn, dialogue order) within a
    part; numbers come from two aggregated levels, so that no task sorts a whole part's rows.
    """
    places = ranked(df.select(by).distinct(), by, seed, "n", "size").withColumn("n", F.col("n") - 1)
    part = F.least(F.lit(partitions - 1), F.floor(F.col("n") / F.greatest(F.lit(1), F.floor(F.col("size") / partitions))))
    rows = df.join(places.select(by, part.cast("int").alias("part"), "n"), by)
    starts = rows.groupBy("part", order).count().withColumn("before", F.coalesce(F.sum("count").over(W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rows = rows.join(starts, ["part", order]).withColumn("position", F.col("before") + F.row_number().over(W.partitionBy("part", order).orderBy("n")) - 1)
    number = F.when(F.col("position") < warmup, F.col("position")).otherwise(warmup + F.floor((F.col("position") - warmup) / batch))
    return rows.withColumn("batch", number.cast("long")).drop("before", "n")


def resume(df: DataFrame, logged: DataFrame, *key: str) -> DataFrame:
    """Turns that aren't logged yet."""
    return df.join(logged.select(*key).distinct(), list(key), "left_anti")
