"""Retrieval: exact vector top-k (by ``vectors``), its distinct-key form, prompt injection, index growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.operators.vectors import Index, top_k


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """To unit length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is set, to unit length."""
    weighed = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    total = F.aggregate(weighed, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return normalised(F.transform(total, lambda x: x / count))


def distinct_top_k(queries: DataFrame, index: DataFrame | Index, k: int, key: str, distinct: int | None = None, overfetch: int = 0, digits: int | None = None) -> DataFrame:
    """Top-k that first takes the best row of each of ``distinct`` unseen keys, then fills up in rank order.

    Only the ``max(overfetch, k)`` best rows are considered; fewer rows give a shorter answer.
    """
    got = top_k(queries, index, max(overfetch, k), digits)
    fresh = F.row_number().over(W.partitionBy("q", key).orderBy("rank")) == 1
    got = got.withColumn("fresh", fresh).withColumn("nth", F.sum(F.col("fresh").cast("int")).over(W.partitionBy("q").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    got = got.withColumn("pick", F.col("fresh") & (F.col("nth") <= (distinct or k)))
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("pick"), "rank"))
    return got.withColumn("place", place).where(F.col("place") <= k).drop("fresh", "nth")


def inject(prompt: Column, documents: Column, marker: str = "# Example 1") -> Column:
    """Retrieved documents before the first example of a prompt."""
    text = F.array_join(F.transform(documents, lambda d: F.concat(F.lit('"""'), d, F.lit('"""\n'))), "")
    return F.replace(prompt, F.lit(marker), F.concat(text, F.lit(marker)))


def warm(index: DataFrame, fixed: DataFrame, warmup: int) -> DataFrame:
    """The fixed examples while the index holds fewer than ``warmup`` rows, once; else the index."""
    return fixed if index.limit(warmup).count() < warmup else index


def grown(index: DataFrame, more: DataFrame) -> DataFrame:
    """The index with new rows; repeats stay, missing columns are null."""
    return index.unionByName(more, allowMissingColumns=True)
