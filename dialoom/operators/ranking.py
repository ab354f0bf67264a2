"""A global row number in hash order that no single task computes.

Rows are ranked within the 4096 buckets of their hash's first three hexadecimal digits; a bucket's start is
the prefix sum of the bucket counts, a table of 4096 rows at most. The result equals one global sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions.text import portable_order


def ranked(df: DataFrame, key: str, seed: int = 42, number: str = "_k", total: str | None = None) -> DataFrame:
    """``df`` with the place (from 1) of each row by (hash of key and seed, key), and, if named, the count of all rows."""
    h = df.withColumn("_h", portable_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = h.groupBy("_b").agg(F.count("*").alias("_c"))
    order = W.orderBy("_b")  # 4096 rows at most
    starts = counts.select("_b", F.coalesce(F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_c").over(W.partitionBy()).alias("_t"))
    out = h.join(F.broadcast(starts), "_b").withColumn(number, F.col("_s") + F.row_number().over(W.partitionBy("_b").orderBy("_h", key)))
    if total:
        out = out.withColumn(total, F.col("_t"))
    return out.drop("_h", "_b", "_s", "_t")
