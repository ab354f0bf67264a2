"""Exact top-k search by inner product with norm buckets.

Vectors are grouped by length, longest first, and each group is cut into blocks. Queries, in blocks of
their own, meet the groups in waves, the longest first: the k-th best product so far is a query's threshold.
A query needs a cosine of threshold / (its length * a block's largest length) in a further block. Where that
is above 1 for all queries of a block of queries, the pair of blocks is left out before any vector moves
(length pruning; inside a block it keeps the vectors that are long enough). Where it is high, products over
the query's heaviest coordinates plus the Cauchy-Schwarz bound of the rest drop vectors first (coordinate
pruning); what is left is multiplied in full, in exact integers. Queries that need the same cosine or so
share a block, so that a pair of blocks is kept for few queries' sake.

The query set is stated, so all of it meets all rows that may count, block by block; each pair of blocks is
one row of an equi-join on block numbers, and comes back as at most k rows a query. Numbers are made of the
group and a hash, so no task orders the blocks.

Components become floor(256 * x). Defined cases: null vectors and those with null or non-finite components
take no part; vectors of different sizes are compared as if padded with zeros; a query isn't its own
candidate (by id); rows that repeat an id count as one, with the least of their vectors; ties go to the
smaller id; fewer than k candidates give fewer rows; an empty table gives an empty result; components of
2**54 and more, or products that 64 bits can't hold, end the query with an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.llm.common import cut, release

BLOCK, QUERY_BLOCK, K = 4096, 1024, 5
#: Quantiles of the lengths that bound the groups; the groups of each wave but the last.
GROUPS = 8
WAVES = ((0,), (1, 2))
NO_LEAST = -1e300
#: From this needed cosine on, coordinates are pruned; so many of the heaviest are tried.
COSINE, HEAVY = 0.5, 16


def _matrix(vectors) -> np.ndarray:
    rows = [np.asarray(v, np.float64) for v in vectors]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _match(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """(query ids, queries, thresholds, ids, vectors) of pairs of blocks -> each query's best k of the block that may still count."""
    for frame in frames:
        for q_ids, queries, least, ids, vectors in zip(frame["q_ids"], frame["queries"], frame["least"], frame["ids"], frame["vectors"]):
            q_ids, ids, least = np.asarray(q_ids), np.asarray(ids), np.asarray(least, np.float64)
            q, x = _matrix(queries), _matrix(vectors)
            width = max(q.shape[1], x.shape[1])
            q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
            q_len, x_len = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
            by = np.argsort(-x_len, kind="stable")
            x, x_len, ids = x[by], x_len[by], ids[by]
            top = x_len[0] if len(x_len) else 0.0
            reached = width * np.abs(q).max(initial=0) * np.abs(x).max(initial=0)
            if reached >= 2**62:
                raise OverflowError("inner products of these vectors don't fit 64 bits")
            exact = reached < 2**53
            out = []
            for i in range(len(q_ids)):
                reach = q_len[i] * top
                slack = 1e-9 * (reach + 1)
                if not len(x) or reach + slack < least[i]:
                    continue
                stop = len(x)
                if least[i] > 0 and q_len[i] > 0:
                    stop = int(np.searchsorted(-x_len, -(least[i] - slack) / q_len[i], "right"))
                at = np.arange(stop)
                if reach > 0 and least[i] / reach >= COSINE and stop > 64 and width > HEAVY:
                    heavy = np.argpartition(-np.abs(q[i]), HEAVY)[:HEAVY]
                    part = x[:stop, heavy]
                    rest = np.sqrt(np.maximum(x_len[:stop] ** 2 - (part * part).sum(1), 0)) * np.sqrt(max(q_len[i] ** 2 - (q[i, heavy] ** 2).sum(), 0))
                    at = at[part @ q[i, heavy] + rest + slack >= least[i]]
                if exact:
                    score = (x[at] @ q[i]).astype(np.int64)
                else:
                    score = x[at].astype(np.int64) @ q[i].astype(np.int64)
                good = (ids[at] != q_ids[i]) & (score >= least[i])
                at, score = at[good], score[good]
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[at[best]], "score": score[best]}))
            if out:
                yield pd.concat(out)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _once(rows: DataFrame) -> DataFrame:
    """(vec_id, asks, v) with one row for each id: the least vector's. Ids that repeat are few or none as a rule."""
    twice = cut(rows.groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1").select("vec_id"))
    if not twice.limit(1).count():
        release(twice)
        return rows
    some = rows.join(twice, "vec_id").groupBy("vec_id").agg(F.min_by("asks", "v").alias("asks"), F.min("v").alias("v"))
    return rows.join(twice, "vec_id", "left_anti").unionByName(some)


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the ``k`` largest integer products of each query."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double")) < 2.0**54)
    rows = rows.where(F.assert_true(small, "a vector has a component of 2**54 or more").isNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")).alias("v"))
    rows = cut(_once(rows).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))))
    bounds = rows.approxQuantile("length", [i / GROUPS for i in range(1, GROUPS)], 0.01)  # GROUPS - 1 numbers
    group = F.lit(GROUPS - 1) - sum((F.col("length") >= b).cast("int") for b in bounds) if bounds else F.lit(0)
    dealt = rows.withColumn("group", group)
    sizes = dealt.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))  # GROUPS rows
    dealt = dealt.join(F.broadcast(sizes), "group").withColumn("block", F.col("group") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    blocks = dealt.groupBy("group", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("r"), F.max("length").alias("top"))
    blocks = cut(blocks.select("block", "group", "top", F.col("r.vec_id").alias("ids"), F.col("r.v").alias("vectors")))
    found = rows.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    present = sorted(r.group for r in sizes.collect())  # GROUPS numbers
    if not present:
        return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    queries = rows.where("asks").select("vec_id", "v", "length")
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    waves = [w for w in WAVES if set(w) & set(present)]
    waves.append(tuple(set(present).difference(*waves)))
    for wave in filter(None, waves):
        least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))
        asked = queries.join(least, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "length", F.coalesce("least", F.lit(NO_LEAST)).alias("least"))
        # the length from which on a vector may count
        asked = asked.withColumn("from", F.when(F.col("least") <= 0, 0.0).when(F.col("length") > 0, F.col("least") / F.col("length")).otherwise(F.lit(float("inf"))))
        edges = asked.approxQuantile("from", [i / parts for i in range(1, parts)], 0.01) if 1 < parts <= 1024 else []  # at most 1024 numbers
        by_need = F.pmod(F.xxhash64("vec_id"), F.lit(parts)) if not edges else sum((F.col("from") >= e).cast("int") for e in sorted(set(edges))) * F.lit(1 << 20) + F.pmod(F.xxhash64("vec_id"), F.lit(max(1, parts // (len(set(edges)) + 1))))
        asked = asked.withColumn("q", by_need.cast("long")).groupBy("q").agg(F.collect_list(F.struct("vec_id", "v", "least")).alias("r"), F.min("from").alias("from"))
        asked = cut(asked.select("q", "from", F.col("r.vec_id").alias("q_ids"), F.col("r.v").alias("queries"), F.col("r.least").alias("least")))
        numbers = asked.select("q", "from", F.explode(F.array(*[F.lit(g) for g in wave])).alias("group"))
        pairs = numbers.join(blocks.select("group", "block", "top"), "group").where(F.col("top") * (1 + 1e-9) >= F.col("from")).select("q", "block")
        met = pairs.join(asked.drop("from"), "q").join(blocks.select("block", "ids", "vectors"), "block").select("q_ids", "queries", "least", "ids", "vectors")
        got = met.mapInPandas(lambda it: _match(it, k), "query_id long, vec_id long, score long")
        found = cut(_best(found.select("query_id", "vec_id", "score").unionByName(got), k))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from pairs
) where rank <= {K}
"""
