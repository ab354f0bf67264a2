"""An index of vectors in cells around centroids, and exact top-k products with it, in blocks.

Centroids are fitted on a bounded sample; every row goes to the cell of the nearest one and keeps its distance
from it, so rows can be appended at any time. A vector at distance r from the centroid c has a product with q between
q.c - |q|r and q.c + |q|r: cells whose best can't reach what k rows of other cells have for certain are left out before
any vector moves. What is left is multiplied block by block (numpy, in Arrow batches); each block hands on its k
best rows for a query, and a window ranks those.

Rows with a null vector take no part. Ties go to the smaller id. Neighbouring cells share blocks of about ``BLOCK`` rows,
a larger cell is split into several, and queries go in parts of ``PART``: a task holds two bounded matrices, and a vector
moves once for a block or part, not for a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

BLOCK, PART = 32_768, 32_768
#: Rows that centroids are fitted on, rows per cell wanted, cells at most, and rounds of fitting.
SAMPLE, CELL_ROWS, CELLS, ROUNDS = 20_000, 1_000, 256, 8
#: Numbers in a product of blocks that are held at once.
HELD = 4_000_000


def matrix(column) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows spread over the sample; cells that lose their rows keep their place."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        own = nearest(sample, centroids)[0]
        for c in range(cells):
            if (own == c).any():
                centroids[c] = sample[own == c].mean(0)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cell and its distance from the centroid."""
    square = (centroids**2).sum(1) - 2 * rows @ centroids.T
    own = square.argmin(1)
    return own, np.sqrt(((rows - centroids[own]) ** 2).sum(1))


@dataclass
class Index:
    """``rows`` (id, v, ..., cell, away) around ``centroids``."""

    rows: DataFrame
    centroids: np.ndarray

    @classmethod
    def fit(cls, rows: DataFrame, cells: int | None = None) -> Index:
        """Of (id, v, ...). The sample is the ``SAMPLE`` rows of the smallest hashes of their ids."""
        known = rows.where(F.col("v").isNotNull())
        n = known.count()
        share = min(1.0, 1.3 * SAMPLE / max(n, 1))
        drawn = known.select("v", F.xxhash64("id").alias("h")).where(F.col("h") < F.lit(int((2 * share - 1) * (2**63 - 1)))) if share < 1 else known.select("v", F.xxhash64("id").alias("h"))
        sample = matrix(drawn.orderBy("h", "v").limit(SAMPLE).toArrow()["v"])
        wanted = min(cells or max(1, min(CELLS, n // CELL_ROWS)), max(1, len(sample)))
        centroids = fitted(sample, wanted) if len(sample) else np.zeros((1, 1))
        return cls(placed(known, centroids), centroids)

    def grown(self, more: DataFrame) -> Index:
        """With more rows in the cells that there are; repeats stay, missing columns are null."""
        return Index(self.rows.unionByName(placed(more.where(F.col("v").isNotNull()), self.centroids), allowMissingColumns=True), self.centroids)

    def write(self, path: str, mode: str = "overwrite") -> Index:
        """As a table with a partition for each cell, centroids beside it; ``append`` adds these rows to the partitions."""
        spark = self.rows.sparkSession
        self.rows.write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")
        if mode != "append":
            spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(self.centroids)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        return Index.read(spark, path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        centres = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()["centre"]
        return cls(spark.read.parquet(f"{path}/rows"), matrix(centres))

    def append(self, more: DataFrame, path: str) -> Index:
        """``more`` into a written index, without reading what it holds."""
        return Index(placed(more.where(F.col("v").isNotNull()), self.centroids), self.centroids).write(path, "append")

    def cells(self) -> list[tuple[int, int, float]]:
        """(cell, rows, the farthest row's distance): a row for each cell, at most as many as centroids."""
        return [(r.cell, r.n, r.radius) for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).orderBy("cell").collect()]


def placed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds (cell, away)."""
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("away", DoubleType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, away = nearest(matrix(batch["v"]), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(away, pa.float64())], names=[*batch.schema.names, "cell", "away"])

    return rows.mapInArrow(of, schema)


def reach(products: np.ndarray, norms: np.ndarray, counts: np.ndarray, radius: np.ndarray, k: int, margin: float) -> np.ndarray:
    """Which cells (columns) can hold one of a query's (rows) k best, by the products with their centroids."""
    away = norms[:, None] * radius[None, :]
    slack = 1e-9 * (1 + np.abs(products) + away)
    least, most = products - away - slack, products + away + slack
    order = np.argsort(-least, 1)
    held = np.cumsum(counts[order], 1)
    at = np.minimum((held < k).sum(1), counts.size - 1)
    sure = np.where(held[:, -1] >= k, np.take_along_axis(least, order, 1)[np.arange(len(at)), at], -np.inf)
    return most >= sure[:, None] - margin


def tiled(cells: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """(first block, blocks) of each cell: a cell over ``BLOCK`` rows has blocks of its own, smaller ones fill blocks together."""
    out, at, room = [], 0, 0
    for _, n, _ in cells:
        if n > BLOCK:
            at += 1 if room else 0
            own = -(-n // BLOCK)
            out.append((at, own))
            at, room = at + own, 0
            continue
        if room and n > BLOCK - room:
            at, room = at + 1, 0
        out.append((at, 1))
        room += n
    return out


def _asked(centroids: np.ndarray, cells: list[tuple[int, int, float]], tiles: list[tuple[int, int]], k: int, margin: float):
    """(q, qv, part) -> a row for each block that may hold one of its k best."""
    own = np.array([c for c, _, _ in cells])
    counts, radius = np.array([n for _, n, _ in cells]), np.array([r for *_, r in cells])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = matrix(batch["qv"])
            held = reach(asked @ centroids[own].T, np.sqrt((asked**2).sum(1)), counts, radius, k, margin)
            block = np.zeros((len(asked), max(a + n for a, n in tiles)), bool)
            for c, (a, n) in enumerate(tiles):
                block[:, a : a + n] |= held[:, c : c + 1]
            rows, block = np.nonzero(block)
            for lo in range(0, len(rows), 20_000):
                taken = batch.take(pa.array(rows[lo : lo + 20_000]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block[lo : lo + 20_000], pa.int32())], names=[*batch.schema.names, "block"])

    return of


def _best(k: int, digits: int | None, columns: list[str]):
    """A block's queries and rows -> (q, columns, score) of the k best rows of each query."""

    def of(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, v = matrix(asked["qv"]), matrix(rows["v"])
        where, hit, score = [], [], []
        if len(q) and len(v):
            by_id = np.empty(len(v), np.int64)  # places in the order of ids
            by_id[np.argsort(np.array(rows["id"].to_pylist(), object), kind="stable")] = np.arange(len(v))
            for lo in range(0, len(q), step := max(1, HELD // len(v))):
                products = q[lo : lo + step] @ v.T
                products = np.round(products, digits) if digits is not None else products
                most = min(k, len(v))
                edge = -np.partition(-products, most - 1, 1)[:, most - 1 : most]
                r, c = np.nonzero(products >= edge)
                order = np.lexsort((by_id[c], -products[r, c], r))
                r, c = r[order], c[order]
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                r, c = r[nth < most], c[nth < most]
                where.append(r + lo), hit.append(c), score.append(products[r, c])
        where, hit, score = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, hit, score))
        taken = rows.select(columns).take(pa.array(hit, pa.int64()))
        return pa.table([asked["q"].take(pa.array(where, pa.int64())), *taken.columns, pa.array(score, pa.float64())], names=["q", *columns, "score"])

    return of


def top_k(queries: DataFrame, index: DataFrame | Index, k: int, digits: int | None = None) -> DataFrame:
    """(q, qv) and an index of (id, v, ...) -> q, id, ..., score, rank: the k largest products, ties to the smaller id; the whole pool if it is smaller.

    With ``digits``, products are rounded before they are compared.
    """
    index = index if isinstance(index, Index) else Index.fit(index)
    columns = [c for c in index.rows.columns if c not in ("v", "cell", "away")]
    schema = StructType([StructField("q", queries.schema["q"].dataType), *[index.rows.schema[c] for c in columns], StructField("score", DoubleType())])
    asked = queries.select("q", "qv").where(F.col("qv").isNotNull())
    cells = index.cells()
    if not cells:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    parts = max(1, -(-asked.count() // PART))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int"))
    dealt_schema = StructType([*asked.schema.fields, StructField("block", IntegerType())])
    margin, tiles = 0.0 if digits is None else 10.0**-digits, tiled(cells)
    dealt = asked.mapInArrow(_asked(index.centroids, cells, tiles, k, margin), dealt_schema)
    first, count = (F.create_map(*[F.lit(x) for (c, *_), t in zip(cells, tiles) for x in (c, t[i])])[F.col("cell")] for i in (0, 1))
    rows = index.rows.drop("away").withColumn("block", (first + F.pmod(F.xxhash64("id"), count)).cast("int")).drop("cell")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["block", "part"]
    best = dealt.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_best(k, digits, columns), schema)
    order = W.partitionBy("q").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
