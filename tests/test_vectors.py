"""The vector index against comparing all pairs: bounds, blocks, growth, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from dialoom.operators import vectors as V

SCHEMA = "id long, v array<float>, label string"


def rows_of(n: int, seed: int, tight: bool = True) -> list[tuple]:
    g = np.random.default_rng(seed)
    centres = g.normal(size=(6, 8)) * 4
    return [(i, (centres[i % 6] + g.normal(size=8) * (0.2 if tight else 3)).astype("float32").tolist(), f"l{i % 4}") for i in range(n)]


def plain(queries, rows, k, digits=None):
    out = []
    for q, qv in queries:
        scored = [(float(np.dot(np.float64(v), np.float64(qv))), i) for i, v, *_ in rows if v is not None]
        scored = [(round(s, digits) if digits is not None else s, i) for s, i in scored]
        out += [(q, i, round(s, 6), r) for r, (s, i) in enumerate(sorted(scored, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


def found(got) -> list[tuple]:
    return sorted((r.q, r.id, round(r.score, 6), r["rank"]) for r in got.collect())


@pytest.mark.parametrize("tight", [True, False])
def test_top_k_in_blocks(spark, monkeypatch, tight):
    monkeypatch.setattr(V, "BLOCK", 17)
    monkeypatch.setattr(V, "PART", 9)
    monkeypatch.setattr(V, "HELD", 40)
    rows = rows_of(300, 1, tight) + [(900, None, "x"), (3, rows_of(300, 1, tight)[3][1], "again")]
    queries = [(i, v) for i, v, _ in rows[:40]]
    index = V.Index.fit(spark.createDataFrame(rows, SCHEMA), cells=7)
    asked = spark.createDataFrame([*queries, (77, None)], "q long, qv array<float>")
    assert found(V.top_k(asked, index, 5)) == plain(queries, rows, 5)
    whole = V.top_k(asked.limit(2), index, 1000)  # a pool smaller than k
    assert whole.count() == 2 * 301
    assert "NestedLoop" not in whole._jdf.queryExecution().executedPlan().toString()


def test_bounds_leave_cells_out():
    rows = np.array([v for _, v, _ in rows_of(600, 2)])
    centroids = V.fitted(rows, 6)
    own, away = V.nearest(rows, centroids)
    cells = np.unique(own)
    counts, radius = np.bincount(own)[cells], np.array([away[own == c].max() for c in cells])
    needed = V.reach(rows[:60] @ centroids[cells].T, np.sqrt((rows[:60] ** 2).sum(1)), counts, radius, 4, 0.0)
    best = np.argsort(-(rows[:60] @ rows.T), 1)[:, :4]
    assert all(needed[i][np.searchsorted(cells, own[j])] for i in range(60) for j in best[i]) and needed.mean() < 0.5


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [1.0 + 1e-9, 0.0], "x") for i in (9, 4, 7, 2, 5)]
    got = V.top_k(spark.createDataFrame([("q", [1.0, 5.0])], "q string, qv array<double>"), spark.createDataFrame(rows, "id long, v array<double>, label string"), 3, digits=3)
    assert [(r.id, r["rank"]) for r in got.orderBy("rank").collect()] == [(2, 1), (4, 2), (5, 3)]


def test_written_index_grows_in_its_cells(spark, tmp_path):
    rows, path = rows_of(200, 3), str(tmp_path / "index")
    frame = spark.createDataFrame(rows, SCHEMA)
    index = V.Index.fit(frame.where("id < 120"), cells=5).write(path)
    index = index.append(frame.where("id >= 120").drop("label"), path)
    queries = [(i, v) for i, v, _ in rows[:10]]
    got = V.top_k(spark.createDataFrame(queries, "q long, qv array<float>"), index, 4)
    assert found(got) == plain(queries, rows, 4) and index.rows.where("label is null").count() == 80
    assert len(index.cells()) <= 5 and sum(n for _, n, _ in index.cells()) == 200


def test_empty_index(spark):
    empty = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0])], "q long, qv array<float>")
    assert V.top_k(asked, empty, 3).count() == 0 and V.top_k(asked.limit(0), spark.createDataFrame(rows_of(9, 1), SCHEMA), 3).count() == 0


def test_waves_grow_the_index_once(spark, tmp_path):
    """Each turn's nearest row among the start and all waves before, resumed after a stop between write and append."""
    from pyspark.sql import functions as F

    from dialoom.streaming.jobs import indexed_waves

    rows = rows_of(60, 5)
    start, turns = rows[:20], [(i, (i - 20) // 10, v) for i, v, _ in rows[20:]]
    frame = spark.createDataFrame(turns, "id long, turn int, v array<float>")
    read = []

    def predict(some, index):
        read.append(index.rows.count())
        near = V.top_k(some.select(F.col("id").alias("q"), F.col("v").alias("qv")), index, 1).select(F.col("q").alias("id"), F.col("id").cast("string").alias("label"))
        return some.join(near, "id").select("id", "v", "label")

    index = V.Index.fit(spark.createDataFrame(start, SCHEMA), cells=3)
    path = str(tmp_path / "run")
    half = indexed_waves(frame.where("turn < 2"), index, predict, path)
    assert half.count() == 20 and read == [20, 30]
    want, pool = {}, list(start)
    for wave in range(4):
        own = [(i, v) for i, t, v in turns if t == wave]
        want |= {q: str(i) for q, i, *_ in plain(own, pool, 1)}
        pool += [(i, v, "") for i, v in own]
    # a wave that was written but not appended
    predict(frame.where("turn = 2"), V.Index.read(spark, f"{path}/index")).write.parquet(f"{path}/waves/wave=2")
    got = indexed_waves(frame, index, predict, path)
    assert {r.id: r.label for r in got.collect()} == want and read == [20, 30, 40, 50]
    grown = V.Index.read(spark, f"{path}/index")
    assert grown.rows.count() == 60 == grown.rows.select("id").distinct().count()


def test_jobs_on_the_skip_list_stay_out(spark, tmp_path):
    from dialoom.streaming.jobs import JOB, drain, enqueue

    jobs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], JOB)
    assert enqueue(jobs, str(tmp_path / "q"), spark.createDataFrame([("b",), ("b",)], "job_id string")) == 2
    seen = []
    drain(spark, str(tmp_path / "q"), str(tmp_path / "c"), lambda df, _: seen.extend(r.job_id for r in df.collect()))
    assert sorted(seen) == ["a", "c"]


def test_vectors_move_once_a_block(spark):
    """Small cells share a block, larger ones are split, and a query is dealt once to each block."""
    assert V.tiled([(0, 5, 0.0), (1, V.BLOCK, 0.0), (2, 3, 0.0), (3, 2, 0.0), (5, 2 * V.BLOCK + 1, 0.0), (6, 1, 0.0)]) == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (6, 1)]
    rows = spark.createDataFrame(rows_of(200, 3), SCHEMA)
    index = V.Index.fit(rows, cells=8)
    cells = index.cells()
    asked = rows.selectExpr("id as q", "v as qv", "0 as part").where("qv is not null")
    dealt = asked.mapInArrow(V._asked(index.centroids, cells, V.tiled(cells), 5, 0.0), "q long, qv array<float>, part int, block int")
    assert len(cells) > 1 and dealt.count() == asked.count()
