"""Streaming forms: a job queue, carried dialogue state, and an index that grows with what it predicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dialoom.operators.vectors import Index

JOB = "job_id string, config string"


def enqueue(jobs: DataFrame, folder: str, skip: DataFrame | None = None) -> int:
    """Jobs as JSON files of a source folder, but for those whose job_id ``skip`` lists; how many there are."""
    rows = jobs if skip is None else jobs.join(skip.select("job_id").distinct(), "job_id", "left_anti").select(*jobs.columns)
    rows.write.mode("append").json(folder)
    return rows.count()


def drain(spark: SparkSession, folder: str, checkpoint: str, run: Callable[[DataFrame, int], None]) -> None:
    """Hand all waiting jobs to ``run`` and stop when there are none.

    A job is marked done after ``run`` returns (at least once), so ``run`` must be idempotent by job_id.
    """
    stream = spark.readStream.schema(JOB).json(folder)
    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, turns = state.get if state.exists else (None, 0)
    frame = pd.concat(list(frames)).sort_values("turn")
    out = []
    for turn, text in zip(frame["turn"], frame["text"]):
        out.append((key[0], turn, last, turns))
        last, turns = text, turns + 1
    state.update((last, turns))
    yield pd.DataFrame(out, columns=["conv_id", "turn", "previous", "position"])


def carried(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, text) stream -> (conv_id, turn, previous text, position), state kept by conversation."""
    return turns.groupBy("conv_id").applyInPandasWithState(_carry, "conv_id long, turn long, previous string, position long", "previous string, turns long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by tumbling window and type; events later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def replay(logged: DataFrame, recorders: list[Callable[[DataFrame], None]]) -> int:
    """Hand all logged turns to each recorder, as if they had just been predicted; how many there are.

    Recorders are frame-to-nothing functions (metrics, an index, a viewer); resuming calls this before new turns.
    """
    for record in recorders:
        record(logged)
    return logged.count()


def resumed(turns: DataFrame, logged: DataFrame | None, recorders: list[Callable[[DataFrame], None]], *key: str) -> DataFrame:
    """The turns still to do, once those logged are replayed into the recorders."""
    from dialoom.operators.turns import resume

    if logged is None:
        return turns
    replay(logged, recorders)
    return resume(turns, logged, *key)


def waves(turns: DataFrame, index: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame], path: str, order: str = "turn") -> DataFrame:
    """Turn by turn: predictions of a wave, written to ``path``, are examples of the next; waves found there are skipped.

    A wave is one write of its own partition, which replaces what a failed attempt may have left there.
    """
    from dialoom.sources.tables import optional

    spark = turns.sparkSession
    before = optional(spark, path)
    have = set() if before is None else {r[0] for r in before.select("wave").distinct().collect()}  # turn numbers of a dialogue
    for t in [r[0] for r in turns.select(order).distinct().orderBy(order).collect()]:
        if t in have:
            continue
        done = optional(spark, path)
        grown = index if done is None else index.unionByName(done.drop("wave"), allowMissingColumns=True)
        predict(turns.where(F.col(order) == t), grown).withColumn("wave", F.lit(t)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("wave").parquet(path)
    return spark.read.parquet(path)


def indexed_waves(turns: DataFrame, index: Index, predict: Callable[[DataFrame, Index], DataFrame], path: str, order: str = "turn") -> DataFrame:
    """As ``waves``, with a vector index that grows in its cells: a wave reads its predictions once, right after they are written.

    ``index`` is a written one's start; predictions are rows as it has (id, v, ...). Its folder is ``path``/index, that of the
    predictions ``path``/waves. Rows remember their wave, so a run that stopped between a wave's write and
    its append goes on there: what the index lacks is appended first, and nothing twice.
    """
    from dialoom.sources.tables import optional

    spark = turns.sparkSession
    place, out = f"{path}/index", f"{path}/waves"
    grown = Index.read(spark, place) if optional(spark, f"{place}/rows") is not None else Index(index.rows.withColumn("wave", F.lit(None).cast("int")), index.centroids).write(place)
    before = optional(spark, out)
    done = set() if before is None else {r[0] for r in before.select("wave").distinct().collect()}  # turn numbers of a dialogue
    held = {r[0] for r in grown.rows.select("wave").distinct().collect()}
    for t in [r[0] for r in turns.select(order).distinct().orderBy(order).collect()]:
        own = f"{out}/wave={t}"
        if t not in done:
            predict(turns.where(F.col(order) == t), grown).write.mode("overwrite").parquet(own)
        if t not in held:
            grown = grown.append(spark.read.parquet(own).withColumn("wave", F.lit(t).cast("int")), place)
    return spark.read.parquet(out)
