"""Run manifests and sinks: a table of (group_id, run_id, num_logs, dataset, split), partitioned by group.

One writer at a time; every change writes the groups that it touches, and readers prune to their group.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.text import short_hash
from dialoom.sources.tables import optional

SCHEMA = "group_id string, run_id string, num_logs long, labelled_dataset_path_or_name string, labelled_dataset_split_name string"


def check(entries: DataFrame) -> DataFrame:
    """Entries must name group, run, dataset and split, and count logs; otherwise the job fails when they are read."""
    blank = [F.trim(F.coalesce(F.col(c), F.lit(""))) == "" for c in entries.columns if c != "num_logs"]
    bad = F.coalesce(F.col("num_logs") <= 0, F.lit(True))
    for b in blank:
        bad = bad | b
    return entries.where(F.assert_true(~bad, "a manifest entry is blank or has no logs").isNull())


def group(spark: SparkSession, path: str, group_id: str) -> DataFrame:
    """A group's entries; an unknown group has none."""
    table = optional(spark, path)
    return spark.createDataFrame([], SCHEMA) if table is None else table.where(F.col("group_id") == group_id).select(*[x.split()[0] for x in SCHEMA.split(", ")])


def _rewrite(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Replace the groups that ``rows`` holds, by way of a written copy, as they are read from the same table.

    The copy goes once the groups are replaced; if that fails, it stays and the error names it.
    """
    aside = f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    kept = spark.read.schema(rows.schema).parquet(aside)
    try:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group_id").parquet(path)
    except Exception as e:
        e.add_note(f"the groups' rows are kept in {aside}")
        raise
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(aside)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def added(present: DataFrame, entries: DataFrame, overwrite: bool = False) -> DataFrame:
    """What the table holds afterwards: entries whose (group, run) is present are skipped, or replace it."""
    key = ["group_id", "run_id"]
    if overwrite:
        return present.join(entries, key, "left_anti").unionByName(entries)
    return present.unionByName(entries.join(present, key, "left_anti").select(*present.columns))


def add(spark: SparkSession, path: str, entries: DataFrame, overwrite: bool = False) -> None:
    entries, present = check(entries), optional(spark, path)
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    present = spark.createDataFrame([], SCHEMA) if present is None else present.select(*columns)
    touched = present.join(entries.select("group_id").distinct(), "group_id", "left_semi").select(*columns)
    _rewrite(spark, path, added(touched, entries.select(*columns), overwrite))


def remove(spark: SparkSession, path: str, group_id: str, run_id: str) -> None:
    """Take one entry out; the group's last entry takes its partition along."""
    left = group(spark, path, group_id).where(F.col("run_id") != run_id)
    if left.limit(1).count():
        _rewrite(spark, path, left)
    else:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/group_id={group_id}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def logs(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """All logs of a group's runs (one folder a run, reused between calls); each run must hold as many as its entry says."""
    entries = manifest.select("run_id", "num_logs").collect()  # one row a run
    if not entries:
        raise ValueError("the group has no runs")
    found = spark.read.option("mergeSchema", True).parquet(*[f"{root}/{e.run_id}" for e in entries])
    counts = {r.run_id: r["count"] for r in found.groupBy("run_id").count().collect()}
    wrong = {e.run_id: (counts.get(e.run_id, 0), e.num_logs) for e in entries if counts.get(e.run_id, 0) != e.num_logs}
    if wrong:
        raise ValueError(f"runs with another count of logs than their entry's: {wrong}")
    return found


def publish(labelled: DataFrame, path: str, split: str) -> None:
    """Write (or replace) one split of a dataset; the others stay."""
    labelled.withColumn("split", F.lit(split)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def dataset_name(group_id: str, labelled: DataFrame) -> str:
    """group, count of dialogues, and a short hash of the sorted dialogue ids' digest."""
    got = labelled.select("dialogue_id").distinct().agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64("dialogue_id"))).alias("x"))
    row = got.select("n", short_hash(F.concat_ws(":", F.lit(group_id), "n", "x")).alias("h")).first()
    return f"{group_id}_{row.n}_{row.h}"


def card(name: str, facts: dict[str, str]) -> str:
    """A dataset's description."""
    return "\n".join([f"# {name}", "", *[f"- {k}: {v}" for k, v in sorted(facts.items())], ""])


def publish_group(spark: SparkSession, path: str, group_id: str, root: str, out: str, split: str = "train", label=None) -> tuple[str, str]:
    """A group's logs, checked against its entries, labelled by ``label`` (a frame-to-frame function) and written as a split of a
    dataset under ``out``; its name and card. Publishing again replaces the split."""
    found = logs(spark, group(spark, path, group_id), root)
    labelled = label(found) if label else found
    name = dataset_name(group_id, labelled)
    publish(labelled, f"{out}/{name}", split)
    return name, card(name, {"group": group_id, "split": split, "runs": str(found.select("run_id").distinct().count()), "logs": str(labelled.count())})


def publish_mixture(parts: dict[str, tuple[DataFrame, float]], key: str, out: str, name: str, held: int = 0, group_key: str | None = None, seed: int = 42) -> dict[str, int]:
    """A training mixture (mode -> rows and share) as splits of the dataset ``name``; with ``held``, so many groups of ``group_key`` go to validation."""
    from dialoom.operators import sampling

    rows = sampling.mixture(parts, key, seed)
    rows = sampling.split(rows, group_key, held, seed) if held and group_key else rows.withColumn("split", F.lit("train"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(f"{out}/{name}")
    return {r.split: r["count"] for r in rows.sparkSession.read.parquet(f"{out}/{name}").groupBy("split").count().collect()}  # two splits


def checkpoint_logs(wave: DataFrame, path: str, run_id: str, turn: int) -> None:
    """Append a wave's logs; a wave that is written again replaces itself."""
    out = wave.withColumn("run_id", F.lit(run_id)).withColumn("wave", F.lit(turn))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "wave").parquet(path)


def text_log(rows: DataFrame, task: str, path: str) -> None:
    """One line ``task - dialogue_id - turn_id - message`` a turn."""
    rows.select(F.format_string(f"{task} - %s - %s - %s", F.col("dialogue_id"), F.col("turn_id").cast("string"), F.col("message")).alias("value")).write.mode("append").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


class StepLogger:
    """Merges metrics until ``step``, which hands them to ``sink`` and starts anew."""

    def __init__(self, sink):
        self.sink, self.pending, self.steps = sink, {}, 0

    def log(self, metrics: dict) -> None:
        self.pending |= metrics

    def step(self) -> None:
        self.sink(self.steps, self.pending)
        self.pending, self.steps = {}, self.steps + 1
