"""Scans: named splits, optional paths, JSON and text files, resources, run logs, manifest groups."""

from __future__ import annotations

import json
import tempfile
import uuid
from importlib import resources

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialoom.functions import fixed

#: Spark's setting that removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def split(spark: SparkSession, dataset: str, name: str | None) -> DataFrame | None:
    """A split of a dataset written with partitions ``split=<name>`` (only its files are read); None if unset."""
    return None if name is None else spark.read.parquet(dataset).where(F.col("split") == name)


def optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def json_file(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    rows = spark.read.text(path)
    return rows.select(F.trim("value").alias("value")) if strip else rows


def dialogue_files(spark: SparkSession, folder: str, acts: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Dialogues of ``folder``/<fold>/dialogues_*.json (each file an array) with their fold, and the count by fold.

    ``acts`` names a JSON lines table (dialogue_id, turn_id, acts) to join as an array by turn number; dialogues
    without any have null.
    """
    files = spark.read.option("multiLine", True).json(f"{folder}/*/dialogues_*.json", pathGlobFilter="dialogues_*.json")
    rows = files.withColumn("fold", F.element_at(F.split(F.input_file_name(), "/"), -2))
    if acts is not None:
        own = spark.read.json(acts).groupBy("dialogue_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "acts"))).alias("acts"))
        rows = rows.join(own, "dialogue_id", "left")
    return rows, {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}  # a few folds


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema else reader).json(path)


def artifact(spark: SparkSession, root: str, name: str, file: str, prefix: str = "") -> DataFrame:
    """A JSON file of the artifact ``name``; where that isn't there, of the one under ``prefix`` + ``name``."""
    try:
        return json_file(spark, f"{root}/{name}/{file}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or not prefix:
            raise
        return json_file(spark, f"{root}/{prefix}{name}/{file}")


def all_to_folder(spark: SparkSession, artifacts: DataFrame, run_id: str, folder: str) -> int:
    """Copy all artifact folders (name, run_id, path) of a run into ``folder``, by name; how many there were."""
    rows = artifacts.where(F.col("run_id") == run_id).select("name", "path").collect()  # one row an artifact of one run
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in rows:
        a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (r.path, f"{folder}/{r.name}"))
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)
    return len(rows)


def strict(kind: type, values: dict):
    """An instance of a dataclass from a configuration: unknown names and missing ones are errors, nested dataclasses are made too."""
    import dataclasses
    import typing

    fields, hints = {f.name: f for f in dataclasses.fields(kind)}, typing.get_type_hints(kind)
    unknown = sorted(set(values) - set(fields))
    missing = sorted(n for n, f in fields.items() if n not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
    if unknown or missing:
        raise ValueError(f"{kind.__name__}: unknown {unknown}, missing {missing}")
    return kind(**{k: strict(hints[k], v) if isinstance(v, dict) and dataclasses.is_dataclass(hints[k]) else v for k, v in values.items()})


def resource(package: str, name: str):
    """A JSON file that ships with a package (small, on the driver)."""
    return json.loads(resources.files(package).joinpath(name).read_text())


def state_type(slots: list[tuple[str, str]]) -> T.StructType:
    """The nested struct of a schema's (service, slot) pairs."""
    services: dict[str, list[str]] = {}
    for service, slot in slots:
        services.setdefault(service, []).append(slot)
    return T.StructType([T.StructField(s, T.StructType([T.StructField(k, T.StringType()) for k in ks])) for s, ks in services.items()])


def turn_type(slots: list[tuple[str, str]]) -> T.StructType:
    """The stored schema of a dialogue turn."""
    texts, state = T.ArrayType(T.StringType()), state_type(slots)
    return T.StructType([
        T.StructField("dialogue_id", T.StringType()), T.StructField("turn_id", T.ByteType()), T.StructField("domains", texts),
        T.StructField("user_utterances", texts), T.StructField("system_utterances", texts), T.StructField("slot_values", state),
        T.StructField("turn_slot_values", state), T.StructField("last_slot_values", state), T.StructField("last_system_response_acts", texts),
        T.StructField("system_response_acts", texts), T.StructField("system_response", T.StringType()),
    ])


def unflattened(ontology: DataFrame) -> DataFrame:
    """(name "service-slot", values) -> (service, slots: map of slot to values)."""
    parts = F.split("name", "-", 2)
    rows = ontology.select(F.trim(parts[0]).alias("service"), F.struct(F.trim(parts[1]).alias("slot"), F.col("values").alias("values")).alias("x"))
    return rows.groupBy("service").agg(F.map_from_entries(F.array_sort(F.collect_list("x"))).alias("slots"))


def dialogue_key(column: str):
    """Dialogue ids as the evaluation tables write them: lower case, without ``.json``."""
    return F.regexp_replace(F.lower(column), r"\.json$", "")


def evaluation_input(turns: DataFrame, goals: DataFrame, booked: DataFrame) -> DataFrame:
    """Turns with their dialogue's goal and the turn's booked domains; turns without a goal are left out."""
    t = turns.withColumn("_k", dialogue_key("dialogue_id"))
    g = goals.select(dialogue_key("dialogue_id").alias("_k"), "goal")
    b = booked.select(dialogue_key("dialogue_id").alias("_k"), F.posexplode("booked").alias("turn_id", "booked"))
    return t.join(g, "_k").join(b, ["_k", "turn_id"]).drop("_k")


def runs(log: DataFrame, tags_in=("complete_run",), tags_not_in=("outdated",)) -> DataFrame:
    """Runs that carry one of the wanted tags and none of the others."""
    return log.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags_in))) & ~F.arrays_overlap("tags", F.array(*map(F.lit, tags_not_in))))


def run_artifact(artifacts: DataFrame, run_id: str, step: str) -> DataFrame:
    """The first artifact of a run that is a run's output or running log and whose name ends with the step."""
    own = artifacts.where((F.col("run_id") == run_id) & F.col("type").isin("run_output", "running_log") & F.col("name").endswith(step))
    return own.orderBy("position").limit(1)


def evaluated(schema: DataFrame) -> DataFrame:
    return schema.where(F.col("service_name").isin(*fixed.EVALUATED_SERVICES))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt to four tasks a core: for costly steps on tables of few files, which Spark reads in few tasks whatever their rows cost."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share: the session's; without one, a local session gets a temporary one, and any other is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="dialoom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder that all executors share, so that what is built on it neither plans nor computes it again."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the folder that all executors share. The shuffle files of making it go when it is made; the table goes with ``dropped``."""
    spark = df.sparkSession
    path, before = f"{_shared(spark)}/written-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
