"""What the operators of this subpackage share: table access, lineage cuts, fixed patterns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes that are neither space nor one of tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a training sample in a file.
SAMPLE_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of this machine only if Spark runs in one process on it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="dialoom-")
        spark.sparkContext.setCheckpointDir(f"file://{found}")
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which ends its lineage.

    A lost executor costs a re-read of that table, never a recomputation from the source. The write's shuffle
    files go when it ends, as nothing reads them again; while it runs, lost ones are made anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/dialoom-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    except BaseException:
        delete(spark, path)
        raise
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release(*frames: DataFrame) -> None:
    """Delete tables that ``cut`` wrote, once nothing reads them any more."""
    for df in frames:
        delete(df.sparkSession, df._cut_path)


_held: dict = {}


def worker_cache(name, make):
    """What one operator keeps in this worker between tasks; what another operator kept there goes, so workers don't fill up stage by stage."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores in front until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def identified(rows: DataFrame) -> DataFrame:
    """(doc_id, text as bytes, ...) -> (doc_id, tag, text, ...); ``tag`` is 0, or the text's hash where another row has the same id.

    (doc_id, tag) tells documents apart: rows that repeat an id with another text are documents of their own,
    ordered by tag, and rows that repeat both are one. Ids that repeat are few or none as a rule; the table of
    them is written first, so Spark knows its size and broadcasts it only if it is small.
    """
    order = ["doc_id", "tag", "text", *[c for c in rows.columns if c not in ("doc_id", "text")]]
    twice = cut(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if not twice.limit(1).count():
        release(twice)
        return rows.withColumn("tag", F.lit(0).cast("long")).select(*order)
    marked = rows.join(twice.withColumn("again", F.lit(True)), "doc_id", "left")
    return marked.withColumn("tag", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")).select(*order)


def text_bytes(column: str = "text") -> Column:
    """A text as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def bucket_of(column: str, mod: int) -> Column:
    """crc32 of a column's text modulo ``mod``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], value: Column) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, bytes]]]:
    """At most ``most[k]`` labelled documents of each class k: their labels, the sizes of their values (bytes made of their text),
    and (number of the document, value) for each, in any order.

    Rows are drawn by a hash of their id: those under a share that the class counts give, so no more than
    about 1.3 times the bound leave the label table, whatever its size; they are broadcast to find their
    texts, and the first in hash order stay. Values are made in all tasks and written; the driver reads them a few files at a time.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"), F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long").alias("drawn"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    under = F.lit(False)
    for k in (0, 1):
        under = under | ((F.col("label") == k) & (F.col("drawn") < int(min(1.0, 1.3 * most[k] / max(counts.get(k, 0), 1)) * (1 << 32))))
    rows = documents.select("doc_id", "text").join(F.broadcast(known.where(under)), "doc_id")
    order = Window.partitionBy("label").orderBy("drawn", "doc_id", F.xxhash64("text"))
    chosen = rows.withColumn("place", F.row_number().over(order)).where((F.col("place") <= most[0]) & (F.col("label") == 0) | (F.col("place") <= most[1]) & (F.col("label") == 1))
    files = -(-max(1, sum(min(most[k], counts.get(k, 0)) for k in (0, 1))) // SAMPLE_ROWS)
    values = cut(chosen.select("label", "place", "text").repartition(files).select("label", "place", value.alias("value")))
    shape = values.select("label", "place", F.octet_length("value").alias("size")).toArrow().sort_by([("label", "ascending"), ("place", "ascending")])
    found, sizes = (shape[c].to_numpy().astype(np.int64) for c in ("label", "size"))
    first = (0, int((found == 0).sum()))

    def each() -> Iterator[tuple[int, bytes]]:
        for r in values.toLocalIterator():
            yield first[r.label] + r.place - 1, r.value
        release(values)

    return found, sizes, each()
