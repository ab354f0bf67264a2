"""Queries of manifests and run logs: users are groups, their event types runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.sources import manifest as M
from dialoom.sources import tables as S


def _entries(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy((F.col("user_id") % 10).cast("string").alias("group_id"), F.col("event_type").alias("run_id")).agg(
        F.count("*").alias("num_logs"), F.lit("data").alias("labelled_dataset_path_or_name"), F.lit("train").alias("labelled_dataset_split_name")
    )


@register("manifest_upsert", """
with p as (select (user_id % 10)::varchar as group_id, event_type as run_id, count(*) as n from events where event_type <> 'view' group by 1, 2),
     a as (select (user_id % 10)::varchar as group_id, event_type as run_id, count(*) + 1 as n from events group by 1, 2)
select group_id, run_id, n as num_logs from p union all select group_id, run_id, n from a anti join p using (group_id, run_id)
""")
def manifest_upsert(spark, sf_dir):
    """K7, K9: entries that are there already are skipped."""
    every = _entries(spark, sf_dir)
    got = M.added(every.where("run_id <> 'view'"), M.check(every.withColumn("num_logs", F.col("num_logs") + 1)))
    return got.select("group_id", "run_id", "num_logs")


@register("manifest_overwrite", "select (user_id % 10)::varchar as group_id, event_type as run_id, count(*) + 1 as num_logs from events group by 1, 2")
def manifest_overwrite(spark, sf_dir):
    """K7: entries that are there already are replaced."""
    every = _entries(spark, sf_dir)
    return M.added(every, every.withColumn("num_logs", F.col("num_logs") + 1), overwrite=True).select("group_id", "run_id", "num_logs")


@register("manifest_group", "select event_type as run_id, count(*) as num_logs from events where user_id % 10 = 3 group by 1")
def manifest_group(spark, sf_dir):
    """One group's entries."""
    return _entries(spark, sf_dir).where("group_id = '3'").select("run_id", "num_logs")


@register("tagged_runs", "select event_id from events where event_type in ('click', 'view') and event_id % 3 <> 0")
def tagged_runs(spark, sf_dir):
    """Runs with a wanted tag and no other."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tags = F.array("event_type", F.when(F.col("event_id") % 3 == 0, F.lit("outdated")).otherwise(F.lit("x")))
    return S.runs(e.withColumn("tags", tags), tags_in=("click", "view")).select("event_id")


@register("first_artifact", "select min(event_id) as event_id from events where user_id = 1 and event_type = 'click'")
def first_artifact(spark, sf_dir):
    """A run's first matching artifact."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    a = e.select(F.col("user_id").cast("string").alias("run_id"), F.lit("run_output").alias("type"), F.concat(F.lit("log-"), F.col("event_type")).alias("name"), F.col("event_id").alias("position"))
    return S.run_artifact(a, "1", "click").select(F.col("position").alias("event_id"))


@register("ontology_maps", "select lower(p_brand) as service, count(*) as slots from (select distinct p_brand, p_size from part) group by 1")
def ontology_maps(spark, sf_dir):
    """Flat ontology entries by service."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    flat = p.groupBy(F.concat(F.lower("p_brand"), F.lit("-"), F.col("p_size").cast("string")).alias("name")).agg(F.collect_set("p_type").alias("values"))
    return S.unflattened(flat).select("service", F.size("slots").cast("long").alias("slots"))


@register("evaluation_rows", """
with c as (select 'MUL' || conv_id || '.json' as dialogue_id, conv_id, turn from conversations)
select dialogue_id, turn as turn_id, conv_id as goal, turn % 2 as booked from c where conv_id % 3 = 0
""")
def evaluation_rows(spark, sf_dir):
    """Turns with their dialogue's goal and their booked domains."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("MUL"), F.col("conv_id").cast("string"), F.lit(".json")).alias("dialogue_id"), "conv_id", F.col("turn").cast("int").alias("turn_id"))
    goals = c.where("conv_id % 3 = 0").select(F.regexp_replace(F.lower("dialogue_id"), ".json", "").alias("dialogue_id"), F.col("conv_id").alias("goal")).distinct()
    booked = c.groupBy("dialogue_id").agg(F.transform(F.sequence(F.lit(0), F.max("turn_id")), lambda i: i % 2).alias("booked"))
    got = S.evaluation_input(c.select("dialogue_id", "turn_id"), goals, booked)
    return got.select("dialogue_id", F.col("turn_id").cast("long").alias("turn_id"), "goal", F.col("booked").cast("long").alias("booked"))
