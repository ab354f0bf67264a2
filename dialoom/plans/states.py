"""Queries of the belief-state algebra. A user is a dialogue, an event a turn that sets service-slot pairs.

An event's update: service = event_type, slot ``k`` = the number in props, slot ``v`` = the value's whole
part; a multiple of five deletes or blanks. Updates are kept to a user's first events, states build on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.operators import state as S

SCHEMA = {"click": ["k", "v"], "purchase": ["k"], "view": ["k", "v"]}


def snapshots(spark, sf_dir) -> DataFrame:
    """(user_id, event_id, before, after): an event's two states, each of one service with two slots."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    e = e.select("user_id", "event_id", "ts", "event_type", F.when(k.cast("int") % 5 == 0, F.lit("")).otherwise(k).alias("k"), F.floor("value").cast("string").alias("v"))
    e = e.withColumn("own", F.create_map("event_type", F.create_map(F.lit("k"), "k", F.lit("v"), "v")))
    before = F.lag("own").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("user_id", "event_id", before.alias("before"), F.col("own").alias("after"))


_PAIRS = """
with e as (
  select user_id, event_id, ts, event_type,
         case when coalesce(json_extract_string(props, '$.k'), '')::int % 5 = 0 then '' else json_extract_string(props, '$.k') end as k,
         floor(value)::bigint::varchar as v
  from events
), s as (
  select *, lag(event_type) over w as pt, lag(k) over w as pk, lag(v) over w as pv from e window w as (partition by user_id order by ts, event_id)
), after as (
  select event_id, event_type as service, 'k' as slot, k as value from s where k <> '' union all select event_id, event_type, 'v', v from s where v <> ''
), before as (
  select event_id, pt as service, 'k' as slot, pk as value from s where pk <> '' union all select event_id, pt, 'v', pv from s where pv <> ''
)
"""


@register("state_delta", _PAIRS + """
select event_id, service, slot, coalesce(a.value, '[DELETE]') as value from before b full join after a using (event_id, service, slot) where a.value is distinct from b.value
""")
def state_delta(spark, sf_dir):
    """What leads from an event's state before to the one after, as rows."""
    s = snapshots(spark, sf_dir)
    d = s.select("event_id", F.explode(S.compute_delta(F.col("before"), F.col("after"))).alias("service", "m"))
    return d.select("event_id", "service", F.explode("m").alias("slot", "value"))


@register("state_round_trip", "select event_id, true as same from events")
def state_round_trip(spark, sf_dir):
    """The delta, applied, gives the state after."""
    s = snapshots(spark, sf_dir)
    again = S.apply_update(F.col("before"), S.compute_delta(F.col("before"), F.col("after")))
    return s.select("event_id", (F.size(S.compute_delta(again, F.col("after"))) == 0).alias("same"))


@register("state_rows", _PAIRS + "select event_id, service, slot, value from after")
def state_rows(spark, sf_dir):
    """The slots that are set, as rows."""
    return S.explode_state(snapshots(spark, sf_dir), "after", "event_id")


@register("state_keys", _PAIRS + "select e.event_id, coalesce(array_to_string(list_sort(list(service || '.' || slot) filter (slot is not null)), ','), '') as key from e left join after using (event_id) group by e.event_id")
def state_keys(spark, sf_dir):
    """Which slots are set, as one text."""
    return snapshots(spark, sf_dir).select("event_id", S.slots_key(F.col("after")).alias("key"))


@register("state_clean", _PAIRS + """
, own as (select event_id, event_type as service, unnest(['k', 'v']) as slot, unnest([k, v]) as value from s)
select event_id, service, slot, value from own where (service = 'click' and slot in ('k', 'v')) or (service = 'purchase' and slot = 'k') or (service = 'view' and slot in ('k', 'v'))
""")
def state_clean(spark, sf_dir):
    """Known services and slots only, blanks kept."""
    s = snapshots(spark, sf_dir).select("event_id", F.explode(S.clean_state(F.col("after"), SCHEMA)).alias("service", "m"))
    return s.select("event_id", "service", F.explode("m").alias("slot", "value"))


@register("state_dense", _PAIRS + """
select event_id, case when event_type = 'click' then k else '' end as click_k, case when event_type = 'view' then coalesce(v, '') else '' end as view_v from s
""")
def state_dense(spark, sf_dir):
    """Every slot of the schema, unset ones empty."""
    s = snapshots(spark, sf_dir).select("event_id", S.dense(F.col("after"), SCHEMA).alias("d"))
    return s.select("event_id", F.col("d.click.k").alias("click_k"), F.col("d.view.v").alias("view_v"))


@register("joint_match", _PAIRS + """
, d as (select distinct event_id from before b full join after a using (event_id, service, slot) where a.value is distinct from b.value)
select user_id, count(*) as turns, (count(*) - count(d.event_id)) as matches, round((count(*) - count(d.event_id))::double / count(*), 6) as jga from s left join d using (event_id) group by user_id
""")
def joint_match(spark, sf_dir):
    """M2: how often the state stays as it was, by user."""
    s = snapshots(spark, sf_dir).select("user_id", S.joint_match(F.col("before"), F.col("after")).alias("m"))
    return s.groupBy("user_id").agg(F.count("*").alias("turns"), F.sum(F.col("m").cast("long")).alias("matches"), F.round(F.avg(F.col("m").cast("double")), 6).alias("jga"))


@register("running_accuracy", """
select event_id, round(avg((case when event_type = 'purchase' then 1.0 else 0.0 end)::double) over (partition by user_id order by ts, event_id), 6) as accuracy from events
""")
def running_accuracy(spark, sf_dir):
    """A running mean."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("x", (F.col("event_type") == "purchase").cast("double"))
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.select("event_id", F.round(F.avg("x").over(w), 6).alias("accuracy"))


@register("has_predictions", "select user_id, bool_and(value is not null) as has_value, bool_and(json_extract_string(props, '$.k') is not null) as has_k from events group by user_id")
def has_predictions(spark, sf_dir):
    """Whether all turns of a dialogue have a field."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").agg(F.bool_and(F.col("value").isNotNull()).alias("has_value"), F.bool_and(F.get_json_object("props", "$.k").isNotNull()).alias("has_k"))


@register("active_domains", """
with recursive c as (select conv_id, row_number() over (partition by conv_id order by turn) as i, role, (length(text) % 7)::varchar as v from conversations),
s as (select conv_id, i, (select list({'r': r, 'v': v} order by r) from (select l.role as r, max_by(l.v, l.i) as v from c l where l.conv_id = c.conv_id and l.i <= c.i group by l.role)) as state from c),
f as (
  select conv_id, 0::bigint as i, []::varchar[][] as out, []::struct(r varchar, v varchar)[] as before, null::varchar as current, []::varchar[] as changed from c group by conv_id
  union all
  select conv_id, i, list_append(out, case when none then []::varchar[] else [next] end), case when none then before else state end, case when none then current else next end, case when none then changed else now end
  from (select *, len(now) = 0 and current is null as none,
      case when len(now) = 0 then case when len(changed) > 1 then coalesce(list_filter(changed, lambda d: d <> current)[1], current) else current end
           when list_contains(now, current) then current else now[1] end as next
    from (select f.conv_id, s.i, f.out, f.before, f.current, f.changed, s.state, list_transform(list_filter(s.state, lambda x: not list_contains(f.before, x)), lambda x: x.r) as now
      from f join s on s.conv_id = f.conv_id and s.i = f.i + 1)))
select conv_id, '[' || array_to_string(list_transform(max_by(out, i), lambda a: '[' || array_to_string(list_transform(a, lambda x: '"' || x || '"'), ',') || ']'), ',') || ']' as active from f group by conv_id
""")
def active_domains(spark, sf_dir):
    """Each conversation's active domains by turn (roles as domains, text lengths as slots)."""
    from dialoom.operators.folds import with_active_domains

    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    pairs = F.collect_list(F.struct("role", (F.length("text") % 7).cast("string").alias("v"))).over(w)
    slots = lambda r: F.map_from_entries(F.array(F.struct(F.lit("n").alias("key"), F.element_at(F.transform(F.filter("p", lambda x: x["role"] == r), lambda x: x["v"]), -1).alias("value"))))
    t = t.select("conv_id", "turn", pairs.alias("p")).select("conv_id", "turn", F.map_from_entries(F.transform(F.array_distinct(F.transform("p", lambda x: x["role"])), lambda r: F.struct(r.alias("key"), slots(r).alias("value")))).alias("state"))
    d = t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.map_entries("state").alias("e"))), lambda a, b: (a["turn"] - b["turn"]).cast("int")), lambda x: F.map_from_entries(x["e"])).alias("states"))
    return with_active_domains(d).select("conv_id", F.to_json("active").alias("active"))
