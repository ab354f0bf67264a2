"""Queries of the dialogue-act operators; raw act rows come from events (one act each, its slots from props)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.operators import acts as A

_TYPES = {"click": "inform", "purchase": "book", "view": "request", "search": "recommend", "login": "greet", "logout": "bye"}


def raw(spark, sf_dir) -> DataFrame:
    """(user_id, pos, act, service, slot, value)"""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kinds = F.create_map(*[F.lit(x) for p in _TYPES.items() for x in p])
    act = F.coalesce(F.try_element_at(kinds, F.col("event_type")), F.lit("inform"))
    slot = F.element_at(F.array(F.lit("area"), F.lit("addr"), F.lit("leaveat"), F.lit("none")), (F.col("event_id") % 4 + 1).cast("int"))
    service = F.when(F.col("user_id") % 2 == 0, F.lit("hotel")).otherwise(F.lit("train"))
    return e.select("user_id", F.col("event_id").cast("int").alias("pos"), act.alias("act"), service.alias("service"), slot.alias("slot"), F.concat(F.lit(" "), F.get_json_object("props", "$.k")).alias("value"))


_CASES = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _TYPES.items()) + " else 'inform' end"
_RAW = f"""
with raw as (
  select user_id, event_id as pos, {_CASES} as act, case when user_id % 2 = 0 then 'hotel' else 'train' end as service,
         case event_id % 4 when 0 then 'area' when 1 then 'address' when 2 then 'leave at' else 'none' end as slot, json_extract_string(props, '$.k') as value
  from events
), kinds as (
  select *, case act when 'inform' then 'Inform' when 'book' then 'NotifySuccess' when 'request' then 'Request' when 'recommend' then 'Offer' when 'greet' then 'Greeting' else 'Goodbye' end as kind from raw
), slots as (
  select user_id, act, kind, service, slot, arg_max(value, pos) as value from kinds where slot <> 'none' and value <> '' group by all
)
"""


@register("act_tuples", _RAW + """
select user_id, kind as act, service, slot, case when kind = 'Request' then '?' else value end as value from slots where kind not in ('Greeting', 'Goodbye')
""")
def act_tuples(spark, sf_dir):
    """Raw rows as acts, and acts as tuples."""
    got = A.tuples(A.group_raw(raw(spark, sf_dir), "user_id"), "acts", "user_id")
    return got.where("slot is not null").select("user_id", "act", "service", "slot", F.col("value"))


@register("act_keys", _RAW + """
, names as (
  select distinct user_id, case when kind = 'Request' then 'Request.' || slot else kind || '.' || service || '.' || slot end as name from slots where kind not in ('Greeting', 'Goodbye')
), users as (select distinct user_id from raw)
select user_id, coalesce(array_to_string(list_sort(list(name) filter (name is not null)), '-'), '') as key from users left join names using (user_id) group by user_id
""")
def act_keys(spark, sf_dir):
    """Which slots each kind of act has, as one text."""
    return A.group_raw(raw(spark, sf_dir), "user_id").select("user_id", A.acts_key(F.col("acts")).alias("key"))


@register("act_order", _RAW + """
, firsts as (select user_id, act, service, kind, min(pos) as first from kinds group by all)
select user_id, array_to_string(list(kind order by first), ',') as kinds from firsts group by user_id
""")
def act_order(spark, sf_dir):
    """A1: acts stand in the order of their first rows."""
    return A.group_raw(raw(spark, sf_dir), "user_id").select("user_id", F.array_join(F.transform("acts", lambda a: a["type"]), ",").alias("kinds"))


@register("act_wire", "select distinct user_id, true as same from events")
def act_wire(spark, sf_dir):
    """A2, A4: acts survive their JSON form, single quotes included."""
    got = A.group_raw(raw(spark, sf_dir), "user_id").select("user_id", F.transform("acts", lambda a: a).alias("acts"))
    each = got.select("user_id", F.explode("acts").alias("a"))
    same = F.to_json(A.from_wire(A.to_wire(F.col("a")))) == F.to_json("a")
    quoted = A.from_wire(F.replace(A.to_wire(F.col("a")), F.lit('"'), F.lit("'")))["type"] == F.col("a.type")
    return each.groupBy("user_id").agg(F.bool_and(same & quoted).alias("same"))


@register("act_slots", _RAW + """
select user_id, count(distinct slot) as slots, count(distinct case when kind <> 'Request' then value end) as given from slots where kind not in ('Greeting', 'Goodbye') group by user_id
""")
def act_slots(spark, sf_dir):
    """Slot names and values of a user's acts; values as placeholders don't change the names."""
    got = A.group_raw(raw(spark, sf_dir), "user_id")
    unfilled = F.transform("acts", A.unfill)
    got = got.select("user_id", F.size(A.slot_names(unfilled)).cast("long").alias("slots"), F.size(A.slot_values(F.col("acts"))).cast("long").alias("given"))
    return got.where("slots > 0")


@register("act_services", _RAW + """
, a as (select distinct user_id, act, kind, service from kinds) select user_id, count(*) as active from a where kind in ('Inform', 'Offer', 'Confirm', 'NotifySuccess', 'NotifyFailure') group by user_id
""")
def act_services(spark, sf_dir):
    """Services of the acts' entities."""
    got = A.group_raw(raw(spark, sf_dir), "user_id").select("user_id", F.size(A.active_services(F.col("acts"))).cast("long").alias("active"))
    return got.where("active > 0")
