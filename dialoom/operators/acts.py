"""Dialogue acts: grouping raw rows, serialising, tuples, keys, placeholders, deltas.

An act is a struct(type, service, entity: map<slot, value>, values: array<slot>): informing acts carry an
entity, requests the slots asked for. On the wire it is JSON; reading is tolerant of single quotes and
never evaluates anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.functions import fixed
from dialoom.functions.text import lookup, placeholder, schema_slot

ACT = "struct<type: string, service: string, entity: map<string, string>, values: array<string>>"
ENTITY_ACTS = ("Inform", "Offer", "Confirm", "NotifySuccess", "NotifyFailure")


def group_raw(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., pos, act, service, slot, value) -> (key..., acts), acts in the order in which (act, service) first stand.

    Rows without act and service are skipped; slots and values are trimmed; an empty value or a slot
    ``none`` adds nothing, a value ``none`` is ``yes``; of repeated slots the last counts.
    """
    named = rows.where((F.coalesce("act", F.lit("")) != "") | (F.coalesce("service", F.lit("")) != "")).select(
        *key, "pos", F.lower("act").alias("act"), "service", schema_slot(F.trim("slot"), F.col("service")).alias("slot"), F.trim("value").alias("value")
    )
    value = F.when(F.col("value") == "none", F.lit("yes")).otherwise(F.col("value"))
    keep = (F.coalesce("value", F.lit("")) != "") & (F.coalesce("slot", F.lit("none")) != "none")
    last = named.where(keep).groupBy(*key, "act", "service", "slot").agg(F.max_by(value, "pos").alias("value"), F.max("pos").alias("at"))
    slots = last.groupBy(*key, "act", "service").agg(F.array_sort(F.collect_list(F.struct("at", "slot", "value"))).alias("slots"))
    order = named.groupBy(*key, "act", "service").agg(F.min("pos").alias("first"))
    kind = lookup(F.col("act"), fixed.ACTS)
    pairs = F.map_from_entries(F.transform(F.coalesce("slots", F.expr("cast(array() as array<struct<at: int, slot: string, value: string>>)")), lambda x: F.struct(x["slot"].alias("key"), x["value"].alias("value"))))
    act = F.struct(
        kind.alias("type"),
        F.when(kind.isin("Inform", "Offer", "Confirm", "Request", "NotifySuccess", "NotifyFailure"), F.col("service")).alias("service"),
        F.when(kind.isin(*ENTITY_ACTS), pairs).alias("entity"),
        F.when(kind == "Request", F.map_keys(pairs)).alias("values"),
    )
    joined = order.join(slots, [*key, "act", "service"], "left").select(*key, F.struct("first", act.alias("act")).alias("x"))
    return joined.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("x"), lambda a, b: a["first"] - b["first"]), lambda x: x["act"]).alias("acts"))


def to_wire(act: Column) -> Column:
    return F.to_json(act)


def from_wire(text: Column) -> Column:
    """JSON (or its single-quoted form) as an act; null if it is neither."""
    parsed = F.from_json(text, ACT, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.when(parsed["type"].isNotNull(), parsed)


def unfill(act: Column) -> Column:
    """Entity values as placeholders; requests stay."""
    filled = F.transform_values(act["entity"], lambda k, v: F.when(k.isin("service", "act"), v).otherwise(placeholder(k)))
    return F.when(act["type"] == "Request", act).otherwise(act.withField("entity", filled))


def tuples(df: DataFrame, acts: str, *keep: str) -> DataFrame:
    """One row (keep..., act, service, slot, value) for each slot of each act; requests ask for ``?``."""
    each = df.select(*keep, F.explode(acts).alias("a"))
    pairs = F.when(F.col("a.type") == "Request", F.transform("a.values", lambda v: F.struct(v.alias("key"), F.lit("?").alias("value")))).otherwise(F.map_entries("a.entity"))
    return each.select(*keep, F.col("a.type").alias("act"), F.col("a.service").alias("service"), F.explode_outer(pairs).alias("p")).select(*keep, "act", "service", F.col("p.key").alias("slot"), F.col("p.value").alias("value"))


def acts_key(acts: Column) -> Column:
    """Sorted ``Type.service.slot`` and ``Type.slot`` names, joined by ``-``."""
    none = F.expr("cast(array() as array<string>)")

    def names(a):
        own = F.transform(F.filter(F.map_entries(F.coalesce(a["entity"], F.expr("cast(map() as map<string, string>)"))), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat_ws(".", a["type"], a["service"], e["key"]))
        return F.concat(own, F.transform(F.coalesce(a["values"], none), lambda v: F.concat(a["type"], F.lit("."), v)))

    return F.array_join(F.array_sort(F.flatten(F.transform(acts, names))), "-")


def active_services(acts: Column, services=fixed.EVALUATED_SERVICES) -> Column:
    """Services of the acts' entities, repeats kept."""
    return F.filter(F.transform(F.filter(acts, lambda a: a["entity"].isNotNull()), lambda a: F.lower(a["service"])), lambda s: s.isin(*services))


def act_names(acts: Column) -> Column:
    return F.array_distinct(F.transform(acts, lambda a: a["type"]))


def slot_names(acts: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.flatten(F.transform(acts, lambda a: F.concat(F.coalesce(F.map_keys(a["entity"]), none), F.coalesce(a["values"], none)))))


def slot_values(acts: Column) -> Column:
    """Values as JSON texts, one level deep."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.flatten(F.transform(acts, lambda a: F.transform(F.coalesce(F.map_values(a["entity"]), none), lambda v: F.concat(F.lit('"'), v, F.lit('"'))))))


def intent_call(delta: Column, intents: list[tuple[str, str, list[str]]]) -> Column:
    """The call of the first intent (name, service, slots) whose slots hold all changed ones of its service.

    No change is ``agent.no_change()``; changes that no intent covers give null.
    """
    none = F.expr("cast(map() as map<string, string>)")
    call = F.when(F.size(delta) == 0, F.lit("agent.no_change()"))
    for name, service, slots in intents:
        own = F.coalesce(F.try_element_at(delta, F.lit(service)), none)
        fits = (F.size(own) > 0) & (F.size(F.array_except(F.map_keys(own), F.array(*map(F.lit, slots)))) == 0)
        args = F.array_join(F.transform(F.array_sort(F.map_entries(own)), lambda e: F.concat(F.replace(e["key"], F.lit(" "), F.lit("_")), F.lit('="'), e["value"], F.lit('"'))), ", ")
        call = call.when(fits, F.concat(F.lit(f"{name}("), args, F.lit(")")))
    return call


def acts_of_delta(delta: Column) -> Column:
    """One informing act for each changed service."""
    return F.transform(F.array_sort(F.map_keys(delta)), lambda s: F.struct(F.lit("Inform").alias("type"), s.alias("service"), F.element_at(delta, s).alias("entity"), F.expr("cast(null as array<string>)").alias("values")))
