"""Belief states: map<service, map<slot, value>> columns, their algebra in higher-order functions.

A blank value (null or empty) means that the slot isn't set; ``DELETE`` in an update removes a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE = "[DELETE]"
STATE = "map<string, map<string, string>>"


def empty(kind: str = STATE) -> Column:
    return F.expr(f"cast(map() as {kind})")


def _set(v: Column) -> Column:
    return v.isNotNull() & (v != "")


def remove_blank_values(state: Column) -> Column:
    """Without blank slots, and without services that have none left; null is the empty state."""
    slots = F.transform_values(F.coalesce(state, empty()), lambda _, m: F.map_filter(F.coalesce(m, empty("map<string, string>")), lambda k, v: _set(v)))
    return F.map_filter(slots, lambda _, m: F.size(m) > 0)


def apply_update(state: Column, update: Column) -> Column:
    """Upsert, and remove what the update deletes; deleting an absent slot changes nothing."""
    none = empty("map<string, string>")
    merged = F.map_zip_with(
        F.coalesce(state, empty()),
        F.coalesce(update, empty()),
        lambda _, a, b: F.map_filter(F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.coalesce(y, x)), lambda _, v: v != DELETE),
    )
    return remove_blank_values(merged)


def compute_delta(before: Column, after: Column) -> Column:
    """The update that leads from one state to the other: changed and new values, and deletions."""
    none = empty("map<string, string>")
    changed = F.map_zip_with(
        remove_blank_values(before),
        remove_blank_values(after),
        lambda _, a, b: F.map_filter(
            F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda _, x, y: F.when(x.eqNullSafe(y), F.lit(None).cast("string")).otherwise(F.coalesce(y, F.lit(DELETE)))),
            lambda _, v: v.isNotNull(),
        ),
    )
    return F.map_filter(changed, lambda _, m: F.size(m) > 0)


def clean_state(state: Column, schema: dict[str, list[str]]) -> Column:
    """Known services and slots with a value that isn't null; empty values and services stay."""
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for p in schema.items() for x in p])
    inside = F.map_filter(F.coalesce(state, empty()), lambda s, _: F.map_contains_key(known, s))
    return F.transform_values(inside, lambda s, m: F.map_filter(F.coalesce(m, empty("map<string, string>")), lambda k, v: v.isNotNull() & F.array_contains(F.element_at(known, s), k)))


def slots_key(state: Column) -> Column:
    """Sorted ``service.slot`` names of the slots that are set; values don't count."""
    names = F.flatten(F.transform(F.map_entries(remove_blank_values(state)), lambda e: F.transform(F.map_keys(e["value"]), lambda k: F.concat(e["key"], F.lit("."), k))))
    return F.array_join(F.array_sort(names), ",")


def flat(state: Column) -> Column:
    """``service-slot`` -> value of the slots that are set."""
    rows = F.transform(F.map_entries(remove_blank_values(state)), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(F.concat(e["key"], F.lit("-"), x["key"]).alias("key"), x["value"].alias("value"))))
    return F.map_from_entries(F.flatten(rows))


def explode_state(df: DataFrame, state: str, *keep: str) -> DataFrame:
    """One row (keep..., service, slot, value) for each slot that is set."""
    services = df.select(*keep, F.explode(remove_blank_values(F.col(state))).alias("service", "slots"))
    return services.select(*keep, "service", F.explode("slots").alias("slot", "value"))


def build_state(rows: DataFrame, *key: str) -> DataFrame:
    """The reverse of ``explode_state``: (key..., state)."""
    services = rows.groupBy(*key, "service").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("slots"))
    return services.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("service", "slots"))).alias("state"))


def dense(state: Column, schema: dict[str, list[str]]) -> Column:
    """A struct of all services and slots of the schema, unset ones empty."""
    none = empty("map<string, string>")
    services = [F.struct(*[F.coalesce(F.try_element_at(F.coalesce(F.try_element_at(state, F.lit(s)), none), F.lit(k)), F.lit("")).alias(k) for k in slots]).alias(s) for s, slots in schema.items()]
    return F.struct(*services)


def fill_acts(acts: Column) -> Column:
    """An empty or null act list as the list of one empty text."""
    return F.when(F.coalesce(F.size(acts), F.lit(0)) > 0, acts).otherwise(F.array(F.lit("")))


def joint_match(predicted: Column, gold: Column) -> Column:
    """Whether two states are equal slot by slot (exact values; see metrics.joint_goal for near ones)."""
    return F.size(compute_delta(predicted, gold)) == 0


def reference_of(state: Column, service: Column, slot: Column, value: Column, said: Column, literal: Column) -> Column:
    """Another slot of the state that a value refers to, as ``service.slot``, or null.

    ``literal``: whether slots of this kind hold numbers or yes/no; these refer to the same slot of
    another service, and only if the turn does not say the value as a word of its own. Other values refer
    to the first slot (by name) with the same value, unless the turn mentions them nearly (see mentions).
    """
    rows = F.flatten(F.transform(F.map_entries(remove_blank_values(state)), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(e["key"].alias("service"), x["key"].alias("slot"), F.lower(x["value"]).alias("value")))))
    others = F.filter(rows, lambda r: (r["value"] == F.lower(value)) & ~((r["service"] == service) & (r["slot"] == slot)))
    same = F.filter(others, lambda r: r["slot"] == slot)
    name = lambda a: F.array_min(F.transform(a, lambda r: F.concat(r["service"], F.lit("."), r["slot"])))
    plain = F.concat(F.lit(" "), F.lower(said), F.lit(" "))
    return (
        F.when(F.lower(value) == "dontcare", F.lit(None).cast("string"))
        .when(literal, F.when(~plain.contains(F.concat(F.lit(" "), F.lower(value), F.lit(" "))), name(same)))
        .when(~mentions(said, value), name(others))
    )


def mentions(said: Column, value: Column) -> Column:
    """Whether a window of the utterance is within an edit (two from six characters on) of the value, case aside."""
    s, v = F.lower(F.coalesce(said, F.lit(""))), F.lower(value)
    most = F.when(F.length(v) < 6, 1).otherwise(2)
    windows = lambda d: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - F.length(v) - d + 1)), lambda i: F.substr(s, i, F.length(v) + d))
    near = [F.exists(windows(d), lambda w: F.call_function("levenshtein", w, v, most) >= 0) for d in (-1, 0, 1, 2)]  # -1 beyond ``most``
    # two edits leave one of three parts whole, so only an utterance that holds one is looked through
    third = F.floor(F.length(v) / 3).cast("int")
    parts = [F.substr(v, i * third + 1, F.when(F.lit(i == 2), F.length(v)).otherwise(third)) for i in range(3)]
    some = F.contains(s, parts[0]) | F.contains(s, parts[1]) | F.contains(s, parts[2])
    return (s != "") & (F.contains(s, v) | (some & (near[0] | near[1] | near[2] | near[3])))
