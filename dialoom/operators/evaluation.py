"""Evaluation input: a run's logged turns as the metrics take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.operators import lookup as L
from dialoom.operators.rewrite import delexicalised
from dialoom.operators.state import STATE


def evaluation_turns(logs: DataFrame, slots: DataFrame, least: int = 90) -> DataFrame:
    """(dialogue_id, turn_id, response, state, active_domains) of logged turns (dialogue_id, turn_id, response, state, acts, active).

    The response is delexicalised once more by the predicted acts, with the names that evaluation has; the state is
    brought to the schema ``slots`` (service, slot, possible_values, is_categorical), of values that come to the same slot the
    smallest; active are the services of the state as predicted and those that the acts name. Null states, acts
    and lists are empty ones.
    """
    turn = F.struct("dialogue_id", "turn_id").alias("id")
    state = F.coalesce("state", F.expr(f"cast(map() as {STATE})"))
    services = logs.select(turn, F.explode(F.map_entries(state)).alias("s")).select("id", F.col("s.key").alias("service"), F.explode_outer(F.map_entries("s.value")).alias("v"))
    normal = L.normalise_states(services.select("id", "service", F.col("v.key").alias("slot"), F.col("v.value").alias("value")), slots, least)
    normal = normal.groupBy("id", "service", "slot").agg(F.min("value").alias("value"))
    entries = F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "value")))
    by_service = normal.groupBy("id", "service").agg(F.map_from_entries(F.array_sort(entries)).alias("own"))
    states = by_service.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("service", "own"))).alias("normal"))
    rows = logs.withColumn("id", turn).join(states, "id", "left")
    active = F.array_sort(F.array_union(F.map_keys(state), F.coalesce("active", F.expr("cast(array() as array<string>)"))))
    return rows.select(
        "dialogue_id", "turn_id", delexicalised(F.col("response"), F.col("acts"), evaluation=True).alias("response"),
        F.coalesce("normal", F.expr(f"cast(map() as {STATE})")).alias("state"), active.alias("active_domains"),
    )
