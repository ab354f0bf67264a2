"""Order-dependent folds over a dialogue: active domains and offered venues.

Both are expressions over typed arrays of a dialogue's turns, folded by ``aggregate``: no text is written or read
again, nothing leaves the JVM, and a dialogue never spans tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUESTABLE = ("PHONE", "ADDRESS", "POST", "REFERENCE", "TRAINID")
#: Domains without a venue table.
AUTOMATIC = ("taxi", "police", "hospital")
STATE = "map<string, map<string, string>>"
TURN = "struct<slots: array<string>, domains: array<string>, venues: map<string, array<string>>>"
GOAL = "map<string, struct<informable: map<string, string>, requestable: array<string>, venues: array<string>>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def active_domains(states: Column) -> Column:
    """Each turn's active domains, of an array of states (``STATE``) in turn order.

    A turn with new (slot, value) pairs activates the changed domain, or stays with the current one if it
    is among several; otherwise the changed domain with most slots, the first by name on ties. A turn
    without any keeps the current domain, unless the turn right before changed several: then the next of those
    that is still in the state. Before the first change there is none, and the state to compare with stays.
    """
    zero = F.struct(_none("array<string>").alias("out"), F.expr(f"cast(map() as {STATE})").alias("before"), F.lit(None).cast("string").alias("current"), _none("string").alias("changed"))

    def step(acc: Column, state: Column) -> Column:
        old = lambda d: F.try_element_at(acc["before"], d)
        new = lambda d: F.exists(F.map_entries(F.try_element_at(state, d)), lambda e: ~F.coalesce(F.map_contains_key(old(d), e["key"]), F.lit(False)) | ~F.try_element_at(old(d), e["key"]).eqNullSafe(e["value"]))
        changed = F.array_sort(F.filter(F.map_keys(state), new))
        size = lambda d: F.size(F.try_element_at(state, d))
        fullest = F.try_element_at(F.transform(F.array_sort(F.transform(changed, lambda d: F.struct((-size(d)).alias("less"), d.alias("d")))), lambda x: x["d"]), F.lit(1))
        others = F.filter(acc["changed"], lambda d: (d != acc["current"]) & F.map_contains_key(state, d))
        moved = F.when((F.size(acc["changed"]) > 1) & (F.size(others) > 0), F.try_element_at(others, F.lit(1))).otherwise(acc["current"])
        current = F.when(F.size(changed) == 0, moved).when(F.coalesce(F.array_contains(changed, acc["current"]), F.lit(False)), acc["current"]).otherwise(fullest)
        nothing = (F.size(changed) == 0) & acc["current"].isNull()
        out = F.concat(acc["out"], F.array(F.when(nothing, _none("string")).otherwise(F.array(current))))
        return F.struct(
            out.alias("out"), F.when(nothing, acc["before"]).otherwise(state).alias("before"),
            F.when(nothing, acc["current"]).otherwise(current).alias("current"), F.when(nothing, acc["changed"]).otherwise(changed).alias("changed"),
        )

    return F.aggregate(states, zero, step, lambda acc: acc["out"])


def judge(turns: Column, goal: Column, booked: Column) -> Column:
    """array of (domain, match, success), of a dialogue's turns (``TURN``), its goal (``GOAL``) and the domains booked by turn.

    A turn: slots (evaluation slots that the response mentions), domains (active), venues (domain -> ids that
    meet the state now), found earlier. The goal: domain -> informable, requestable, venues (ids).
    An offer is made when a name (or a train's id) is mentioned, and replaced only when some venue of the old
    one no longer meets the state; where none does, that withdraws the offer. References count only in turns
    where the domain is booked. No domain succeeds unless all match.
    """
    both = F.arrays_zip(turns.alias("turn"), booked.alias("books"))
    both = F.slice(both, F.lit(1), F.least(F.size(turns), F.size(booked)))
    asked = F.array(*map(F.lit, REQUESTABLE))

    def fold(d: Column) -> Column:
        zero = F.struct(_none("string").alias("offered"), _none("string").alias("given"))

        def step(acc: Column, x: Column) -> Column:
            said, now = x["turn"]["slots"], F.coalesce(F.try_element_at(x["turn"]["venues"], d), _none("string"))
            offers = ~d.isin(*AUTOMATIC) & F.array_contains(said, F.when(d == "train", F.lit("TRAINID")).otherwise(F.lit("NAME")))
            stale = (F.size(acc["offered"]) == 0) | (F.size(F.array_except(acc["offered"], now)) > 0)
            given = F.filter(F.array_intersect(asked, said), lambda s: (s != "REFERENCE") | F.array_contains(x["books"], d))
            then = F.struct(F.when(offers & stale, now).otherwise(acc["offered"]).alias("offered"), F.array_union(acc["given"], given).alias("given"))
            return F.when(F.array_contains(x["turn"]["domains"], d), then).otherwise(acc)

        return F.aggregate(both, zero, step)

    def domain(e: Column) -> Column:
        return F.struct(e["key"].alias("domain"), e["value"].alias("want"), fold(e["key"]).alias("got"))

    def told(x: Column) -> Column:
        d, want, offered = x["domain"], x["want"], x["got"]["offered"]
        free = d.isin(*AUTOMATIC) | F.map_contains_key(want["informable"], F.lit("name")) | ((d == "train") & (F.size(offered) == 0) & ~F.array_contains(want["requestable"], "TRAINID"))
        met = (F.size(offered) > 0) & (F.size(F.array_except(offered, want["venues"])) == 0)
        return F.struct(d.alias("domain"), (free | met).alias("match"), (F.size(F.array_except(want["requestable"], x["got"]["given"])) == 0).alias("success"))

    found = F.transform(F.transform(F.map_entries(goal), domain), told)
    return F.transform(found, lambda x: F.struct(x["domain"].alias("domain"), x["match"].alias("match"), (x["success"] & F.forall(found, lambda y: y["match"])).alias("success")))


def with_active_domains(dialogues: DataFrame, states: str = "states", out: str = "active") -> DataFrame:
    """A column of each turn's active domains, from a column of states in turn order."""
    return dialogues.withColumn(out, active_domains(F.col(states)))


def judged(dialogues: DataFrame) -> DataFrame:
    """(dialogue, turns, goal, booked) -> (dialogue, domain, match, success)."""
    rows = dialogues.select("dialogue", F.explode(judge(F.col("turns"), F.col("goal"), F.col("booked"))).alias("j"))
    return rows.select("dialogue", "j.domain", "j.match", "j.success")
