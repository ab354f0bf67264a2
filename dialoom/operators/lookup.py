"""Constraint queries over venue tables, validity predicates, and value lookup with aliases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.functions import fixed
from dialoom.functions.aliases import key_column, writings_column, written_column
from dialoom.functions.fuzzy import partial_column
from dialoom.functions.text import canonical_value, database_slot, fuzzy_key, is_valid_time, minutes
from dialoom.operators.near import near_pairs
from dialoom.sources.tables import settled

#: Ranges of bounds in which counts run.
RANGES = 128


def find(venues: DataFrame, domain: str, constraints: dict[str, str | None], least: int = 90) -> DataFrame:
    """The rows of a venue table that meet all constraints.

    A null, empty or indifferent constraint holds always, as does a cell ``?``; names that aren't columns
    are ignored; values are canonical by the rule of their slot; ``arrive`` is an upper and ``leave`` a lower
    bound in minutes; columns that are matched approximately need a partial ratio of ``least``; all others are
    equal. A domain without a venue table has no venues.
    """
    if domain not in fixed.TABLES:
        return venues.where("false")
    out = venues
    for name, value in constraints.items():
        name = {"arriveby": "arrive", "leaveat": "leave"}.get(name.lower().replace(" ", ""), name.lower().replace(" ", ""))
        if name not in venues.columns or not value or value.lower() in fixed.ANY_VALUE:
            continue
        cell, want = F.col(name), canonical_value(F.lit(name), F.lit(value.lower()))
        if name == "arrive":
            test = minutes(cell) <= minutes(want)
        elif name == "leave":
            test = minutes(cell) >= minutes(want)
        elif name in fixed.FUZZY_COLUMNS.get(domain, ()):
            test = partial_column(F.lower(cell), want) >= least
        else:
            test = F.lower(cell) == want
        out = out.where((cell == "?") | test)
    return out


def matching(queries: DataFrame, venues: DataFrame, equal: dict[str, str], upper: dict[str, str] | None = None, lower: dict[str, str] | None = None) -> DataFrame:
    """Batch form: each query row with each venue that meets its constraints (query column -> venue column).

    A null constraint holds always, a cell ``?`` meets any. Queries that set the first equality are hash joined by
    it, and meet the ``?`` cells apart; only those that leave it open meet all venues.
    """
    def test(keys: dict[str, str]) -> Column:
        out = F.lit(True)
        for q, v in keys.items():
            out = out & (F.col(q).isNull() | (F.col(v) == "?") | (F.col(q) == F.col(v)))
        for q, v in (upper or {}).items():
            out = out & (F.col(q).isNull() | (F.col(v) <= F.col(q)))
        for q, v in (lower or {}).items():
            out = out & (F.col(q).isNull() | (F.col(v) >= F.col(q)))
        return out

    if not equal:
        return queries.join(venues, test({}))
    (q, v), rest = next(iter(equal.items())), dict(list(equal.items())[1:])
    some, none = queries.where(F.col(q).isNotNull()), queries.where(F.col(q).isNull())
    keyed = some.join(venues.where(F.col(v) != "?"), (F.col(q) == F.col(v)) & test(rest))
    any_ = some.join(venues.where(F.col(v) == "?"), test(rest))
    return keyed.unionByName(any_).unionByName(none.join(venues, test(rest)))


def matched(queries: DataFrame, venues: DataFrame, by: str, equal: tuple[str, str], lower: tuple[str, str], first: str) -> DataFrame:
    """(by, n, first): how many pairs ``matching`` has for a query and their smallest ``first``; queries without any are left out.

    No pairs are made. A query asks the venues of its own value and those of ``?``, or all if it leaves its value open. In
    each such group all bounds are put in one order, from above, in which counts and minima run: within ranges of the
    bound, and over the ranges' sums. ``lower`` (query column, venue column) are numbers.
    """
    (q, v), (least, bound) = equal, lower
    group = lambda open_, key: F.struct(F.lit(open_).alias("open"), F.coalesce(key.cast("string"), F.lit("")).alias("key"))
    own = F.array(group(False, F.col(q)), group(False, F.lit("?")))
    asked = queries.select(by, F.col(least).alias("x"), F.explode(F.when(F.col(q).isNull(), F.array(group(True, F.lit("")))).otherwise(F.array_distinct(own))).alias("g"))
    said = F.when(F.col(v).isNull(), F.array(group(True, F.lit("")))).otherwise(F.array(group(True, F.lit("")), group(False, F.col(v))))
    held = venues.select(F.explode(said).alias("g"), F.col(bound).alias("x"), F.lit(1).alias("n"), F.col(first).alias("first"))
    none = asked.select("g", "x").distinct().select("g", "x", F.lit(0).alias("n"), F.lit(None).cast(venues.schema[first].dataType).alias("first"))
    steps = settled(held.unionByName(none).groupBy("g", "x").agg(F.sum("n").alias("n"), F.min("first").alias("first")))
    edges = sorted(set(steps.select(F.col("x").cast("double").alias("x")).approxQuantile("x", [i / RANGES for i in range(1, RANGES)], 0.002)))
    # nulls come last: no bound that is set is met by one, and an open bound by all
    place = F.when(F.col("x").isNull(), -1).otherwise(F.pandas_udf(lambda x: pd.Series(np.searchsorted(edges, x, "right")), "int")(F.col("x").cast("double")))
    steps = steps.withColumn("r", place)
    sums = steps.groupBy("g", "r").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    above = W.partitionBy("g").orderBy(F.desc("r")).rowsBetween(W.unboundedPreceding, -1)  # at most ``RANGES`` + 1 rows
    sums = sums.select("g", "r", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.min("first").over(above).alias("first_above"))
    here = W.partitionBy("g", "r").orderBy(F.desc_nulls_last("x")).rowsBetween(W.unboundedPreceding, 0)
    told = steps.join(sums, ["g", "r"]).select("g", "x", (F.col("n_above") + F.sum("n").over(here)).alias("n"), F.least("first_above", F.min("first").over(here)).alias("first"))
    a, b = asked.alias("a"), told.alias("b")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & F.col("a.x").eqNullSafe(F.col("b.x"))).select(F.col(f"a.{by}").alias(by), "b.n", "b.first")
    return met.groupBy(by).agg(F.sum("n").alias("n"), F.min("first").alias("first")).where("n > 0")


def request(constraints: Column) -> Column:
    """A constraint map without blanks, its slots named as the tables' columns."""
    return F.transform_keys(F.map_filter(constraints, lambda k, v: v.isNotNull() & (v != "")), lambda k, v: database_slot(k))


def venues(raw: DataFrame, domain: str) -> DataFrame:
    """A raw venue table without the domain's ignored columns, names in lower case without spaces."""
    drop = fixed.IGNORED_COLUMNS.get(domain, ())
    short = {"arriveby": "arrive", "leaveat": "leave"}
    names = {c: c.lower().replace(" ", "") for c in raw.columns}
    return raw.select(*[F.col(f"`{c}`").cast("string").alias(short.get(n, n)) for c, n in names.items() if n not in drop])


# --- schema metadata: (service, slot, possible_values, is_categorical, position) and intents ---------------------------


def slots_of(schema: DataFrame) -> DataFrame:
    """(service, slot, values, is_categorical) of the evaluated services.

    Slots are renamed to plain words; values that say yes, no or free become yes and no; ``dontcare`` is added.
    """
    rows = schema.where(F.col("service_name").isin(*fixed.EVALUATED_SERVICES)).select("service_name", F.explode("slots").alias("s"))
    name = F.regexp_replace(F.regexp_replace("s.name", "^[a-z]+-", ""), "^book(?=[a-z])", "book ")
    values = F.coalesce("s.possible_values", F.expr("cast(array() as array<string>)"))
    parking = (F.size(F.array_except(values, F.array(F.lit("yes"), F.lit("no"), F.lit("free")))) == 0) & F.array_contains(values, "free")
    values = F.when(parking, F.array(F.lit("yes"), F.lit("no"))).otherwise(values)
    return rows.select(F.col("service_name").alias("service"), name.alias("slot"), F.array_union(values, F.array(F.lit("dontcare"))).alias("possible_values"), F.col("s.is_categorical").alias("is_categorical"))


def informable(intents: DataFrame, name: str | None = None) -> DataFrame:
    """(service, slot) that any intent (or the one named) uses, once."""
    some = intents if name is None else intents.where(F.col("intent") == name)
    return some.select("service", F.explode(F.array_union("required", "optional")).alias("slot")).distinct()


def first_intents(intents: DataFrame) -> DataFrame:
    """The first intent (by position) of each service and signature of required and optional slots."""
    signature = F.concat_ws("|", F.array_join(F.array_sort("required"), ","), F.array_join(F.array_sort("optional"), ","))
    return intents.withColumn("_k", F.row_number().over(W.partitionBy("service", signature).orderBy("position"))).where("_k = 1").drop("_k")


def is_numeric(values: Column) -> Column:
    return (F.size(F.filter(values, lambda v: v != "dontcare")) > 0) & F.forall(F.filter(values, lambda v: v != "dontcare"), lambda v: v.rlike(r"^\d+(\.\d+)?$"))


def is_bool(values: Column) -> Column:
    return F.size(F.array_except(values, F.array(*map(F.lit, ("yes", "no", "free", "dontcare"))))) == 0


def slot_rows(slots: DataFrame) -> DataFrame:
    """``slots_of`` rows with what each slot is: categorical, a name, a number, a yes or no, and its type hint."""
    values = F.col("possible_values")
    return slots.select("service", "slot", F.coalesce("is_categorical", F.lit(False)).alias("categorical"), (F.col("slot") == "name").alias("is_name"), is_numeric(values).alias("numeric"), is_bool(values).alias("bool"), type_hint(values).alias("hint"))


def valid_slots(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` (service, slot, ...) with valid: whether the schema has that slot of that service."""
    known = slots.select("service", "slot").distinct().withColumn("valid", F.lit(True))
    return rows.join(known, ["service", "slot"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def type_hint(values: Column) -> Column:
    whole = F.forall(F.filter(values, lambda v: v != "dontcare"), lambda v: v.rlike(r"^\d+$"))
    return F.when(is_numeric(values), F.when(whole, F.lit("int")).otherwise(F.lit("float"))).otherwise(F.lit("str"))


# --- values and aliases -------------------------------------------------------------------------------------------


def known_values(schema_slots: DataFrame, venue_values: DataFrame) -> DataFrame:
    """(service, slot, value): categorical slots from the schema with ``dontcare``, others from the venue tables."""
    listed = schema_slots.where("is_categorical").select("service", "slot", F.explode("possible_values").alias("value"))
    return listed.unionByName(venue_values.select("service", "slot", fuzzy_key(F.col("value")).alias("value"))).distinct()


def canonical(asked: DataFrame, values: DataFrame, least: int = 90) -> DataFrame:
    """``asked`` (id, service, slot, text) with canonical: the known value that the text stands for, or null.

    First the value itself, then another writing of the text that is known (of several the smallest), then the one
    value that is nearest to the text's writings at a ratio of ``least`` or more; if they are nearest to several,
    there is none. Time slots have no list: H:MM becomes HH:MM, and what isn't a time goes. Each distinct text is
    looked up once: writings by the keys that they share, near values by an index of letter pairs.
    """
    text = asked.withColumn("text", F.lower(F.trim("text")))
    timed = F.col("slot").isin(*fixed.TIME_SLOTS)
    padded = F.when(F.col("text").contains(":") & (F.length("text") < 5), F.concat(F.lit("0"), F.col("text"))).otherwise(F.col("text"))
    clock = F.when(is_valid_time(padded) | (padded == "dontcare"), padded)
    distinct = text.where(~timed & F.col("text").isNotNull()).select("service", "slot", "text").distinct()
    key = ["service", "slot", "text"]
    known = values.select("service", "slot", "value").distinct()
    own = distinct.join(known.withColumn("text", F.col("value")), key, "left").withColumnRenamed("value", "exact")
    other = own.where("exact is null").select(*key)
    keyed = other.select(*key, F.explode(key_column(F.col("text"))).alias("key"))
    met = keyed.join(known.select("service", "slot", "value", F.explode(key_column(F.col("value"))).alias("key")), ["service", "slot", "key"]).select(*key, "value").distinct()
    by_writing = met.where(written_column(F.col("text"), F.col("value"))).groupBy(*key).agg(F.min("value").alias("written"))
    rest = other.join(by_writing, key, "left_anti").select(*key, F.explode(writings_column(F.col("text"))).alias("writing"))
    pairs = near_pairs(rest, known, "writing", "value", ["service", "slot"], least)
    best = rest.join(pairs, ["service", "slot", "writing"]).groupBy(*key, "writing").agg(F.min(F.struct((-F.col("score")).alias("s"), "value")).alias("b"))
    near = best.groupBy(*key).agg(F.min("b.value").alias("low"), F.max("b.value").alias("high")).select(*key, F.when(F.col("low") == F.col("high"), F.col("low")).alias("near"))
    found = own.join(by_writing, key, "left").join(near, key, "left").select(*key, F.coalesce("exact", "written", "near").alias("found"))
    return text.join(found, key, "left").select("id", "service", "slot", "text", F.when(timed, clock).otherwise(F.col("found")).alias("canonical"))


def fuzzy_vocabulary(values: DataFrame, vocabulary: DataFrame, least: int = 90) -> DataFrame:
    """(value, match): the vocabulary's only entry near the value after cleaning; null if none or several."""
    own = values.select("value").distinct().withColumn("k", fuzzy_key(F.col("value")))
    entries = vocabulary.select("entry", fuzzy_key(F.col("entry")).alias("e"))
    near = own.join(near_pairs(own, entries, "k", "e", least=least), "k").join(entries, "e")
    hits = near.groupBy("value").agg(F.min("entry").alias("low"), F.max("entry").alias("high"))
    return own.select("value").join(hits, "value", "left").select("value", F.when(F.col("low") == F.col("high"), F.col("low")).alias("match"))


def normalise_states(rows: DataFrame, slots: DataFrame, least: int = 90) -> DataFrame:
    """(id, service, slot, value) -> rows whose service and slot nearly stand in the schema, with its names.

    A categorical value must nearly be one of the possible ones; other values stay as they are. A service that
    keeps no slot stays with a row whose slot and value are null.
    """
    services = fuzzy_vocabulary(rows.select(F.col("service").alias("value")), slots.select(F.col("service").alias("entry")).distinct(), least)
    rows = rows.join(services.select(F.col("value").alias("service"), F.col("match").alias("_s")), "service").where("_s is not null")
    services = rows.select("id", F.col("_s").alias("service")).distinct()
    names = fuzzy_vocabulary(rows.select(F.col("slot").alias("value")), slots.select(F.col("slot").alias("entry")).distinct(), least)
    rows = rows.join(names.select(F.col("value").alias("slot"), F.col("match").alias("_n")), "slot").where("_n is not null")
    rows = rows.select("id", F.col("_s").alias("service"), F.col("_n").alias("slot"), "value").join(slots, ["service", "slot"])
    options = rows.where("is_categorical").select("id", "service", "slot", "value", F.explode("possible_values").alias("option"))
    options = options.withColumn("k", fuzzy_key(F.col("value"))).withColumn("e", fuzzy_key(F.col("option")))
    options = options.join(near_pairs(options, options, "k", "e", ["service", "slot"], least), ["service", "slot", "k", "e"])
    options = options.groupBy("id", "service", "slot", "value").agg(F.min("option").alias("option"))
    free = rows.where("not is_categorical").select("id", "service", "slot", "value")
    kept = options.select("id", "service", "slot", F.col("option").alias("value")).unionByName(free)
    return services.join(kept, ["id", "service"], "left")


def prune_act_keys(entity: Column, valid: list[str]) -> tuple[Column, Column]:
    """(entity with valid keys only, the keys that went)."""
    known = F.array(*map(F.lit, valid))
    return F.map_filter(entity, lambda k, v: F.array_contains(known, k)), F.array_except(F.map_keys(entity), known)


def valid_act_keys(slots: list[str], base: tuple[str, ...]) -> list[str]:
    """The base keys and each slot's name, as words and with underscores."""
    return sorted({*base, *slots, *(s.replace(" ", "_") for s in slots)})
