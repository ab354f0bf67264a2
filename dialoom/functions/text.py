"""Text rules as Column expressions: cleaning, canonical values, placeholders, tokens, encodings."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions import fixed

#: Tokens are what stands between these, in lower case.
TOKEN_GAP = r"[^a-z0-9à-ÿ]+"


def lookup(column: Column, table: dict[str, str]) -> Column:
    """The table's value for the column's, or the column's own."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), column)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda x: x != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, each joined by a space."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.expr("cast(array() as array<string>)"))


def fuzzy_key(x: Column) -> Column:
    """Lower case without ASCII punctuation, trimmed."""
    return F.trim(F.translate(F.lower(x), string.punctuation, ""))


def clean_utterance(x: Column) -> Column:
    """Without line breaks."""
    return F.regexp_replace(x, r"[\r\n]+", "")


def is_valid_time(x: Column) -> Column:
    """H:MM or HH:MM up to 24:59."""
    return x.rlike(r"^([0-1]?\d|2[0-4]):[0-5]\d$")


def minutes(x: Column) -> Column:
    """HH:MM as minutes; anything else is 0."""
    t = F.trim(x)
    parts = F.split(t, ":")
    return F.when(t.rlike(r"^[0-9]?[0-9]:[0-9][0-9]$"), parts[0].cast("int") * 60 + parts[1].cast("int")).otherwise(0)


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def canonical_time(x: Column) -> Column:
    """A written time as HH:MM where a rule applies. A p.m. hour gets 12 more, noon included (12 p.m. becomes 24:00)."""

    def plain(t: Column) -> Column:
        u = F.when(t.startswith("by"), F.substring(t, 4, 1000)).otherwise(t)
        u = _let(u, lambda v: F.when(v.startswith("after"), F.trim(F.substring(v, 6, 1000))).when(v.startswith("afer"), F.trim(F.substring(v, 5, 1000))).otherwise(v))
        u = F.trim(F.regexp_replace(u, r"\s*(am|a\.m\.)$", ""))
        return _let(u, lambda v: F.when(v.rlike(r"(pm|p\.m\.)$"), late(F.trim(F.regexp_replace(v, r"(pm|p\.m\.)$", "")))).otherwise(clock(v)))

    def late(u: Column) -> Column:
        hour = (F.regexp_extract(u, r"^(\d+)", 1).try_cast("int") + 12).cast("string")
        return F.when(u.rlike(r"^\d+:[^:]*$"), F.concat(hour, F.regexp_extract(u, r"(:[^:]*)$", 1))).when(u.rlike(r"^\d+$"), F.concat(hour, F.lit(":00"))).otherwise(clock(u))

    def clock(u: Column) -> Column:
        def shaped(w: Column) -> Column:
            packed = F.when(w.contains(":"), F.replace(w, F.lit(" "), F.lit(""))).otherwise(w)
            return (
                F.when(w == "", F.lit("00:00"))
                .when(w.rlike(r"^\d{4}$"), F.concat(F.substring(w, 1, 2), F.lit(":"), F.substring(w, 3, 2)))
                .when(w.rlike(r"^\d$"), F.concat(F.lit("0"), w, F.lit(":00")))
                .when(w.rlike(r"^\d+$"), F.concat(w, F.lit(":00")))
                .otherwise(F.regexp_replace(packed, r"^(.:..)$", "0$1"))
            )

        return _let(F.regexp_replace(u, r"[.,?]$", ""), shaped)

    def known(t: Column) -> Column:
        out = F.try_element_at(F.create_map(*[F.lit(v) for p in fixed.TIMES.items() for v in p]), t)
        for k, v in fixed.TIME_STARTS.items():
            out = F.coalesce(out, F.when(t.startswith(k), F.lit(v)))
        return F.coalesce(out, plain(t))

    return _let(F.trim(F.lower(x)), known)


def canonical_name(x: Column) -> Column:
    n = F.replace(F.replace(F.trim(F.lower(x)), F.lit(" & "), F.lit(" and ")), F.lit("&"), F.lit(" and "))
    n = F.replace(F.replace(n, F.lit(" '"), F.lit("'")), F.lit("bed and breakfast"), F.lit("b and b"))
    return lookup(n, fixed.NAMES)


def canonical_food(x: Column) -> Column:
    return lookup(F.trim(F.lower(x)), fixed.FOODS)


def canonical_type(x: Column) -> Column:
    return lookup(x, fixed.TYPES)


def canonical_value(slot: Column, value: Column) -> Column:
    """A state value by the rule of its slot; null is the empty text."""
    v = F.coalesce(value, F.lit(""))
    return (
        F.when(slot.isin("name", "destination", "departure"), canonical_name(v))
        .when(slot == "type", canonical_type(v))
        .when(slot == "food", canonical_food(v))
        .when(slot.isin("arrive", "leave", "arriveby", "leaveat", "time"), canonical_time(v))
        .when(slot.isin("parking", "internet") & (v == "free"), F.lit("yes"))
        .otherwise(v)
    )


def slot_token(name: Column) -> Column:
    """A slot name as its evaluation slot; unknown names by the parts they contain, else the empty text."""
    return _let(F.regexp_replace(F.regexp_replace(F.lower(name), r"\d", ""), r"^[_-]+|[_-]+$", ""), _slot_token)


def _slot_token(n: Column) -> Column:
    known = {s: k for k, names in fixed.SLOT_TOKENS.items() for s in names}
    found = F.try_element_at(F.create_map(*[F.lit(x) for p in known.items() for x in p]), n)
    by_part = F.when(F.lit(False), F.lit(""))
    for parts, slot in fixed.SLOT_PARTS:
        holds = F.lit(True)
        for p in parts:
            holds = holds & n.contains(p)
        by_part = by_part.when(holds, F.lit(slot))
    return F.coalesce(found, by_part.otherwise(F.lit("")))


def normalise_response(text: Column) -> Column:
    """Lower case, ``[slot]`` (with a plural ending) as its evaluation slot, without "-s" and "-ly"."""
    gap = r"\[[\w\s]+\](?:es|s|-s|-es)?"
    t = F.lower(text)
    names = F.regexp_extract_all(t, F.lit(f"({gap})"), F.lit(1))
    rest = F.split(t, gap)
    said = F.transform(names, lambda x: slot_token(F.regexp_extract(x, r"^\[([^\]]*)\]", 1)))
    glued = F.array_join(F.transform(F.arrays_zip(rest.alias("rest"), said.alias("said")), lambda z: F.concat(F.coalesce(z["rest"], F.lit("")), F.coalesce(z["said"], F.lit("")))), "")
    return F.regexp_replace(F.replace(F.replace(glued, F.lit("-s"), F.lit("")), F.lit("-ly"), F.lit("")), " +", " ")


def placeholder(slot: Column, evaluation: bool = False) -> Column:
    """``[value_<slot>]``; in evaluation by its other names, some without prefix."""
    if not evaluation:
        return F.concat(F.lit("[value_"), F.replace(slot, F.lit(" "), F.lit("_")), F.lit("]"))
    name = F.replace(slot, F.lit("_"), F.lit(" "))
    return F.when(name.isin(*fixed.UNPREFIXED), F.concat(F.lit("["), name, F.lit("]"))).otherwise(F.concat(F.lit("[value_"), lookup(name, fixed.PLACEHOLDERS), F.lit("]")))


def schema_slot(slot: Column, service: Column) -> Column:
    """A written slot as the schema's: by its service's names, then by the general ones."""
    own = {f"{s}\t{k}": v for s, names in fixed.SERVICE_SLOTS.items() for k, v in names.items()}
    first = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in own.items() for x in p]), F.concat_ws("\t", service, slot)), slot)
    return lookup(first, fixed.SLOTS)


def is_schema_slot(slot: Column) -> Column:
    """Whether the schema's vocabulary has a slot."""
    return slot.isin(*fixed.SCHEMA_SLOTS)


def prompt_slot(slot: Column) -> Column:
    """Trimmed, and ``bookX`` as ``book X``."""
    return F.regexp_replace(F.trim(slot), r"^book(\S)", "book $1")


def database_slot(slot: Column) -> Column:
    s = F.replace(F.lower(slot), F.lit(" "), F.lit(""))
    return lookup(s, {"arriveby": "arrive", "leaveat": "leave"})


def normalise_value(text: Column) -> Column:
    """A free value: lower case, spelling of a few words, spacing of marks, joined numbers, fixed replacements."""
    t = F.trim(F.lower(text))
    t = F.regexp_replace(t, "b&b|b and b", "bed and breakfast")
    t = F.regexp_replace(t, "guesthouse", "guest house")
    t = F.regexp_replace(t, r'["<>@()]', "")
    t = F.regexp_replace(t, r"(?<!\d)([?.,!])|([?.,!])(?!\d)", " $1$2 ")
    t = F.regexp_replace(t, r"'s", " 's ")
    t = F.regexp_replace(F.regexp_replace(t, r"^'|'$", ""), r"'\s|\s'", " ")
    t = F.trim(F.regexp_replace(t, " +", " "))
    t = F.regexp_replace(t, r"(?<=\d) (?=\d+(?: |$))", "")
    t = F.regexp_replace(F.regexp_replace(t, r" s ", "s "), r" s$", "s")
    return lookup(t, fixed.TEXT_VALUES)


def state_text(state: Column) -> Column:
    """A state as a sentence for each service, blank values left out: for hotel, the area is west, stars is 3 ."""
    said = lambda slots: F.array_join(F.transform(F.filter(F.map_entries(slots), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(" is "), e["value"])), ", ")
    each = F.filter(F.transform(F.map_entries(state), lambda s: F.struct(s["key"].alias("service"), said(s["value"]).alias("said"))), lambda x: x["said"] != "")
    return F.coalesce(F.array_join(F.transform(each, lambda x: F.concat(F.lit("for "), x["service"], F.lit(", the "), x["said"], F.lit(" ."))), " "), F.lit(""))


def encode_turn(context: Column, system: Column, user: Column) -> Column:
    """What a turn is retrieved by: context, the system's utterance (no line's text if it says ``none``), the user's."""
    none = F.lit("")
    system = F.when(F.coalesce(system, F.lit("none")) == "none", none).otherwise(F.concat(F.lit("System: "), system))
    return F.concat(F.lit("Context: "), F.coalesce(context, none), F.lit("\n"), system, F.lit("\nUser: "), F.coalesce(user, none))


def retrieval_input(kind: str, state: Column, system: Column, user: Column, response: Column) -> Column:
    """A turn's text by one of three formats: ``context_system_user``, ``response``, ``user_response``."""
    if kind == "context_system_user":
        return encode_turn(state_text(state), system, user)
    if kind == "response":
        return response
    if kind == "user_response":
        return F.concat(F.lit("User: "), F.coalesce(user, F.lit("")), F.lit("\nSystem: "), F.coalesce(response, F.lit("")))
    raise ValueError(f"no such format: {kind}")


def short_hash(text: Column) -> Column:
    """The first 12 characters of the URL-safe base-64 form of the text's SHA-256."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(text, 256))), "+/", "-_"), 1, 12)


def portable_order(key: Column, seed: int = 42) -> Column:
    """A hash that other engines compute too; ordering by it is a seeded shuffle."""
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8)


def result_summary(labels: Column, most: int = 3) -> Column:
    """How many results a query had, and the first few."""
    some = F.array_join(F.slice(labels, 1, most), ", ")
    return F.concat(F.lit("num_results="), F.size(labels).cast("string"), F.lit(" ["), some, F.when(F.size(labels) > most, F.lit(", ...")).otherwise(F.lit("")), F.lit("]"))
