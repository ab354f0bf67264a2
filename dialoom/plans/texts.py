"""Queries of text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.functions import fixed
from dialoom.functions import text as X
from dialoom.functions.fuzzy import partial_column, ratio_column
from dialoom.operators import rewrite as D


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("token_counts", "select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), lambda x: x <> ''))::bigint as tokens from documents")
def token_counts(spark, sf_dir):
    """2.14: tokens."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("tokens"))


@register("fuzzy_keys", "select p_partkey, trim(translate(lower(p_brand || '  (' || p_type || ')!'), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')) as key from part")
def fuzzy_keys(spark, sf_dir):
    """Texts without case and punctuation."""
    return _read(spark, sf_dir, "part").select("p_partkey", X.fuzzy_key(F.concat("p_brand", F.lit("  ("), "p_type", F.lit(")!"))).alias("key"))


@register("clock_minutes", """
with t as (select event_id, (event_id % 27)::varchar || ':' || lpad((event_id % 61)::varchar, 1 + (event_id % 2)::int, '0') as t from events)
select event_id, case when regexp_full_match(t, '[0-9]?[0-9]:[0-9][0-9]') then split_part(t, ':', 1)::bigint * 60 + split_part(t, ':', 2)::bigint else 0 end as minutes from t
""")
def clock_minutes(spark, sf_dir):
    """Times as minutes, anything else as 0."""
    e = _read(spark, sf_dir, "events")
    n = (F.col("event_id") % 61).cast("string")
    t = F.concat((F.col("event_id") % 27).cast("string"), F.lit(":"), F.when(F.col("event_id") % 2 == 0, F.substring(n, 1, 1)).otherwise(F.lpad(n, 2, "0")))
    return e.select("event_id", X.minutes(t).cast("long").alias("minutes"))


@register("canonical_times", """
with t as (select event_id, event_id % 12 + 1 as h, event_id % 5 as k from events)
select event_id, case k when 0 then (h + 12)::varchar || ':00' when 1 then lpad(h::varchar, 2, '0') || ':00' when 2 then '12:00' when 3 then lpad(h::varchar, 2, '0') || ':05' else (h + 12)::varchar || ':15' end as time from t
""")
def canonical_times(spark, sf_dir):
    """Written times."""
    e = _read(spark, sf_dir, "events")
    h, k = (F.col("event_id") % 12 + 1).cast("string"), F.col("event_id") % 5
    said = F.when(k == 0, F.concat(h, F.lit(" pm"))).when(k == 1, F.concat(F.lit("after "), h, F.lit(" am"))).when(k == 2, F.lit(" Noon ")).when(k == 3, F.concat(F.lit("by "), h, F.lit(":05"))).otherwise(F.concat(h, F.lit(":15 p.m.")))
    return e.select("event_id", X.canonical_time(said).alias("time"))


def _pick(items: list[str], by):
    """The item whose number is ``by`` modulo their count."""
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(by, F.lit(len(items))) + 1).cast("int"))


def _sql(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _picked(items, by: str) -> str:
    return f"({_sql(items)})[{by} % {len(items)} + 1]"


_RULES = [*((k, v, "food") for k, v in fixed.FOODS.items()), *((k, v, "name") for k, v in fixed.NAMES.items()), *((k, v, "type") for k, v in fixed.TYPES.items())]


@register("canonical_slots", f"""
select event_id, case event_id % 4 when 0 then {_picked([v for _, v, _ in _RULES], 'event_id // 4')} when 1 then 'no ' || json_extract_string(props, '$.k') || ' and sons'
       when 2 then case when json_extract_string(props, '$.k')::int % 2 = 0 then 'yes' else 'k' || json_extract_string(props, '$.k') end else event_type || chr(39) || 's b and b' end as value from events
""")
def canonical_slots(spark, sf_dir):
    """Values by the rule of their slots: all listed spellings, and unlisted names, parking, and punctuation."""
    e = _read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    r, i = F.col("event_id") % 4, F.floor(F.col("event_id") / 4)
    slot = F.when(r == 0, _pick([x for _, _, x in _RULES], i)).when(r == 2, F.lit("parking")).otherwise(F.lit("name"))
    even = F.col("k").cast("int") % 2 == 0
    value = (
        F.when(r == 0, F.when(slot == "type", _pick([k for k, _, _ in _RULES], i)).otherwise(F.concat(F.lit(" "), F.initcap(_pick([k for k, _, _ in _RULES], i)))))
        .when(r == 1, F.concat(F.lit("No "), F.col("k"), F.lit(" & Sons ")))
        .when(r == 2, F.when(even, F.lit("free")).otherwise(F.concat(F.lit("k"), F.col("k"))))
        .otherwise(F.concat("event_type", F.lit(" 's bed and breakfast")))
    )
    return e.select("event_id", X.canonical_value(slot, value).alias("value"))


_TOKENS = [(s, k) for k, names in fixed.SLOT_TOKENS.items() for s in names]


@register("slot_tokens", f"""
select event_id, case event_id % 3 when 0 then {_picked([k for _, k in _TOKENS], 'event_id // 3')}
       when 1 then {_picked([k for _, k in fixed.SLOT_PARTS], 'event_id // 3')} else '' end as token from events
""")
def slot_tokens(spark, sf_dir):
    """Slot names in evaluation: all listed names, all known parts in other names, and unknown names."""
    r, i = F.col("event_id") % 3, F.floor(F.col("event_id") / 3)
    part = _pick(["zz" + "qq".join(p) + "xx" for p, _ in fixed.SLOT_PARTS], i)
    name = F.when(r == 0, F.concat(F.lit("_"), F.upper(_pick([n for n, _ in _TOKENS], i)), F.lit("2-"))).when(r == 1, part).otherwise(F.concat(F.lit("x"), F.get_json_object("props", "$.k")))
    return _read(spark, sf_dir, "events").select("event_id", X.slot_token(name).alias("token"))


@register("normalised_responses", f"""
select conv_id, turn, regexp_replace(replace(replace('the ' || {_picked([k for _, k in _TOKENS], '(conv_id * 31 + turn)')} || ' is ' || lower(text), '-s', ''), '-ly', ''), ' +', ' ', 'g') as response
from conversations where not regexp_matches(text, '[\\[\\]]')
""")
def normalised_responses(spark, sf_dir):
    """Slots in responses of which the rest is a turn's text."""
    c = _read(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"[\[\]]"))
    name = _pick([n for n, _ in _TOKENS], F.col("conv_id") * 31 + F.col("turn"))
    return c.select("conv_id", "turn", X.normalise_response(F.concat(F.lit("The ["), name, F.lit("]s is "), F.col("text"))).alias("response"))


_PLACED = [*fixed.PLACEHOLDERS, *fixed.UNPREFIXED, "area", "name", "book ref"]


@register("placeholders", f"""
with p as (select p_partkey, {_picked(_PLACED, 'p_partkey')} as slot, {_picked([fixed.PLACEHOLDERS.get(s, s) for s in _PLACED], 'p_partkey')} as other from part)
select p_partkey, case when slot in {tuple(fixed.UNPREFIXED)} then '[' || slot || ']' else '[value_' || other || ']' end as eval, '[value_' || replace(slot, ' ', '_') || ']' as plain from p
""")
def placeholders(spark, sf_dir):
    """Placeholders of all slots with another name, and of some without."""
    slot = _pick(_PLACED, F.col("p_partkey"))
    return _read(spark, sf_dir, "part").select("p_partkey", X.placeholder(slot, True).alias("eval"), X.placeholder(slot).alias("plain"))


_NAMED = [s.replace(" ", "_") for s in _PLACED]
_NAMES = [f"[{s}]" if s in fixed.UNPREFIXED else f"[value_{fixed.PLACEHOLDERS.get(s, s)}]" for s in _PLACED]


@register("fixed_placeholders", f"""
select p_partkey, p_name || ' ' || {_picked(_NAMES, 'p_partkey')} || ' [x ' || {_picked(_NAMES, '(p_partkey // 7)')} || ']' as text from part
""")
def fixed_placeholders(spark, sf_dir):
    """D3: placeholders that a text already has, with and without prefix."""
    one, two = _pick(_NAMED, F.col("p_partkey")), _pick(_NAMED, F.floor(F.col("p_partkey") / 7))
    text = F.concat("p_name", F.lit(" ["), one, F.lit("] [x [value_"), two, F.lit("]]"))
    return _read(spark, sf_dir, "part").select("p_partkey", D.fix_placeholders(text).alias("text"))


@register("span_delex", """
with t as (select item_id, text, strpos(text, ' ') as a, strpos(text, '. ') as b, length(text) as n from benchmark),
s as (select *, case when b > a + 1 then b else 0 end as c from t)
select item_id, case when a > 1 then '[first]' else substr(text, 1, greatest(a, 0)) end || case when c > 0 then substr(text, greatest(a, 1), c - greatest(a, 1)) || '[stop]' || substr(text, c + 1) else substr(text, greatest(a, 1)) end as text from s
""")
def span_delex(spark, sf_dir):
    """Annotated spans, joined by turn, replaced: the first word, and the first full stop; one that overlaps and ``dontcare`` stay."""
    b = _read(spark, sf_dir, "benchmark")
    gap, stop = F.instr("text", " "), F.instr("text", ". ")
    span = lambda slot, value, a, z: F.struct(F.lit(slot).alias("slot"), F.lit(value).alias("value"), a.cast("int").alias("start"), z.cast("int").alias("stop"))
    found = F.filter(F.array(
        F.when(stop > gap + 1, span("stop", "x", stop - 1, stop)), F.when(gap > 1, span("first", "x", F.lit(0), gap - 1)),
        F.when(gap > 3, span("inside", "x", F.lit(1), gap - 2)), span("last", "dontcare", F.length("text") - 2, F.length("text")),
    ), lambda x: x.isNotNull())
    spans = b.select("item_id", F.explode(found).alias("span")).select("item_id", "span.*")
    return D.with_spans(b.select("item_id", "text"), spans, "item_id").select("item_id", "text")


@register("fuzzy_delex")
def fuzzy_delex(spark, sf_dir):
    """Values become placeholders: two words of a turn's text without a letter, and its last word."""
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.split("text", " ").alias("w"))
    at = (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.greatest(F.lit(1), F.size("w") - 1)) + 1).cast("int")
    two = F.concat_ws(" ", F.try_element_at("w", at), F.try_element_at("w", at + 1))
    entity = F.create_map(F.lit("name"), F.concat(F.substring(two, 1, 3), F.substring(two, 5, 1000)), F.lit("area"), F.element_at("w", -1))
    act = F.struct(F.lit("Inform").alias("type"), F.lit("hotel").alias("service"), entity.alias("entity"), F.expr("cast(null as array<string>)").alias("values"))
    return c.select("conv_id", "turn", D.delexicalised(F.col("text"), F.array(act)).alias("text"))


@register("fuzzy_ratios")
def fuzzy_ratios(spark, sf_dir):
    """4.3, N2: ratios of each part's name with its type and its brand, and partial ratios with the next part's name."""
    p = _read(spark, sf_dir, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    both = p.join(after, "p_partkey").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"), F.lower("p_brand").alias("c"), "other")
    return both.select("p_partkey", ratio_column("a", "b").cast("long").alias("type"), ratio_column("a", "c").cast("long").alias("brand"), partial_column("a", "other").cast("long").alias("next"))


_WRITTEN = [*((s, k, v) for s, names in fixed.SERVICE_SLOTS.items() for k, v in names.items()), *(("hotel", k, v) for k, v in fixed.SLOTS.items()), ("train", "food", "food"), ("hotel", "time", "time")]


@register("schema_slots", f"""
select p_partkey, {_picked([v for *_, v in _WRITTEN], 'p_partkey')} as slot, {_picked([v for *_, v in _WRITTEN], 'p_partkey')} in {tuple(fixed.SCHEMA_SLOTS)} as known from part
""")
def schema_slots(spark, sf_dir):
    """All written slots as the schema's, and whether the schema has them."""
    service, slot = _pick([s for s, _, _ in _WRITTEN], F.col("p_partkey")), _pick([k for _, k, _ in _WRITTEN], F.col("p_partkey"))
    got = X.schema_slot(slot, service)
    return _read(spark, sf_dir, "part").select("p_partkey", got.alias("slot"), X.is_schema_slot(got).alias("known"))


@register("result_summaries", """
select s_nationkey::bigint as nation, 'num_results=' || count(*) || ' [' || array_to_string(list(s_name order by s_name)[1:3], ', ') || case when count(*) > 3 then ', ...' else '' end || ']' as summary from supplier group by s_nationkey
""")
def result_summaries(spark, sf_dir):
    """A query's results in short."""
    s = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.array_sort(F.collect_list("s_name")).alias("n"))
    return s.select("nation", X.result_summary(F.col("n")).alias("summary"))


@register("page_titles", "select page_id, lower(split_part(url, '/', 3)) as host, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>'))::bigint as tags from pages")
def page_titles(spark, sf_dir):
    """2.14: splitting and pattern extraction."""
    p = _read(spark, sf_dir, "pages")
    return p.select("page_id", F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"), F.size(F.regexp_extract_all("html", F.lit("(<[a-zA-Z][^>]*>)"), F.lit(1))).cast("long").alias("tags"))
