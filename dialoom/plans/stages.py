"""Queries of stage inputs, prompts, references, and near matching against a schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.functions import text as X
from dialoom.operators import acts as A
from dialoom.operators import candidates as C
from dialoom.operators import evaluation
from dialoom.operators import lookup as L
from dialoom.operators import prompts as P
from dialoom.operators import stages as G
from dialoom.operators import state as S
from dialoom.operators.folds import judged
from dialoom.operators.metrics import rates
from dialoom.plans.states import snapshots
from dialoom.sources.tables import dealt


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))


def _one(service, slot, value):
    return F.create_map(F.lit(service), F.create_map(F.lit(slot), value))


_STATES = """
with e as (
  select user_id, event_id, ts, event_type, case when coalesce(json_extract_string(props, '$.k'), '')::int % 5 = 0 then '' else json_extract_string(props, '$.k') end as k, floor(value)::bigint::varchar as v from events
), s as (select *, lag(event_type) over w as pt, lag(k) over w as pk, lag(v) over w as pv from e window w as (partition by user_id order by ts, event_id)),
a as (select event_id, event_type as service, 'k' as slot, k as value from s where k <> '' union all select event_id, event_type, 'v', v from s where v <> ''),
b as (select event_id, pt as service, 'k' as slot, pk as value from s where pk <> '' union all select event_id, pt, 'v', pv from s where pv <> ''),
d as (select event_id, service, slot, coalesce(a.value, '[DELETE]') as value from b full join a using (event_id, service, slot) where a.value is distinct from b.value)
"""


@register("intent_calls", _STATES + """
, own as (select event_id, list(slot order by slot) as slots, string_agg(slot || '="' || value || '"', ', ' order by slot) as args from d where service = 'click' group by event_id),
other as (select event_id, list(slot order by slot) as slots, string_agg(slot || '="' || value || '"', ', ' order by slot) as args from d where service = 'view' group by event_id),
any_ as (select distinct event_id from d)
select s.event_id, case when any_.event_id is null then 'agent.no_change()' when own.slots = ['k'] then 'find_click(' || own.args || ')' when other.args is not null then 'find_view(' || other.args || ')' when own.args is not null then 'book_click(' || own.args || ')' end as call
from s left join own using (event_id) left join other using (event_id) left join any_ using (event_id)
""")
def intent_calls(spark, sf_dir):
    """A10: the call that an event's change of state stands for: the first intent whose slots hold the changed ones."""
    s = snapshots(spark, sf_dir)
    delta = S.compute_delta(F.col("before"), F.col("after"))
    intents = [("find_click", "click", ["k"]), ("find_view", "view", ["k", "v"]), ("book_click", "click", ["k", "v"])]
    return s.select("event_id", A.intent_call(delta, intents).alias("call"))


@register("delta_acts", _STATES + "select event_id, 'Inform' as act, service, slot, value from d")
def delta_acts(spark, sf_dir):
    """An event's change of state as informing acts."""
    s = snapshots(spark, sf_dir).select("event_id", A.acts_of_delta(S.compute_delta(F.col("before"), F.col("after"))).alias("acts"))
    return A.tuples(s, "acts", "event_id").where("slot is not null")


@register("canonical_calls", _STATES + """
select s.event_id, case when s.k = '' or s.pt = 'click' and s.pk = s.k then 'agent.no_change()' else 'find_click(k="' || s.k || '")' end as call from s where s.event_type = 'click' and s.pt = 'click'
""")
def canonical_calls(spark, sf_dir):
    """Completions read, brought to the schema's slot names, and rendered as the call of the change that they make."""
    s = snapshots(spark, sf_dir).where(F.map_contains_key("before", F.lit("click")) & F.map_contains_key("after", F.lit("click")))
    k = F.col("after")["click"]["k"]
    text = F.when(k == "", F.lit("no_change()]")).otherwise(F.concat(F.lit("find_click(the_k='"), k, F.lit("')")))
    prior = S.remove_blank_values(F.transform_values("before", lambda _, m: F.map_filter(m, lambda x, _: x == "k")))
    return s.select("event_id", C.canonical_completion(text, prior, [("find_click", "click", ["k"])], S.remove_blank_values, {"click": {"the k": "k"}}).alias("call"))


@register("value_mentions", """
with v as (select p_partkey, lower(p_type || ' ' || p_name || ' of ' || p_brand) as s, case p_partkey % 4 when 0 then lower(p_name) when 1 then substr(lower(p_name), 1, 3) || 'q' || substr(lower(p_name), 6) when 2 then 'x' || lower(p_brand) when 3 then replace(lower(p_name), ' ', 'xyz') end as v from part),
m as (select *, length(v) as n, case when length(v) < 6 then 1 else 2 end as most from v),
w as (select p_partkey, most, v, unnest(list_transform(range(1, greatest(1, length(s) - n - k + 1) + 1), lambda i: substr(s, i, n + k))) as w from m, (values (-1), (0), (1), (2)) t(k))
select p_partkey, bool_or(levenshtein(w, v) <= most) as mentioned from w group by p_partkey
""")
def value_mentions(spark, sf_dir):
    """Whether an utterance says a value nearly: a part's name as it is, with letters changed or put in, and its brand with one more."""
    p = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_name", "p_brand"), "p_partkey").withColumn("n", F.lower("p_name"))
    k = F.col("p_partkey") % 4
    value = F.when(k == 0, F.col("n")).when(k == 1, F.concat(F.substring("n", 1, 3), F.lit("q"), F.substring("n", 6, 1000))).when(k == 2, F.concat(F.lit("x"), F.lower("p_brand"))).otherwise(F.replace("n", F.lit(" "), F.lit("xyz")))
    return p.select("p_partkey", S.mentions(F.concat_ws(" ", "p_type", "p_name", F.lit("of"), "p_brand"), value).alias("mentioned"))


@register("value_references", """
with p as (select p_partkey, lower(p_name) as name, p_size::varchar as people, case p_partkey % 5 when 0 then lower(p_name) when 1 then 'Cold Widget' when 2 then p_size::varchar when 3 then 'dontcare' else lower(p_name) end as value,
  p_partkey % 5 = 2 as literal, case when p_partkey % 5 = 4 then 'at ' || p_name || ' then' else 'for ' || (p_size % 4) || ' there' end as said from part)
select p_partkey, case when value = 'dontcare' then null when literal then case when not contains(' ' || said || ' ', ' ' || value || ' ') then 'train.people' end
  when p_partkey % 5 <> 4 and lower(value) = name then 'hotel.name' end as ref from p
""")
def value_references(spark, sf_dir):
    """Which other slot a value refers to: by the state's values, unless the turn says the value itself."""
    p = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size"), "p_partkey").withColumn("name", F.lower("p_name")).withColumn("people", F.col("p_size").cast("string"))
    k = F.col("p_partkey") % 5
    state = F.create_map(F.lit("hotel"), F.create_map(F.lit("name"), F.col("p_name")), F.lit("train"), F.create_map(F.lit("people"), F.col("people")))
    value = F.when(k == 1, F.lit("Cold Widget")).when(k == 2, F.col("people")).when(k == 3, F.lit("dontcare")).otherwise(F.col("name"))
    slot = F.when(k == 2, F.lit("people")).otherwise(F.lit("destination"))
    said = F.when(k == 4, F.concat(F.lit("at "), F.col("p_name"), F.lit(" then"))).otherwise(F.concat(F.lit("for "), (F.col("p_size") % 4).cast("string"), F.lit(" there")))
    return p.select("p_partkey", S.reference_of(state, F.lit("taxi"), slot, value, said, k == 2).alias("ref"))


@register("normalised_states", """
with e as (select event_id as id, ['hotel', 'hotel', 'restaurant', null][event_id % 4 + 1] as service, ['area', 'name', 'price range', null][user_id % 4 + 1] as slot, json_extract_string(props, '$.k')::int as k from events),
v as (select *, case when slot = 'name' then 'k' || k when k % 3 = 0 then case when slot = 'area' then 'centre' else 'cheap' end when k % 3 = 1 and slot = 'area' then 'east' end as value from e)
select id, service, case when value is not null and (service = 'hotel' or slot = 'price range') then slot end as slot, case when slot is not null and (service = 'hotel' or slot = 'price range') then value end as value from v where service is not null
""")
def normalised_states(spark, sf_dir):
    """Near service, slot and value names by the schema; what no name or option is near goes, services stay."""
    e = _events(spark, sf_dir)
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (by + 1).cast("int"))
    k, slot = F.col("k").cast("int"), pick(("area:", "Name", "price-range", "colour"), F.col("user_id") % 4)
    value = F.when(slot == "Name", F.concat(F.lit("k"), F.col("k"))).when(k % 3 == 0, F.when(slot == "area:", F.lit("Centre!")).otherwise(F.lit("cheapp"))).when(k % 3 == 1, F.lit("East ")).otherwise(F.concat(F.lit("q"), F.col("k")))
    rows = e.select(F.col("event_id").alias("id"), pick(("Hotels", "hotel.", "Restaurant", "submarine"), F.col("event_id") % 4).alias("service"), slot.alias("slot"), value.alias("value"))
    slots = spark.createDataFrame([("hotel", "area", ["centre", "east"], True), ("hotel", "name", [], False), ("hotel", "price range", ["cheap", "dear"], True), ("restaurant", "price range", ["cheap", "dear"], True)], "service string, slot string, possible_values array<string>, is_categorical boolean")
    return L.normalise_states(rows, slots)


_KEYS = (["name", "book_day", "service_name", "area"], ["values", "book day", "price_range"])


@register("pruned_acts", f"""
with e as (select event_id, [({_KEYS[0]})[event_id % 4 + 1], ({_KEYS[1]})[event_id % 3 + 1]] as ks from events)
select event_id, array_to_string(list_sort(list_filter(ks, lambda k: list_contains(['name', 'book_day', 'book day', 'values'], k))), ',') as kept,
       array_to_string(list_filter(ks, lambda k: not list_contains(['name', 'book_day', 'book day', 'values'], k)), ',') as gone from e
""")
def pruned_acts(spark, sf_dir):
    """Act keys that aren't valid, of two keys that vary by event."""
    valid = L.valid_act_keys(["book day", "name"], ("service", "entity", "values"))
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("event_id") % len(items) + 1).cast("int"))
    kept, gone = L.prune_act_keys(F.create_map(pick(_KEYS[0]), F.col("k"), pick(_KEYS[1]), F.col("k")), valid)
    return _events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept"), F.array_join(gone, ",").alias("gone"))


@register("normalised_values", "select p_partkey, case p_size % 3 when 0 then 'centre' when 1 then 'acorn guest house ' || p_size else 'saturday' end as value from part")
def normalised_values(spark, sf_dir):
    """Free values."""
    k = F.col("p_size") % 3
    v = F.when(k == 0, F.lit(" Center ")).when(k == 1, F.concat(F.lit("Acorn Guesthouse  "), F.col("p_size").cast("string"))).otherwise(F.lit("(sat)"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", X.normalise_value(v).alias("value"))


@register("stage_inputs", """
with t as (select conv_id, turn, role, length(text) % 3 as n, lag(length(text) % 3) over (partition by conv_id order by turn) as before, md5(text) as said from conversations),
s as (select * from (values ('act_tag', 9), ('dst', 6), ('policy', 6), ('response', 6)) v(stage, columns))
select conv_id, turn, stage, columns::bigint as columns, said as user, case when stage = 'act_tag' and before is distinct from n then n::varchar end as change,
       case when stage = 'act_tag' then said end as response from t, s
""")
def stage_inputs(spark, sf_dir):
    """What each of the four stages sees of a turn: its columns, the user's words, and, in act tagging, the change of the state and the response."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = (F.length("text") % 3).cast("string")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("n", n).withColumn("before", F.lag("n").over(w))
    state = lambda v: F.when(v.isNull(), S.empty()).otherwise(F.create_map(F.lit("hotel"), F.create_map(F.lit("area"), v)))
    none = F.expr("cast(array() as array<string>)")
    t = c.select(
        F.struct("conv_id", "turn").alias("dialogue_id"), F.col("turn").alias("turn_id"), F.array(F.md5("text")).alias("user_utterances"), none.alias("system_utterances"), state(F.col("n")).alias("slot_values"),
        state(F.col("before")).alias("last_slot_values"), none.alias("last_system_response_acts"), none.alias("system_response_acts"), F.md5("text").alias("system_response"),
    )
    out = None
    for stage in G.VISIBLE:
        seen = G.visible(t, stage)
        has = lambda c, of, seen=seen: of if c in seen.columns else F.lit(None).cast("string")
        rows = seen.select("dialogue_id.*", F.lit(stage).alias("stage"), F.lit(len(seen.columns)).cast("long").alias("columns"), F.col("user_utterances")[0].alias("user"), has("turn_slot_values", F.try_element_at(F.try_element_at("turn_slot_values", F.lit("hotel")), F.lit("area")) if "turn_slot_values" in seen.columns else None).alias("change"), has("system_response", F.col("system_response")).alias("response"))
        out = rows if out is None else out.unionByName(rows)
    return out


_LITERAL = "replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't')"


@register("stage_prompts", f"""
with c as (select conv_id, turn, role, '"' || {_LITERAL} || '"' as said from conversations),
s as (select *, lag(said) over w as before, lag(said, 2) over w as second, lag(said, 3) over w as third from c window w as (partition by conv_id order by turn))
select conv_id, turn, md5('# say it' || repeat(chr(10), 2) || case when third is null then '' else '    # Example 1' || chr(10) || '    response = agent.handle_turn(' || chr(10) || '        system_response=' || third || ',' || chr(10) || '        system_acts=[]' || chr(10) || '    )' || repeat(chr(10), 2) end
  || '    # Example ' || case when third is null then 1 else 2 end || chr(10) || '    response = agent.handle_turn(' || chr(10) || '        system_response=' || coalesce(before, 'None') || ',' || chr(10) || '        system_acts=[') as prompt from s
""")
def stage_prompts(spark, sf_dir):
    """Prompts of act tagging: a solved example where there is one, and the turn before."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("before", F.lag("text").over(w)).withColumn("third", F.lag("text", 3).over(w))
    none = F.expr("cast(array() as array<struct<system_response: string, system_acts: string>>)")
    examples = F.when(F.col("third").isNotNull(), F.array(F.struct(F.col("third").alias("system_response"), F.lit("[]").alias("system_acts")))).otherwise(none)
    return c.select("conv_id", "turn", F.md5(P.prompt("non_causal_sys_act_resp_only", {"system_response": F.col("before")}, examples, "# say it")).alias("prompt"))


#: Of a turn's neighbours: the arguments of all modes, as columns and in SQL.
_ARGUMENTS = {
    "belief_state": """'{"' || role || '": ' || turn || '}'""",
    "last_system_utterance": "before",
    "user_utterance": "said",
    "user_intent": """'[agent.find(' || turn || ')]'""",
    "system_response": "after",
    "system_acts": """'[Inform(' || turn % 3 || ')]'""",
    "history": """'["' || turn || '"]'""",
}
_TURNS = f"""
with c as (select conv_id, turn, role, '"' || {_LITERAL} || '"' as text from conversations),
s as (select conv_id, turn, role, coalesce(text, 'None') as said, coalesce(lag(text) over w, 'None') as before, coalesce(lead(text) over w, 'None') as after from c window w as (partition by conv_id order by turn))
"""


def _prompt_sql(mode: str, target: str, prefix: str) -> str:
    names = P.MODES[mode][: P.MODES[mode].index(target)]
    said = "".join(f" || chr(10) || '        {k}=' || ({_ARGUMENTS[k]}) || ','" for k in names)
    return f"'# do' || chr(10) || chr(10) || '    # Example 1' || chr(10) || '    response = agent.handle_turn('{said} || chr(10) || '        {target}={prefix}'"


#: mode -> (what inference predicts, its prefix, what training completes, its prefix), stated apart from the operator.
_TARGETS = {
    "causal_dst": ("user_intent", "[agent.", "user_intent", "[agent."),
    "noisy_channel_dst": ("user_intent", "[agent.", "user_utterance", ""),
    "non_causal_sys_act_resp_only": ("system_acts", "[", "system_acts", "["),
    "non_causal_sys_act_resp_only_noisy_channel": ("system_acts", "[", "system_response", ""),
    "causal_sys_act_policy_from_hist": ("system_acts", "[", "system_acts", "["),
    "causal_sys_act_policy_simple": ("system_acts", "[", "system_acts", "["),
    "response_gen_simple": ("system_response", "", "system_response", ""),
}


def _arguments(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("before", F.lag("text").over(w)).withColumn("after", F.lead("text").over(w))
    turn = F.col("turn").cast("string")
    return c, {
        "belief_state": F.concat(F.lit('{"'), "role", F.lit('": '), turn, F.lit("}")), "last_system_utterance": F.col("before"), "user_utterance": F.col("text"),
        "user_intent": F.concat(F.lit("[agent.find("), turn, F.lit(")]")), "system_response": F.col("after"),
        "system_acts": F.concat(F.lit("[Inform("), (F.col("turn") % 3).cast("string"), F.lit(")]")), "history": F.concat(F.lit('["'), turn, F.lit('"]')),
    }


@register("mode_prompts", _TURNS + " union all ".join(f"select conv_id, turn, '{m}' as mode, md5({_prompt_sql(m, target, prefix)}) as prompt from s" for m, (target, prefix, _, _) in _TARGETS.items()))
def mode_prompts(spark, sf_dir):
    """Each turn's prompt in all seven modes; a noisy channel asks for the code before the text."""
    c, arguments = _arguments(spark, sf_dir)
    prompts = F.array(*[F.struct(F.lit(m).alias("mode"), F.md5(P.prompt(m, arguments, preamble="# do")).alias("prompt")) for m in P.MODES])
    return c.select("conv_id", "turn", F.explode(prompts).alias("p")).select("conv_id", "turn", "p.*")


@register("mode_pairs", _TURNS + " union all ".join(f"select conv_id, turn, '{m}' as mode, md5({_prompt_sql(m, target, prefix)}) as prompt, md5(substr({_ARGUMENTS[target]}, {len(prefix) + 1})) as completion from s" for m, (_, _, target, prefix) in _TARGETS.items()))
def mode_pairs(spark, sf_dir):
    """G14, 2.18: training pairs of all turns in all seven modes; no mode loses a turn."""
    c, arguments = _arguments(spark, sf_dir)
    pairs = [P.training_pairs(c, m, arguments, "# do", ("conv_id", "turn")).withColumn("mode", F.lit(m)) for m in P.MODES]
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.select("conv_id", "turn", "mode", F.md5("prompt").alias("prompt"), F.md5("completion").alias("completion"))


@register("prompt_histories", """
with c as (select conv_id, turn, role, text from conversations)
select conv_id, turn, (select array_to_string(list(h.text order by h.turn), '|') from c h where h.conv_id = c.conv_id and h.turn <= c.turn and h.turn > c.turn - 5) as history from c
where turn % 2 = 0 and (select count(*) from c h where h.conv_id = c.conv_id and h.turn < c.turn) = turn
""")
def prompt_histories(spark, sf_dir):
    """The last five utterances of both sides at each user turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("pair", F.floor((F.col("turn") + 1) / 2))
    both = c.groupBy("conv_id", "pair").agg(F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("user"), F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))).alias("system"), F.max("turn").alias("turn"))
    w = Window.partitionBy("conv_id").orderBy("pair")
    rows = both.withColumn("system", F.coalesce("system", F.lit(""))).withColumn("u", F.collect_list("user").over(w)).withColumn("s", F.collect_list("system").over(w))
    rows = rows.where(F.col("user").isNotNull() & (F.size("u") == F.col("pair") + 1))
    return rows.select("conv_id", "turn", F.array_join(P.history(F.col("s"), F.col("u")), "|").alias("history"))


@register("recorded_turns", _STATES + """
, n as (select s.event_id, s.event_id % 5 = 0 as failed, (select count(*) from a where a.event_id = s.event_id) as own, (select count(*) from d where d.event_id = s.event_id) as changed,
  case when s.k <> '' then [s.k] else [] end as g, case when coalesce(s.pk, '') <> '' then [s.pk] else [] end as p from s),
r as (select *, len(list_intersect(g, p)) as tp from n)
select event_id, failed, case when failed then own = 0 else changed = 0 end as jga, case when failed then own = 0 else changed = 0 end as turn_accuracy,
       case when len(p) > 0 then tp::double / len(p) else 0.0 end as act_precision, case when len(g) > 0 then tp::double / len(g) else 0.0 end as act_recall from r
""")
def recorded_turns(spark, sf_dir):
    """The state and the acts of the event before as a stage's predictions, scored; each fifth failed and counts as the empty state."""
    said = lambda state: F.when(state.isNull(), F.expr(f"cast(array() as array<{A.ACT}>)")).otherwise(F.filter(A.acts_of_delta(F.transform_values(state, lambda _, m: F.map_filter(m, lambda k, v: (k == "k") & (v != "")))), lambda a: F.size(a["entity"]) > 0))
    s = snapshots(spark, sf_dir)
    rows = s.select("event_id", F.when(F.col("event_id") % 5 != 0, F.coalesce("before", S.empty())).alias("pred"), F.col("after").alias("gold"), F.coalesce("before", S.empty()).alias("last"), said(F.col("before")).alias("pred_acts"), said(F.col("after")).alias("gold_acts"))
    return G.recorded(rows).select("event_id", "failed", "jga", "turn_accuracy", F.col("act_scores.precision").alias("act_precision"), F.col("act_scores.recall").alias("act_recall"))


@register("joined_success", """
with c as (select conv_id as i, list(length(text) order by turn) as n from conversations group by conv_id),
t as (select i, n[1] % 4 as a, coalesce(n[2], 0) % 4 as b, coalesce(n[3], 0) % 5 as g, n[1] % 3 = 0 as phone from c),
o as (select *, range(1, a + 1) as first, range(1 + a // 2, 1 + b) as second, range(1, g + 1) as goal from t),
l as (select *, case when len(first) = 0 or len(list_filter(first, lambda x: not list_contains(second, x))) > 0 then second else first end as last from o),
j as (select i, len(last) > 0 and len(list_filter(last, lambda x: not list_contains(goal, x))) = 0 as m, phone from l),
k as (select i, m, m and phone as s from j)
select 'hotel' as domain, round_even(100 * avg(m::int), 1)::double as inform, round_even(100 * avg(s::int), 1)::double as success from k
union all select 'total', round_even(100 * avg(m::int), 1)::double, round_even(100 * avg(s::int), 1)::double from k
""")
def joined_success(spark, sf_dir):
    """Offers that later turns keep, replace or withdraw, and requests, over each dialogue; then rates."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("n"))
    at = lambda i: F.coalesce(F.try_element_at("n", F.lit(i)), F.lit(0))
    a, b, g = at(1) % 4, at(2) % 4, at(3) % 5
    upto = lambda lo, hi: F.transform(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.expr("cast(array() as array<int>)")), lambda x: x.cast("string"))
    turn = lambda slots, venues: F.struct(slots.alias("slots"), F.array(F.lit("hotel")).alias("domains"), F.create_map(F.lit("hotel"), venues).alias("venues"))
    name = F.array(F.lit("NAME"))
    first = turn(F.when(at(1) % 3 == 0, F.array(F.lit("NAME"), F.lit("PHONE"))).otherwise(name), upto(F.lit(1), a))
    want = F.struct(F.create_map(F.lit("area"), F.lit("west")).alias("informable"), F.array(F.lit("PHONE")).alias("requestable"), upto(F.lit(1), g).alias("venues"))
    turns, goal = F.array(first, turn(name, upto(F.floor(a / 2).cast("int") + 1, b))), F.create_map(F.lit("hotel"), want)
    return rates(judged(c.select(F.col("conv_id").cast("string").alias("dialogue"), turns.alias("turns"), goal.alias("goal"), F.expr("array(cast(array() as array<string>), cast(array() as array<string>))").alias("booked"))))


@register("venue_columns", "select p_partkey::varchar as id, lower(p_name) as name, p_size::varchar as arrive from part")
def venue_columns(spark, sf_dir):
    """A venue table's columns, renamed, the ignored ones gone."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    raw = p.select(F.col("p_partkey").alias("ID"), F.lower("p_name").alias("Name"), F.col("p_size").alias("arrive By"), F.lit("x").alias("location"))
    return L.venues(raw, "hotel").select("id", "name", "arrive")


@register("schema_rows", """
with p as (select (['hotel', 'train', 'bus', 'restaurant'])[p_size % 4 + 1] as service, p_size % 5 as kind, case when p_size % 5 = 1 then (['yes', 'no', 'free'])[p_partkey % 3 + 1] when p_size % 5 = 4 then (['yes', 'no'])[p_partkey % 2 + 1] else lower(p_brand) end as v, p_partkey from part),
s as (select service, kind, list(distinct v order by v) as vals, count(*) as n from p where service <> 'bus' group by 1, 2)
select service, (['book day', 'parking', 'price range', 'book people', 'internet'])[kind + 1] as slot,
       array_to_string(list_append(case when kind = 1 and list_contains(vals, 'free') then ['yes', 'no'] else vals end, 'dontcare'), ',') as vals, n % 2 = 0 as is_categorical from s
""")
def schema_rows(spark, sf_dir):
    """A service schema, of the parts' sizes and brands, as slots."""
    pick = lambda items, by: F.element_at(F.array(*map(F.lit, items)), (by + 1).cast("int"))
    kind = F.col("p_size") % 5
    value = F.when(kind == 1, pick(("yes", "no", "free"), F.col("p_partkey") % 3)).when(kind == 4, pick(("yes", "no"), F.col("p_partkey") % 2)).otherwise(F.lower("p_brand"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(pick(("hotel", "train", "bus", "restaurant"), F.col("p_size") % 4).alias("service_name"), pick(("bookday", "parking", "price range", "bookpeople", "internet"), kind).alias("slot"), value.alias("v"))
    s = p.groupBy("service_name", "slot").agg(F.array_sort(F.collect_set("v")).alias("possible_values"), (F.count("*") % 2 == 0).alias("is_categorical"))
    slot = F.struct(F.concat("service_name", F.lit("-"), "slot").alias("name"), "possible_values", "is_categorical")
    schema = s.groupBy("service_name").agg(F.collect_list(slot).alias("slots"))
    return L.slots_of(schema).select("service", "slot", F.array_join("possible_values", ",").alias("vals"), "is_categorical")


@register("evaluation_turns", """
select conv_id, turn, case when role is null or turn % 4 = 3 then 'it is the ' || role || ' of room ' || conv_id else 'it is the [value_area] of room ' || conv_id end as response,
       case turn % 3 when 0 then 'hotel area=' || case when conv_id % 2 = 0 then 'centre' else 'east' end when 1 then case when conv_id % 2 = 0 then 'restaurant price range=cheap' else 'restaurant ' end else '' end as state,
       array_to_string(list_sort(list_distinct(list_concat(case turn % 3 when 0 then ['Hotels'] when 1 then ['restaurant'] else ['submarine'] end, case when turn % 2 = 0 then ['taxi'] else [] end))), ',') as active
from conversations
""")
def evaluation_turns(spark, sf_dir):
    """Responses delexicalised again, states brought to the schema, active domains of states and acts together."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    even, r = F.col("conv_id") % 2 == 0, F.col("turn") % 3
    one = lambda service, slot, value: F.create_map(F.lit(service), F.create_map(F.lit(slot), value))
    state = (
        F.when(r == 0, one("Hotels", "area:", F.when(even, F.lit("Centre!")).otherwise(F.lit("east "))))
        .when(r == 1, one("restaurant", "price-range", F.when(even, F.lit("cheapp")).otherwise(F.lit("unheard of")))).otherwise(one("submarine", "area", F.lit("east")))
    )
    act = F.struct(F.lit("Inform").alias("type"), F.lit("hotel").alias("service"), F.create_map(F.lit("area"), F.col("role")).alias("entity"), F.expr("cast(null as array<string>)").alias("values"))
    acts = F.when(F.col("turn") % 4 == 3, F.expr(f"cast(array() as array<{A.ACT}>)")).otherwise(F.array(act))
    logs = c.select(F.col("conv_id").alias("dialogue_id"), F.col("turn").alias("turn_id"), F.concat(F.lit("it is the "), "role", F.lit(" of room "), F.col("conv_id").cast("string")).alias("response"), state.alias("state"), acts.alias("acts"), F.when(F.col("turn") % 2 == 0, F.array(F.lit("taxi"))).alias("active"))
    slots = spark.createDataFrame([("hotel", "area", ["centre", "east"], True), ("restaurant", "price range", ["cheap", "dear"], True)], "service string, slot string, possible_values array<string>, is_categorical boolean")
    got = evaluation.evaluation_turns(logs, slots)
    said = F.array_join(F.transform(F.map_entries("state"), lambda e: F.concat(e["key"], F.lit(" "), F.array_join(F.transform(F.map_entries(e["value"]), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ","))), ";")
    return got.select(F.col("dialogue_id").alias("conv_id"), F.col("turn_id").alias("turn"), "response", said.alias("state"), F.array_join("active_domains", ",").alias("active"))
