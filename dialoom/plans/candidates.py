"""Queries of candidate reranking: an order's line items are an item's completions, their price the score."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.operators import candidates as C
from dialoom.operators import greedy
from dialoom.operators.ngrams import Model, words

_C = "with c as (select l_orderkey as item, 'part ' || l_partkey % 40 as completion, l_extendedprice as score, l_linenumber as line from lineitem)"


def candidates(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("item"), F.concat(F.lit("part "), (F.col("l_partkey") % 40).cast("string")).alias("completion"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("line"))


@register("best_candidates", _C + """
select item, completion, max(score) as score from (select *, row_number() over (partition by item order by score desc, completion) as k from c) where k <= 3 group by item, completion
""")
def best_candidates(spark, sf_dir):
    """The three best samples of each item, equal ones once."""
    return C.best_n(candidates(spark, sf_dir), 3)


@register("chosen_candidate", _C + "select item, completion, score from (select item, completion, score, row_number() over (partition by item order by score desc, completion) as k from c) where k = 1")
def chosen_candidate(spark, sf_dir):
    """The best candidate."""
    return C.best(candidates(spark, sf_dir).select("item", "completion", "score"))


_GRAMS = """
g as (select k, array_to_string(w[i - k + 1 : i - 1], ' ') as context, w[i] as word, count(*) as n from toks, (select unnest(range(3, 400)) as i) i, (select unnest([1, 2, 3]) as k) k where i <= len(w) group by all),
tot as (select k, context, sum(n)::bigint as total from g group by all),
v as (select count(*) as v from g where k = 1)"""
_MIXED = "(coalesce({n}, 0) + 2.0::double * ({below})) / (coalesce({t}, 0) + 2.0::double)"


@register("reranked_candidates", _C + f"""
, toks as (select ['<s>', '<s>', 'part', (l_partkey % 40)::varchar, 'by', lower(l_returnflag || l_linestatus), '</s>'] as w from lineitem), {_GRAMS},
d as (select item, completion, max(score) as score from c group by 1, 2), m as (select *, count(*) over (partition by item) as n from d),
least as (select l_orderkey as item, lower(min(l_returnflag || l_linestatus)) as mode from lineitem group by 1),
asked as (select distinct completion, mode from m join least using (item)),
ends as (
  select completion, mode, unnest([1, 2]) as place, unnest(['by', mode]) as word, unnest([split_part(completion, ' ', 2), 'by']) as one, unnest([completion, split_part(completion, ' ', 2) || ' by']) as two from asked),
p as (
  select e.*, ln({_MIXED.format(n="g3.n", t="t3.total", below=_MIXED.format(n="g2.n", t="t2.total", below=_MIXED.format(n="g1.n", t="t1.total", below="1.0::double / (v.v + 1)")))}) as p
  from ends e cross join v
  left join g g1 on g1.k = 1 and g1.word = e.word left join tot t1 on t1.k = 1
  left join g g2 on g2.k = 2 and g2.context = e.one and g2.word = e.word left join tot t2 on t2.k = 2 and t2.context = e.one
  left join g g3 on g3.k = 3 and g3.context = e.two and g3.word = e.word left join tot t3 on t3.k = 3 and t3.context = e.two),
x as (select completion, mode, list_sum(list(p order by place)) as p from p group by 1, 2)
select m.item, completion, round(case when n = 1 then score else x.p end, 6)::double as score from m join least using (item) join x using (completion, mode)
""")
def reranked_candidates(spark, sf_dir):
    """How likely an order's least flags are after each candidate, by word trigrams of all lines, replaces the candidates' own scores."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    said = li.select(F.concat(F.lit("part "), (F.col("l_partkey") % 40).cast("string"), F.lit(" by "), F.lower(F.concat("l_returnflag", "l_linestatus"))).alias("text"))
    least = li.groupBy(F.col("l_orderkey").alias("item")).agg(F.concat(F.lit(" by "), F.lower(F.min(F.concat("l_returnflag", "l_linestatus")))).alias("target"))
    c = candidates(spark, sf_dir).groupBy("item", "completion").agg(F.max("score").alias("score"))
    texts = C.channel_texts(c.join(least, "item").select("item", F.lit("").alias("prompt"), "completion", "target"))
    got = C.rerank(c, C.score_once(texts.withColumn("same", F.lit(False)), Model.count(said).score))
    return got.select("item", "completion", F.round("score", 6).alias("score"))


@register("greedy_texts", f"""
with recursive toks as (select list_concat(['<s>', '<s>'], list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> ''), ['</s>']) as w from conversations), {_GRAMS},
p1 as (select g.word, {_MIXED.format(n="n", t="total", below="1.0::double / (v + 1)")} as p from g join tot using (k, context) cross join v where k = 1),
b1 as (select word, p from p1 order by p desc, word limit 1),
p2 as (select g.context, g.word, {_MIXED.format(n="g.n", t="tot.total", below="p1.p")} as p from g join tot using (k, context) join p1 using (word) where k = 2),
b2 as (select context, word, p from (select *, row_number() over (partition by context order by p desc, word) as r from (
  select * from p2 union all select context, b1.word, {_MIXED.format(n="0", t="total", below="b1.p")} from tot cross join b1 where k = 2)) where r = 1),
p3 as (select g.context, g.word, {_MIXED.format(n="g.n", t="tot.total", below="p2.p")} as p from g join tot using (k, context) join p2 on p2.context = split_part(g.context, ' ', 2) and p2.word = g.word where k = 3),
b3 as (select context, word from (select *, row_number() over (partition by context order by p desc, word) as r from (
  select * from p3 union all select tot.context, b2.word, {_MIXED.format(n="0", t="tot.total", below="b2.p")} from tot join b2 on b2.context = split_part(tot.context, ' ', 2) where k = 3)) where r = 1),
starts as (select conv_id, turn, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')[1 : 1 + turn % 3] as w from conversations),
walk as (
  select conv_id, turn, list_concat(['<s>', '<s>'], w) as w, 0 as step, []::varchar[] as said from starts
  union all
  select conv_id, turn, list_append(w, next), step + 1, list_append(said, next) from (
    select walk.*, coalesce(b3.word, b2.word, b1.word) as next from walk
    left join b3 on b3.context = w[-2] || ' ' || w[-1] left join b2 on b2.context = w[-1] cross join b1 where step < 8) where next <> '</s>')
select conv_id, turn, array_to_string(max_by(said, step), ' ') as completion from walk group by conv_id, turn
""")
def greedy_texts(spark, sf_dir):
    """G1: each turn's first words completed greedily, by word trigrams of all turns."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    begun = F.array_join(F.slice(words(F.col("text")), F.lit(1), (F.col("turn") % 3 + 1).cast("int")), " ")
    prompts = c.select(F.struct("conv_id", "turn").alias("id"), begun.alias("prompt"))
    return greedy.complete(c, prompts, 8).select("id.conv_id", "id.turn", "completion")


@register("joint_texts", _C + """
, d as (select distinct item, completion from c) select count(distinct completion || 'x') as texts, count(*) as asked from d
""")
def joint_texts(spark, sf_dir):
    """Texts to score jointly, each once."""
    c = candidates(spark, sf_dir).select("item", F.lit("p").alias("prompt"), "completion", F.lit("x").alias("target")).distinct()
    t = C.channel_texts(c, "joint")
    return t.agg(F.countDistinct("prefix", "text").alias("texts"), F.count("*").alias("asked"))


@register("stop_trimmed", """
with w as (select conv_id, turn, text, string_split(text, ' ') as w, strpos(text, '.') as pos from conversations),
e as (select *, list_transform(w, lambda x: length(x) / -10.0::double) as p, list_transform(range(1, len(w) + 1), lambda i: length(array_to_string(w[1 : i], ' '))) as ends from w),
n as (select *, len(list_filter(ends, lambda x: x < pos)) + (pos > 1)::int as n from e)
select conv_id, turn, case when pos > 0 then substr(text, 1, pos - 1) else text end as completion, round(case when pos > 0 then coalesce(list_sum(p[1 : n]), 0) else 0 end, 6)::double as score from n
""")
def stop_trimmed(spark, sf_dir):
    """Texts up to the first stop sequence, scored by the tokens (words here) up to the one in which it starts."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("w", F.split("text", " "))
    logprobs = F.transform("w", lambda x: F.length(x) / F.lit(-10.0))
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.length(F.array_join(F.slice("w", F.lit(1), i), " ")))
    text, score = C.trim_stop(F.col("text"), logprobs, r"\.", ends)
    return c.select("conv_id", "turn", text.alias("completion"), F.round(score, 6).alias("score"))


@register("parsed_completions", """
with e as (select event_id, json_extract_string(props, '$.k') as k, event_type as t from events)
select event_id, 'Inform' as act, 'k' as slot, k as value from e where event_id % 5 in (0, 1)
union all select event_id, 'Inform', t, k from e where event_id % 5 = 2
union all select event_id, 'Offer', 'other', t from e where event_id % 5 = 2
union all select event_id, 'Inform', 'k', k || ', (' || t || ')' from e where event_id % 5 = 3
""")
def parsed_completions(spark, sf_dir):
    """Completions read as calls: a repeated argument counts once, a missing bracket is closed, brackets in texts are text, two calls are two acts, prose is none."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    shape = F.col("event_id") % 5
    text = (
        F.when(shape == 0, F.concat(F.lit("[Inform(k='"), "k", F.lit("', k='again'"))).when(shape == 1, F.concat(F.lit("Inform(k='"), "k", F.lit("')]")))
        .when(shape == 2, F.concat(F.lit("[Inform("), "event_type", F.lit("='"), "k", F.lit("'), Offer(other='"), "event_type", F.lit("')]")))
        .when(shape == 3, F.concat(F.lit("[Inform(k='"), "k", F.lit(", ("), "event_type", F.lit(")')]"))).otherwise(F.concat(F.lit("no call but "), "k"))
    )
    calls = F.from_json(C.parsed_acts(text), "array<struct<type: string, args: map<string, string>>>")
    return e.select("event_id", F.explode(calls).alias("c")).select("event_id", F.col("c.type").alias("act"), F.explode("c.args").alias("slot", "value"))


@register("parsed_states", """
with e as (select event_id, json_extract_string(props, '$.k') as k, event_type as t from events)
select event_id, case event_id % 5 when 0 then 'hotel.area=west' when 1 then 'hotel.area=' || k when 2 then 'hotel.area=west;train.arrive by=' || k when 3 then '' else 'hotel.area=west;hotel.name=' || t end as state from e
""")
def parsed_states(spark, sf_dir):
    """The state after a completion that can't be read, changes a slot, adds a service, deletes a slot, or adds one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    shape = F.col("event_id") % 5
    text = (
        F.when(shape == 0, F.lit("find_hotel(area=")).when(shape == 1, F.concat(F.lit("find_hotel(area='"), "k", F.lit("')"))).when(shape == 2, F.concat(F.lit("[agent.find_train(arrive_by='"), "k", F.lit("')]")))
        .when(shape == 3, F.lit("agent.find_hotel(area='[DELETE]')")).otherwise(F.concat(F.lit("book_hotel(name='"), "event_type", F.lit("'")))
    )
    state = C.parsed_state(text, F.create_map(F.lit("hotel"), F.create_map(F.lit("area"), F.lit("west"))))
    pairs = F.flatten(F.transform(F.map_entries(state), lambda s: F.transform(F.map_entries(s["value"]), lambda p: F.concat(s["key"], F.lit("."), p["key"], F.lit("="), p["value"]))))
    return e.select("event_id", F.array_join(F.array_sort(pairs), ";").alias("state"))
