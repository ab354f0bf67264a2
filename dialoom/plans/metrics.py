"""Queries of the quality metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom import catalog
from dialoom.catalog import register
from dialoom.functions.text import tokens
from dialoom.operators import metrics as M
from dialoom.operators.stages import evaluate

_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), lambda x: x <> '')"


def _turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("words", tokens(F.col("text")))


@register("rule_f1", """
with r as (select lang, toxic, case when contains(lower(text), 'idiot') or contains(lower(text), 'stupid') then 1 else 0 end as rule from documents join labels using (doc_id)),
c as (select lang, sum(case when rule = 1 and toxic = 1 then 1 else 0 end)::bigint as tp, sum(case when rule = 1 and toxic = 0 then 1 else 0 end)::bigint as fp, sum(case when rule = 0 and toxic = 1 then 1 else 0 end)::bigint as fn from r group by lang),
q as (select *, case when tp + fp > 0 then tp / (tp + fp)::double else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn)::double else 0.0 end as rc from c)
select lang, tp, fp, fn, round(p, 6)::double as precision, round(rc, 6)::double as recall, round(case when p + rc > 0 then 2 * p * rc / (p + rc) else 0.0 end, 6)::double as f1 from q
""")
def rule_f1(spark, sf_dir):
    """Precision, recall and F1 of a rule by group."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    says = F.lower("text").contains("idiot") | F.lower("text").contains("stupid")
    d = d.select("lang", (says & (F.col("toxic") == 1)).cast("int").alias("tp"), (says & (F.col("toxic") == 0)).cast("int").alias("fp"), (~says & (F.col("toxic") == 1)).cast("int").alias("fn"))
    got = M.prf(d, "lang")
    return got.select("lang", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("running_scores", f"""
with w as (select conv_id, turn, list_distinct({_TOKENS}) as p from conversations),
s as (select conv_id, turn, p, coalesce(lag(p) over (partition by conv_id order by turn), []) as g from w),
c as (select conv_id, turn, sum(len(list_intersect(p, g))) over w as tp, sum(len(p) - len(list_intersect(p, g))) over w as fp, sum(len(g) - len(list_intersect(p, g))) over w as fn from s window w as (partition by conv_id order by turn)),
q as (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp::double / (tp + fn) else 0.0 end as r from c)
select conv_id, turn, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(p, 6)::double as precision, round(r, 6)::double as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6)::double as f1 from q
""")
def running_scores(spark, sf_dir):
    """Each turn's words against the words of the turn before, counted up to each turn of a conversation."""
    before = F.lag("p").over(W.partitionBy("conv_id").orderBy("turn"))
    t = _turns(spark, sf_dir).withColumn("p", F.array_distinct("words")).withColumn("g", before)
    rows = M.running_scores(t, "p", "g", ["conv_id"], ["turn"])
    return rows.select("conv_id", "turn", "so_far.*", *[F.round(f"scores.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


_MODES = "['rail', 'air', 'reg air', 'truck', 'mail', 'dontcare', 'ship', 'air mail']"


@register("slot_scores", f"""
with l as (select l_orderkey as k, l_linenumber as slot, ({_MODES})[l_partkey % 8 + 1] as v, ({_MODES})[l_suppkey % 8 + 1] as w, l_returnflag as f from lineitem),
g as (select k, slot, v as g from l where f <> 'R'), p as (select k, slot, case when k % 3 = 0 then v else w end as p from l where f <> 'A'),
b as (select k, slot, g, p, g is not null and p is not null and (contains(g, p) or contains(p, g)) as same from g full join p using (k, slot)),
e as (select k, sum(same::int) as tp, sum((p is not null and not same)::int) as fp, sum((g is not null and g <> 'dontcare' and not same)::int) as fn, bool_and(same) as j from b group by k),
t as (select o_orderkey as k, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, coalesce(j, true) as j from orders left join e on k = o_orderkey),
s as (select sum(tp)::double as tp, sum(fp)::double as fp, sum(fn)::double as fn, sum(j::int)::double / (count(*) + 1e-10::double) as j from t),
q as (select tp / (tp + fp + 1e-10::double) as p, tp / (tp + fn + 1e-10::double) as r, j from s)
select round(p, 6) as precision, round(r, 6) as recall, round(200 * p * r / (p + r + 1e-10::double), 6) as f1, round(100 * j, 6)::double as joint_accuracy from q
""")
def slot_scores(spark, sf_dir):
    """State scores over a full join of slots: values nearly equal, missing on either side, or saying nothing; turns without slots."""
    mode = lambda c: F.element_at(F.array(*map(F.lit, ("rail", "air", "reg air", "truck", "mail", "dontcare", "ship", "air mail"))), (F.col(c) % 8 + 1).cast("int"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("slot"), mode("l_partkey").alias("v"), mode("l_suppkey").alias("w"), "l_returnflag")
    gold = li.where("l_returnflag <> 'R'").select("k", "slot", F.col("v").alias("value"))
    predicted = li.where("l_returnflag <> 'A'").select("k", "slot", F.when(F.col("k") % 3 == 0, F.col("v")).otherwise(F.col("w")).alias("value"))
    got = M.slot_f1(gold, predicted, "k", turns=spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k")))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@register("act_scores", """
with t as (
  select ['Inform', 'Offer', 'Confirm'][event_id % 3 + 1] as ga, ['Inform', 'Offer', 'Inform'][event_id % 4 % 3 + 1] as pa, 'k' || (event_id % 5) as gs, 'k' || (user_id % 5) as ps,
         json_extract_string(props, '$.k') as gv, case when event_id % 2 = 0 then json_extract_string(props, '$.k') else floor(value)::bigint::varchar end as pv from events
), c as (
  select count(*)::double as n, sum((ga = pa)::int)::double as a, sum((gs = ps)::int)::double as s, sum((gv is not null and gv = pv)::int)::double as v, count(gv)::double as vg, count(pv)::double as vp from t
)
select round(a / n, 6) as acts_f1, round(s / n, 6) as slots_f1, round(v / vp, 6) as values_precision, round(v / vg, 6) as values_recall from c
""")
def act_scores(spark, sf_dir):
    """Precision, recall and F1 of predicted acts: their names, slots and values, folded onto near gold ones."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k"))
    kind = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by + 1).cast("int"))
    act = lambda t, s, v: F.struct(t.alias("type"), F.lit("hotel").alias("service"), F.create_map(s, v).alias("entity"), F.expr("cast(null as array<string>)").alias("values"))
    slot = lambda c: F.concat(F.lit("k"), (F.col(c) % 5).cast("string"))
    gold = act(kind(("Inform", "Offer", "Confirm"), F.col("event_id") % 3), slot("event_id"), F.col("k"))
    predicted = act(kind(("Inform", "Offer", "Inform"), F.col("event_id") % 4 % 3), slot("user_id"), F.when(F.col("event_id") % 2 == 0, F.col("k")).otherwise(F.floor("value").cast("string")))
    got = M.act_scores(e.select(F.array(predicted).alias("pred"), F.array(gold).alias("gold")))
    return got.select(*[F.round(c, 6).alias(c) for c in ("acts_f1", "slots_f1", "values_precision", "values_recall")])


@register("lexical_richness", f"""
with w as (select row_number() over () as row, {_TOKENS} as words from conversations),
g1 as (select unnest(words) as g from w), c1 as (select g, count(*) as c from g1 group by g), n as (select sum(len(words))::double as n, avg(len(words)) as a from w),
g2 as (select unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as g, 0 as z from w), c2 as (select g, split_part(g, ' ', 1) as h, count(*) as c from g2 group by g),
g3 as (select unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) as g from w)
select round(a, 6)::double as avg_tokens, (select count(*) from c1) as unigrams, (select count(*) from c2) as bigrams, (select count(distinct g) from g3) as trigrams,
       round((select -sum(c / n * log2(c / n)) from c1, n), 6) as entropy, round((select -sum(c2.c / n * log2(c2.c / c1.c::double)) from c2 join c1 on c1.g = c2.h, n), 6) as conditional_entropy from n
""")
def lexical_richness(spark, sf_dir):
    """M7: token statistics and entropies."""
    got = M.richness(_turns(spark, sf_dir), "words")
    return got.select(*[F.round(c, 6).alias(c) if c in ("avg_tokens", "entropy", "conditional_entropy") else F.col(c) for c in ("avg_tokens", "unigrams", "bigrams", "trigrams", "entropy", "conditional_entropy")])


@register("segment_ratio", f"""
with w as (select conv_id, turn, unnest({_TOKENS}) as w, generate_subscripts({_TOKENS}, 1) as k from conversations),
p as (select w, floor((row_number() over (order by conv_id, turn, k) - 1) / 50) as s from w), s as (select s, count(distinct w) as d from p group by s having count(*) = 50)
select round(avg(d / 50.0), 6)::double as msttr from s
""")
def segment_ratio(spark, sf_dir):
    """M7: the mean type-token ratio of segments of fifty tokens."""
    return M.msttr(_turns(spark, sf_dir), "words", "conv_id", "turn").select(F.round("msttr", 6).alias("msttr"))


_PAIRS = f"""
with w as (select conv_id, turn, {_TOKENS} as r from conversations), j as (select row_number() over () as row, r, list_filter(list_transform(range(1, len(r) + 1), lambda i: case when i % 7 <> 0 then r[i] end), lambda x: x is not null) as c from w),
""" + ",\n".join(
    f"""c{n} as (select row, g, count(*) as k from (select row, unnest(list_transform(range(1, len(c) - {n} + 2), lambda i: array_to_string(c[i : i + {n - 1}], ' '))) as g from j) group by row, g),
r{n} as (select row, g, count(*) as k from (select row, unnest(list_transform(range(1, len(r) - {n} + 2), lambda i: array_to_string(r[i : i + {n - 1}], ' '))) as g from j) group by row, g),
m{n} as (select {n} as n, sum(least(c{n}.k, coalesce(r{n}.k, 0)))::bigint as matched, sum(c{n}.k)::bigint as total from c{n} left join r{n} using (row, g))"""
    for n in (1, 2, 3, 4)
)
_ALL = " union all ".join(f"select n::bigint as n, matched, total from m{n}" for n in (1, 2, 3, 4))


def _shortened(spark, sf_dir):
    """Turns' words, and the same without each seventh."""
    return _turns(spark, sf_dir).select(F.col("words").alias("r"), F.filter("words", lambda x, i: (i + 1) % 7 != 0).alias("c"))


@register("bleu_counts", f"{_PAIRS} {_ALL}")
def bleu_counts(spark, sf_dir):
    """M6: clipped n-gram matches of shortened turns with the whole ones."""
    return M.bleu_counts(_shortened(spark, sf_dir), "c", "r").select(F.col("n").cast("long").alias("n"), "matched", "total")


@register("corpus_bleu", f"""{_PAIRS}, a as ({_ALL}), l as (select sum(len(c))::double as cl, sum(len(r))::double as rl from j)
select round((select 100 * exp(avg(ln(matched::double / total))) from a) * case when cl >= rl then 1.0 else exp(1 - rl / cl) end, 6)::double as bleu from l
""")
def corpus_bleu(spark, sf_dir):
    """M6: BLEU of shortened turns against the whole ones."""
    return M.bleu(_shortened(spark, sf_dir), "c", "r").select(F.round("bleu", 6).alias("bleu"))


@register("success_rates", """
with j as (select o_custkey as dialogue, o_orderpriority as domain, bool_and(o_totalprice > 20000) as m, bool_and(o_orderstatus <> 'F') as s from orders group by 1, 2),
t as (select dialogue, min(m::int) as m, min(s::int) as s from j group by 1)
select domain, round_even(100 * avg(m::int), 1)::double as inform, round_even(100 * avg(s::int), 1)::double as success from j group by domain
union all select 'total', round_even(100 * avg(m), 1)::double, round_even(100 * avg(s), 1)::double from t
""")
def success_rates(spark, sf_dir):
    """M8: rates by domain and in total."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    j = o.groupBy(F.col("o_custkey").alias("dialogue"), F.col("o_orderpriority").alias("domain")).agg(F.bool_and(F.col("o_totalprice") > 20000).alias("match"), F.bool_and(F.col("o_orderstatus") != "F").alias("success"))
    return M.rates(j)


@register("near_joint_goal", """
with p as (select p_partkey, lower(p_name) as a, case p_size % 3 when 0 then lower(p_type) when 1 then substr(lower(p_name), 2, 5) else lower(p_name) end as b, p_size % 5 = 0 as more from part)
select p_partkey, not more and (contains(a, b) or contains(b, a)) as same from p
""")
def near_joint_goal(spark, sf_dir):
    """M1: states that nearly agree, in the same slots."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("a", F.lower("p_name"))
    b = F.when(F.col("p_size") % 3 == 0, F.lower("p_type")).when(F.col("p_size") % 3 == 1, F.substring("a", 2, 5)).otherwise(F.col("a"))
    gold = F.when(F.col("p_size") % 5 == 0, F.create_map(F.lit("n"), b, F.lit("m"), b)).otherwise(F.create_map(F.lit("n"), b))
    return p.select("p_partkey", M.joint_goal(F.create_map(F.lit("n"), F.col("a")), gold).alias("same"))


@register("folded_labels", """
with p as (select p_partkey, lower(p_brand) as g1, lower(p_name) as g2, substr(lower(p_name), 1 + p_size % 4, 5) as x, substr(lower(p_type), 1, 6) as y from part),
f as (select p_partkey, unnest([x, y]) as v, list_sort([g1, g2]) as g from p),
m as (select p_partkey, coalesce(list_filter(g, lambda z: contains(z, v) or contains(v, z))[1], v) as label from f)
select p_partkey, array_to_string(list_sort(list_distinct(list(label))), ',') as labels from m group by p_partkey
""")
def folded_labels(spark, sf_dir):
    """Predictions folded onto gold values that they nearly stand in."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    predicted = F.array(F.expr("substr(lower(p_name), 1 + p_size % 4, 5)"), F.substring(F.lower("p_type"), 1, 6))
    return p.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(M.folded(predicted, F.array(F.lower("p_brand"), F.lower("p_name"))))), ",").alias("labels"))


@register("corpus_metrics", f"""
select 'bleu' as metric, bleu as value from ({catalog._ORACLES["corpus_bleu"]})
union all select unnest(['avg_tokens', 'unigrams', 'entropy']), unnest([avg_tokens, unigrams::double, entropy]) from ({catalog._ORACLES["lexical_richness"]})
""")
def corpus_metrics(spark, sf_dir):
    """The metrics asked for of one corpus, by the evaluator."""
    found = evaluate(_shortened(spark, sf_dir), references=("c", "r"), words="r")
    bleu = found["bleu"].select(F.lit("bleu").alias("metric"), F.round("bleu", 6).alias("value"))
    rich = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in ("avg_tokens", "unigrams", "entropy")])
    return bleu.unionByName(found["richness"].select(F.explode(rich).alias("m")).select("m.*"))
