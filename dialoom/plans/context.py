"""Queries over the turn table: context, history and turn statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from dialoom.catalog import register
from dialoom.functions.text import clean_utterance, retrieval_input
from dialoom.operators import turns


@register(
    "flagship_turn_context",
    """
    with h as (
      select role, length(text) as n_chars,
             lag(role) over w as prev_role,
             least(row_number() over w, 5) as history
      from conversations
      window w as (partition by conv_id order by turn)
    )
    select role, coalesce(prev_role, 'none') as prev_role, count(*) as turns,
           cast(sum(n_chars) as bigint) as chars, cast(sum(history) as bigint) as history_turns
    from h group by 1, 2
    """,
)
def flagship_turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    w = W.partitionBy("conv_id").orderBy("turn")
    history = F.size(F.collect_list("turn").over(w.rowsBetween(-4, 0)))
    return (
        t.select("role", F.length("text").alias("n_chars"), F.lag("role").over(w).alias("prev_role"), history.alias("history"))
        .groupBy("role", F.coalesce("prev_role", F.lit("none")).alias("prev_role"))
        .agg(F.count("*").alias("turns"), F.sum("n_chars").cast("long").alias("chars"), F.sum("history").cast("long").alias("history_turns"))
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


@register(
    "previous_turn",
    "select conv_id, turn, role, lag(role) over w as prev_role, length(lag(text) over w)::bigint as prev_chars from conversations window w as (partition by conv_id order by turn)",
)
def previous_turn(spark, sf_dir):
    """The turn before, by position."""
    t = conversations(spark, sf_dir)
    return t.select("conv_id", "turn", "role", turns.previous("role", "conv_id", "turn").alias("prev_role"), F.length(turns.previous("text", "conv_id", "turn")).cast("long").alias("prev_chars"))


@register(
    "turn_context",
    """select conv_id, turn, coalesce(array_to_string(list(role || ':' || length(text)) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding), ','), '') as context
       from conversations""",
)
def turn_context(spark, sf_dir):
    """The three turns before, oldest first."""
    t = conversations(spark, sf_dir)
    got = turns.context(["role", "text"], "conv_id", "turn", 3)
    return t.select("conv_id", "turn", F.array_join(F.transform(got, lambda x: F.concat(x["role"], F.lit(":"), F.length(x["text"]).cast("string"))), ",").alias("context"))


@register(
    "utterance_history",
    """select conv_id, turn, md5(array_to_string(list(replace(replace(text, chr(13), ''), chr(10), '')) over (partition by conv_id order by turn rows between 4 preceding and current row), '|')) as history
       from conversations""",
)
def utterance_history(spark, sf_dir):
    """The last five utterances, without line breaks."""
    t = conversations(spark, sf_dir).withColumn("text", clean_utterance(F.col("text")))
    got = F.collect_list("text").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-4, 0))
    return t.select("conv_id", "turn", F.md5(F.array_join(got, "|")).alias("history"))


@register(
    "full_history",
    """select conv_id, turn, count(*) over p as before, (sum(length(text)) over p)::bigint as chars_before,
              min(case when turn = n then 1 else 0 end) over (partition by conv_id) = 1 as contiguous
       from (select *, row_number() over (partition by conv_id order by turn) - 1 as n from conversations)
       window p as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""",
)
def full_history(spark, sf_dir):
    """Everything before a turn, and whether turn numbers are positions."""
    t = conversations(spark, sf_dir)
    t = t.select("conv_id", "turn", turns.history(["text"], "conv_id", "turn").alias("h"), turns.contiguous("conv_id", "turn").alias("contiguous"))
    chars = F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    return t.select("conv_id", "turn", F.size("h").cast("long").alias("before"), F.when(F.size("h") > 0, chars).alias("chars_before"), "contiguous")


@register(
    "gathered_dialogues",
    "select conv_id, count(*) as turns, md5(array_to_string(list(turn || role order by turn), ',')) as roles from conversations group by conv_id",
)
def gathered_dialogues(spark, sf_dir):
    """M9: dialogues as ordered lists of turns."""
    got = turns.gathered(conversations(spark, sf_dir), "conv_id", "turn", "role", "text")
    return got.select("conv_id", F.size("turns").cast("long").alias("turns"), F.md5(F.array_join(F.transform("turns", lambda t: F.concat(t["at"].cast("string"), t["said"]["role"])), ",")).alias("roles"))


@register(
    "turn_pairs",
    """select conv_id, first, second from (
         select conv_id, row_number() over w as n, role || turn as first, lead(role || turn) over w as second from conversations window w as (partition by conv_id order by turn))
       where n % 2 = 1 and second is not null""",
)
def turn_pairs(spark, sf_dir):
    """Non-overlapping pairs of turns."""
    t = conversations(spark, sf_dir).withColumn("x", F.concat("role", F.col("turn").cast("string")))
    return turns.pairs(t, F.col("turn"), "x", "conv_id")


@register(
    "wave_batches",
    """with d as (select conv_id, row_number() over (order by substr(md5(conv_id || ':42'), 1, 8), conv_id) - 1 as n, count(*) over () as m from (select distinct conv_id from conversations)),
       p as (select conv_id, n, least(3, floor(n / greatest(1, floor(m / 4))))::int as part from d),
       r as (select c.conv_id, c.turn, part, row_number() over (partition by part order by turn, n) - 1 as position from conversations c join p using (conv_id))
       select conv_id, turn, part::bigint as part, position, (case when position < 3 then position else 3 + floor((position - 3) / 16) end)::bigint as batch from r""",
)
def wave_batches(spark, sf_dir):
    """O1: turns of four parts in waves, batches of 16 after three warm-up turns."""
    got = turns.waves(conversations(spark, sf_dir), "conv_id", "turn", partitions=4, batch=16, warmup=3)
    return got.select("conv_id", "turn", F.col("part").cast("long").alias("part"), F.col("position").cast("long").alias("position"), "batch")


@register(
    "resume_turns",
    "select conv_id, turn from conversations c where not exists (select 1 from conversations l where l.conv_id = c.conv_id and l.turn = c.turn and l.turn < 2)",
)
def resume_turns(spark, sf_dir):
    """Turns that aren't logged yet."""
    t = conversations(spark, sf_dir).select("conv_id", "turn")
    return turns.resume(t, t.where("turn < 2"), "conv_id", "turn")


@register(
    "turn_encoding",
    """with t as (select conv_id, turn, role, text, lag(text) over w as p1, lag(role) over w as r1, lag(text, 2) over w as p2, lag(role, 2) over w as r2, lead(text) over w as after from conversations window w as (partition by conv_id order by turn)),
       s as (select *, list_filter([case when length(p1) % 4 <> 0 then 'for x' || r1 || ', the n is ' || length(p1) % 4 || ', said is ' || turn || ' .' else 'for x' || r1 || ', the said is ' || turn || ' .' end,
              case when length(p2) % 4 <> 0 then 'for y' || r2 || ', the n is ' || length(p2) % 4 || ' .' end], lambda x: x is not null) as context from t where role = 'user')
       select conv_id, turn, md5('Context: ' || array_to_string(context, ' ') || chr(10) || case when p1 is null or turn % 5 = 0 then '' else 'System: ' || p1 end || chr(10) || 'User: ' || text) as encoding,
              md5(after) as response, md5('User: ' || text || chr(10) || 'System: ' || coalesce(after, '')) as both from s""",
)
def turn_encoding(spark, sf_dir):
    """What a user turn is retrieved by, in all three formats; blank slots and services without any are left out."""
    w = W.partitionBy("conv_id").orderBy("turn")
    t = conversations(spark, sf_dir).withColumns({"p1": F.lag("text").over(w), "r1": F.lag("role").over(w), "p2": F.lag("text", 2).over(w), "r2": F.lag("role", 2).over(w), "after": F.lead("text").over(w)}).where("role = 'user'")
    n = lambda c: F.when(F.length(c) % 4 != 0, (F.length(c) % 4).cast("string")).otherwise(F.lit(""))
    one = F.when(F.col("p1").isNotNull(), F.array(F.struct(F.concat(F.lit("x"), "r1").alias("key"), F.create_map(F.lit("n"), n("p1"), F.lit("said"), F.col("turn").cast("string")).alias("value"))))
    two = F.when(F.col("p2").isNotNull(), F.array(F.struct(F.concat(F.lit("y"), "r2").alias("key"), F.create_map(F.lit("n"), n("p2")).alias("value"))))
    none = F.expr("cast(array() as array<struct<key: string, value: map<string, string>>>)")
    state = F.map_from_entries(F.concat(F.coalesce(one, none), F.coalesce(two, none)))
    system = F.when(F.col("turn") % 5 == 0, F.lit("none")).otherwise(F.col("p1"))
    kinds = {"encoding": "context_system_user", "response": "response", "both": "user_response"}
    return t.select("conv_id", "turn", *[F.md5(retrieval_input(k, state, system, F.col("text"), F.col("after"))).alias(c) for c, k in kinds.items()])
