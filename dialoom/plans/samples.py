"""Queries of sampling, splitting, partitioning and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.functions.text import short_hash
from dialoom.operators import sampling as S
from dialoom.operators.ranking import ranked

_O = "substr(md5({0} || ':42'), 1, 8)"


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("mixture", f"""
with d as (select doc_id, row_number() over (order by {_O.format('doc_id')}, doc_id) as k, count(*) over () as n from documents),
     c as (select conv_id as doc_id, row_number() over (order by {_O.format('conv_id')}, conv_id) as k, count(*) over () as n from (select distinct conv_id from conversations))
select 'docs' as mode, doc_id, 1::bigint as copy from d where k <= floor(n * 0.25)
union all select 'twice', doc_id, unnest(range(1, 3)) from c
union all select 'more', doc_id, unnest(range(1, case when k <= floor(n * 0.5) then 4 else 3 end)) from c
""")
def mixture(spark, sf_dir):
    """A quarter of one table, two copies and two and a half copies of another."""
    d = _read(spark, sf_dir, "documents").select("doc_id")
    c = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    got = S.mixture({"docs": (d, 0.25), "twice": (c, 2.0), "more": (c, 2.5)}, "doc_id")
    return got.select("mode", "doc_id", F.col("copy").cast("long").alias("copy"))


@register("dialogue_split", f"""
with v as (select conv_id from (select distinct conv_id from conversations) order by {_O.format('conv_id')}, conv_id limit 16)
select case when v.conv_id is null then 'train' else 'validation' end as split, count(*) as turns, count(distinct c.conv_id) as dialogues from conversations c left join v using (conv_id) group by 1
""")
def dialogue_split(spark, sf_dir):
    """Dialogues held out, none in both splits."""
    got = S.split(_read(spark, sf_dir, "conversations"), "conv_id", 16)
    return got.groupBy("split").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("dialogues"))


@register("sampled_dialogues", f"""
with g as (select distinct conv_id from conversations), v as (select conv_id from g order by {_O.format('conv_id')}, conv_id limit 10)
select conv_id, turn from conversations semi join v using (conv_id)
""")
def sampled_dialogues(spark, sf_dir):
    """All turns of ten drawn dialogues."""
    return S.sample_groups(_read(spark, sf_dir, "conversations"), "conv_id", 10).select("conv_id", "turn")


@register("sampled_with_replacement", f"""
with g as (select conv_id, row_number() over (order by {_O.format('conv_id')}, conv_id) - 1 as k, count(*) over () as m from (select distinct conv_id from conversations)),
     d as (select distinct ('0x' || {_O.format('id')})::bigint % (select max(m) from g) as k from range(20) r(id))
select conv_id, turn from conversations semi join (select conv_id from g join d using (k)) using (conv_id)
""")
def sampled_with_replacement(spark, sf_dir):
    """Twenty draws with replacement."""
    return S.sample_groups(_read(spark, sf_dir, "conversations"), "conv_id", 20, replacement=True).select("conv_id", "turn")


@register("random_examples", f"""
with p as (select vec_id, row_number() over (order by {_O.format('vec_id')}, vec_id) - 1 as k, count(*) over () as n from embeddings),
     q as (select conv_id, j, ('0x' || substr(md5(conv_id || ':' || j || ':42'), 1, 8))::bigint % (select max(n) from p) as k from (select distinct conv_id from conversations), range(52) r(j)),
     f as (select conv_id, k, row_number() over (partition by conv_id order by min(j)) as rank from q group by conv_id, k)
select conv_id, vec_id, rank from f join p using (k) where rank <= 5
""")
def random_examples(spark, sf_dir):
    """Five pool rows for each query, without replacement."""
    q = _read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return S.random_k(q, _read(spark, sf_dir, "embeddings").select("vec_id"), "conv_id", "vec_id", 5).select("conv_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@register("shuffle_order", f"select doc_id, row_number() over (order by {_O.format('doc_id')}, doc_id) as place from documents")
def shuffle_order(spark, sf_dir):
    """A seeded shuffle."""
    return ranked(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id", number="place")


@register("job_chunks", f"""
select conv_id, floor((row_number() over (order by {_O.format('conv_id')}, conv_id) - 1) / 50)::bigint as chunk from (select distinct conv_id from conversations)
""")
def job_chunks(spark, sf_dir):
    """Dialogues in chunks of fifty."""
    return S.jobs(_read(spark, sf_dir, "conversations"), "conv_id", 50).select("conv_id", F.col("chunk").cast("long").alias("chunk")).distinct()


@register("label_sets", """
with s as (select source, list_sort(list(distinct lang)) as langs from documents group by source)
select source, len(list_intersect(langs, ['en', 'fr', 'xx']))::bigint as both, len(list_filter(langs, lambda x: x not in ('en', 'fr', 'xx')))::bigint as only_here,
       len(list_filter(['en', 'fr', 'xx'], lambda x: not list_contains(langs, x)))::bigint as only_there, list_has_all(langs, ['en', 'fr']) as holds from s
""")
def label_sets(spark, sf_dir):
    """Intersection, differences and subset tests of sets."""
    s = _read(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    other = F.array(F.lit("en"), F.lit("fr"), F.lit("xx"))
    return s.select(
        "source", F.size(F.array_intersect("langs", other)).cast("long").alias("both"), F.size(F.array_except("langs", other)).cast("long").alias("only_here"),
        F.size(F.array_except(other, "langs")).cast("long").alias("only_there"), (F.size(F.array_except(F.array(F.lit("en"), F.lit("fr")), "langs")) == 0).alias("holds"),
    )


@register("short_hashes", "select doc_id, substr(translate(to_base64(unhex(sha256(text))), '+/', '-_'), 1, 12) as hash from documents")
def short_hashes(spark, sf_dir):
    """Short text hashes."""
    return _read(spark, sf_dir, "documents").select("doc_id", short_hash(F.col("text")).alias("hash"))


@register("short_documents", """
select doc_id, n from (select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), lambda x: x <> ''))::bigint as n from documents) where n <= 100
""")
def short_documents(spark, sf_dir):
    """A length filter over a projection."""
    from dialoom.functions.text import tokens

    d = _read(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))
    return d.where("n <= 100")


@register("position_slice", "select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as k from documents) where k in (0, 5, 17, 99)")
def position_slice(spark, sf_dir):
    """Rows by their positions."""
    return S.at_positions(_read(spark, sf_dir, "documents").select("doc_id"), (0, 5, 17, 99), "doc_id")
