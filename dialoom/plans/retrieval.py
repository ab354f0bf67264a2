"""Queries of vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.catalog import register
from dialoom.operators import retrieve as R
from dialoom.operators.encode import encoded
from dialoom.operators.vectors import Index

_SCORES = """
with s as (
  select q.vec_id as q, i.vec_id as id, i.label, round(list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda z: z[1]::double * z[2]::double)), 6) as score
  from embeddings q, embeddings i where q.vec_id % 20 = 0
), r as (select *, row_number() over (partition by q order by score desc, id) as rank from s)
"""


def _both(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))


@register("vector_top_k", _SCORES + "select q, id, rank::bigint as rank, score from r where rank <= 10")
def vector_top_k(spark, sf_dir):
    """Exact top ten by inner product."""
    return R.top_k(*_both(spark, sf_dir), 10, digits=6).select("q", "id", F.col("rank").cast("long").alias("rank"), "score")


@register("vector_distinct_top_k", _SCORES + """
, f as (select *, row_number() over (partition by q, label order by rank) = 1 as fresh from r where rank <= 20),
  d as (select *, sum(fresh::int) over (partition by q order by rank) as nth from f),
  p as (select *, row_number() over (partition by q order by (fresh and nth <= 4) desc, rank) as place from d)
select q, id, label::bigint as label, place::bigint as place from p where place <= 8
""")
def vector_distinct_top_k(spark, sf_dir):
    """Four different labels first, then by rank."""
    got = R.distinct_top_k(*_both(spark, sf_dir), k=8, key="label", distinct=4, overfetch=20, digits=6)
    return got.select("q", "id", F.col("label").cast("long").alias("label"), F.col("place").cast("long").alias("place"))


@register("encoded_turns", """
with t as (select conv_id, turn, coalesce(text, '') as text from conversations),
g as (select conv_id, turn, (unicode(text[i]) * 961 + unicode(text[i + 1]) * 31 + unicode(text[i + 2])) % 256 as b from (select *, unnest(range(1, length(text) - 1)) as i from t)),
c as (select conv_id, turn, b, count(*) as n from g group by all)
select conv_id, turn, count(b)::bigint as buckets, coalesce(min_by(b, (-n, b)), -1)::bigint as best, round(coalesce(max(n) / sqrt(sum(n * n)), 0), 6)::double as share from t left join c using (conv_id, turn) group by conv_id, turn
""")
def encoded_turns(spark, sf_dir):
    """R2, T5: turns as vectors of hashed character trigrams, by the worker's own encoder; how many buckets each has, and its largest."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    v = encoded(c, "text")
    top = F.array_max("v")
    best = F.when(top > 0, F.array_position("v", top) - 1).otherwise(F.lit(-1))
    return v.select("conv_id", "turn", F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("buckets"), best.cast("long").alias("best"), F.round(F.coalesce(top, F.lit(0.0)), 6).alias("share"))


@register("nearest_turns", """
with t as (select conv_id * 1000 + turn as id, coalesce(text, '') as text from conversations),
g as (select id, (unicode(text[i]) * 961 + unicode(text[i + 1]) * 31 + unicode(text[i + 2])) % 256 as b from (select *, unnest(range(1, length(text) - 1)) as i from t)),
c as (select id, b, count(*) as n from g group by all), l as (select id, sqrt(sum(n * n)) as l from c group by id),
s as (select a.id as q, b.id, round(sum(a.n * b.n) / (any_value(x.l) * any_value(y.l)), 6) as score from c a join c b on a.b = b.b and b.id % 3 = 0 join l x on x.id = a.id join l y on y.id = b.id where a.id % 20 = 1 group by a.id, b.id),
z as (select q.id as q, i.id, coalesce(s.score, 0) as score from t q join t i on i.id % 3 = 0 left join s on s.q = q.id and s.id = i.id where q.id % 20 = 1)
select q, round(sum(score), 4)::double as total from (select *, row_number() over (partition by q order by score desc, id) as r from z) where r <= 3 group by q
""")
def nearest_turns(spark, sf_dir):
    """The three turns of an index whose encoded text is nearest to that of each twentieth turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    v = encoded(c, "text").drop("text")
    near = R.top_k(v.where("id % 20 = 1").select(F.col("id").alias("q"), F.col("v").alias("qv")), v.where("id % 3 = 0"), 3, digits=6)
    return near.groupBy("q").agg(F.round(F.sum("score"), 4).alias("total"))


@register("vector_norms", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, 1.0::double as after from embeddings")
def vector_norms(spark, sf_dir):
    """R2: lengths before and after normalisation."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = R.normalised(F.transform("embedding", lambda x: x.cast("double")))
    return e.select("vec_id", F.round(F.sqrt(R.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.sqrt(R.dot(n, n)), 6).alias("after"))


@register("pooled_vectors", """
select label::bigint as label, round(list_sum(list_transform(range(1, 65), lambda i: (m[i] / sqrt(list_sum(list_transform(m, lambda x: x * x)))))), 5) as total
from (select label, list_transform(range(1, 65), lambda i: list_avg(list_transform(vs, lambda v: v[i]::double))) as m from (select label, list(embedding order by vec_id) as vs from embeddings group by label))
""")
def pooled_vectors(spark, sf_dir):
    """R2: a label's mean vector, to unit length, summed."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    g = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vs"))
    pooled = R.mean_pooled(F.col("vs"), F.transform("vs", lambda _: F.lit(1.0)))
    return g.select(F.col("label").cast("long").alias("label"), F.round(F.aggregate(pooled, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@register("injected_prompts")
def injected_prompts(spark, sf_dir):
    """The three nearest benchmark texts of each document before the first example of its whole text.

    A document has the vector of its id modulo the number of vectors, a benchmark text that of its own id.
    """
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), F.col("text").alias("found"))
    n = e.count()
    place = F.pmod(F.col("vec_id"), F.lit(n))
    index = b.join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    near = R.top_k(e.select(place.alias("q"), F.col("embedding").alias("qv")), index, 3, digits=6)
    docs = near.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "found"))), lambda x: x["found"]).alias("docs"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("q", F.pmod("doc_id", F.lit(n)))
    prompt = R.inject(F.concat(F.coalesce("text", F.lit("")), F.lit("# Example 1")), F.coalesce("docs", F.expr("cast(array() as array<string>)")))
    return d.join(docs, "q", "left").select("doc_id", F.md5(prompt).alias("prompt"))


@register("grown_index", """
with i as (select vec_id as id, label, embedding from embeddings where vec_id % 3 = 0 union all select vec_id, label, embedding from embeddings where vec_id % 3 = 1
           union all select vec_id, null, embedding from embeddings where vec_id % 30 = 1),
s as (select q.vec_id as q, i.id, i.label, round(list_sum(list_transform(list_zip(q.embedding, i.embedding), lambda z: z[1]::double * z[2]::double)), 6) as score from embeddings q, i where q.vec_id % 20 = 2),
r as (select *, row_number() over (partition by q order by score desc, id) as rank from s)
select q, rank::bigint as rank, id, score, (select count(*) from i)::bigint as rows from r where rank <= 5
""")
def grown_index(spark, sf_dir):
    """An index of a third of the rows, warm, grown by another third and by a tenth of that once more, without labels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    index = Index.fit(R.warm(rows.where("id % 3 = 0"), rows.limit(1), 10), cells=8)
    index = index.grown(rows.where("id % 3 = 1")).grown(rows.where("id % 30 = 1").drop("label"))
    got = R.top_k(e.where("vec_id % 20 = 2").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv")), index, 5, digits=6)
    return got.select("q", F.col("rank").cast("long").alias("rank"), "id", "score", F.lit(sum(n for _, n, _ in index.cells())).cast("long").alias("rows"))
