"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects ``target / source_size`` copies. The documents of a source stand
in one fixed order, their expected copies are prefix-summed, one random offset is added, and a
document is emitted once for each integer boundary that its stretch of the line crosses.

The order is dealt in hash buckets of about ``BUCKET_ROWS`` rows, so that a source with a third of all
rows is ranked by many tasks; in each bucket the rows run by size, up in even and down in odd buckets,
which spreads the emitted copies evenly over the sizes and keeps the taken words near the target.
The expectation is the same for all rows of a source, so a prefix sum is a rank times it. Of that order and
``ORDERS`` - 1 random ones, and ``OFFSETS`` offsets evenly spaced from a random first one, a source takes the
pair whose words come nearest its target: a source of few documents would else miss it by as much as its
largest documents. The choice is made on ranks and sizes alone; texts are dealt and ranked once, after it.

Defined cases: null or blank text has size 0 and takes no words; a null source is a source of its own,
ordered last; a null id hashes as the empty text; rows that repeat an id stand in the order of their texts'
hashes, rows that repeat both in any order, each with a place; an empty table gives an empty result; other
columns are kept, whatever their names, and a column named like the result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dialoom.llm.common import WORD, col, cut

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source's target exceeds so many times its size.
MAX_COPIES = 3
#: Expected rows of a bucket; hash cells that buckets are made of (a power of two).
BUCKET_ROWS, CELL_BITS = 1024, 16
SEED = "mix-1"
#: Orders and offsets (a power of two) of which a source takes the best.
ORDERS, OFFSETS = 8, 16


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(key, source_size, docs) -> those and target.

    Water filling: with sources by cap over weight, ascending, the level is the first
    (total - caps before) / (weights from here on) that is not above its own source's ratio.
    """
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(W.orderBy("key")) - 1) % len(weights) + 1).cast("int"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.col("total") - before) / after)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(W.partitionBy()))
    )
    return ranked.withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).select("key", "source_size", "docs", "target")


def _copies(offset: Column, cap: int) -> Column:
    """Integer boundaries between a row's prefix sum and the one before it, both moved by ``offset``."""
    return F.least(F.lit(cap).cast("long"), F.floor(offset + F.col("k") * F.col("each")) - F.floor(offset + (F.col("k") - 1) * F.col("each")))


def _placed(docs: DataFrame, weights, cap: int, seed: str) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... with key, size, source_size, target and copies."""
    rows = docs.select(
        *[col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)],
        F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1")).alias("key"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("id"),
    ).withColumn("cell", F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % (1 << CELL_BITS))

    cells = cut(rows.groupBy("key", "cell").agg(F.count("*").alias("docs"), F.sum("size").alias("words")))
    sources = targets(cells.groupBy("key").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs")), weights, cap)
    bits = F.greatest(F.lit(0.0), F.least(F.lit(float(CELL_BITS)), F.ceil(F.log2(F.col("docs") / F.lit(float(BUCKET_ROWS))))))
    sources = sources.withColumn("shift", F.lit(CELL_BITS) - bits.cast("int"))
    bucket = F.expr("shiftright(cell, shift)")
    starts = (
        cells.select("key", "cell", F.col("docs").alias("n"))
        .join(sources, "key")
        .groupBy("key", bucket.alias("bucket"), "source_size", "target", "shift")
        .agg(F.sum("n").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    # a row's bucket follows from its cell, and every cell of the rows is in ``cells``
    cell_starts = cells.select("key", "cell").join(sources.select("key", "shift"), "key").withColumn("bucket", bucket).drop("shift").join(starts.drop("shift", "n"), ["key", "bucket"])
    cell_starts = cut(cell_starts)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    dealt = rows.join(cell_starts, ["key", "cell"]).withColumn("each", each)

    def ranked(some: DataFrame) -> DataFrame:
        """With the prefix rank ``k`` of each row in the order numbered ``o``."""
        turn = F.when(F.col("o") == 0, F.when(F.col("bucket") % 2 == 0, F.col("size")).otherwise(-F.col("size")))
        drawn = F.when(F.col("o") > 0, F.md5(F.concat(F.col("o").cast("string"), F.lit(":"), F.col("id"))))
        return some.withColumn("k", F.col("before") + F.row_number().over(W.partitionBy("key", "bucket", "o").orderBy(turn, drawn, F.length("id"), "id")))

    first = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("key"))), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)
    offsets = [(first + F.lit(j / OFFSETS)) - F.floor(first + F.lit(j / OFFSETS)) for j in range(OFFSETS)]
    slim = dealt.select("key", "bucket", "before", "size", "id", "target", "each", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("o"))
    tried = ranked(slim).groupBy("key", "o", "target").agg(*[F.sum(_copies(x, cap) * F.col("size")).alias(f"w{j}") for j, x in enumerate(offsets)])
    misses = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{j}") - F.col("target")).alias("miss"), F.col("o"), F.lit(j).alias("j"), offsets[j].alias("offset")) for j in range(OFFSETS)]))
    chosen = cut(tried.groupBy("key").agg(F.min(misses).alias("b")).select("key", "b.o", "b.offset"))  # one row for each source
    return ranked(dealt.join(chosen, "key")).withColumn("copies", _copies(F.col("offset"), cap))


def mix(docs: DataFrame, out: str = "mix", weights=WEIGHTS, cap: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) and a struct column ``out``: size, source_size, target, copies."""
    rows = _placed(docs, weights, cap, seed)
    kept = [(i, c) for i, c in enumerate(docs.columns) if c != out]
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in kept], F.struct("size", "source_size", "target", "copies").alias(out))


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is emitted, with the columns of ``docs``."""
    rows = _placed(docs, weights, cap, seed).where("copies > 0")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


#: Spells out the same definition for DuckDB.
ORACLE = rf"""
with rows as (
  select doc_id, coalesce('0' || source, '1') as key,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
         coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) as id
  from documents
), celled as (
  select *, (('0x' || substr(md5(id), 1, 8))::bigint) % {1 << CELL_BITS} as cell from rows
), sized as (
  select key, sum(size)::bigint as source_size, count(*) as docs from rows group by key
), weighed as (
  select *, list_extract([{', '.join(f'{x:.1f}' for x in WEIGHTS)}], ((row_number() over (order by key) - 1) % {len(WEIGHTS)} + 1)::int)::double as weight,
         {MAX_COPIES}.0::double * source_size as cap, (sum(source_size) over ())::double as total
  from sized
), levels as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, key rows between unbounded preceding and 1 preceding), 0.0))
          / sum(weight) over (order by cap / weight, key rows between current row and unbounded following) as own
  from weighed
), leveled as (
  select *, max(case when own <= cap / weight then own end) over () as level from levels
), sources as (
  select key, source_size, docs, least(cap, level * weight) as target,
         {CELL_BITS} - greatest(0, least({CELL_BITS}, ceil(log2(docs / {BUCKET_ROWS}.0::double))))::int as shift
  from leveled
), bucketed as (
  select c.*, s.source_size, s.target, c.cell >> s.shift as bucket from celled c join sources s using (key)
), placed as (
  select *, row_number() over (
    partition by key, o order by bucket, case when o = 0 then case when bucket % 2 = 0 then size else -size end end,
    case when o > 0 then md5(o::varchar || ':' || id) end, length(id), id
  ) as k
  from bucketed, range({ORDERS}) r(o)
), stretched as (
  select *, case when source_size > 0 then target / source_size else 0.0::double end as each,
         (('0x' || substr(md5('{SEED}' || key), 1, 5))::bigint)::double / 1048576.0::double as first
  from placed
), tried as (
  select *, first + j / {OFFSETS}.0::double - floor(first + j / {OFFSETS}.0::double) as start from stretched, range({OFFSETS}) r(j)
), counted as (
  select *, (least({MAX_COPIES}, floor(start + k * each) - floor(start + (k - 1) * each)) * size)::bigint as taken from tried
), misses as (
  select key, o, j, abs(sum(taken) - any_value(target)) as miss from counted group by key, o, j
), chosen as (
  select key, o, j from (select *, row_number() over (partition by key order by miss, o, j) as place from misses) where place = 1
)
select doc_id, size, source_size, target, taken from counted join chosen using (key, o, j)
"""
