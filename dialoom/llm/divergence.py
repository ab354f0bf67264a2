"""How far a source's word use diverges from the other sources of its language, and which terms tell.

Relational: regexp matches are exploded and counted by language, source and term, with the documents of a term
counted in the same pass. Every group then meets the kept vocabulary of its language, so
that terms it lacks count zero; the dense table is joined with itself on the term (numbered within languages),
the divergences are summed by pair of groups, and windows rank them.

Each task adds up its own matches before anything is shuffled, in dictionary-coded arrays, at a fraction of the
cost of one row for each match. Shares are whole numbers of billionths, made digit by digit, so no product
passes 64 bits before counts of nine million billions. Groups meet their vocabulary by language and a salt, as one
language may hold most of it.

Defined cases: null text, language and source are read as ''; each row is a document, whatever its id; a group
without terms has shares too, and a language that keeps no term gives pairs of value 0; a source alone in its
language has no pairs; ties go to the smaller item by UTF-8 bytes; other columns don't matter; an empty table gives
an empty result. Memory: one text, and ``HELD`` matches.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import cut, text_bytes

#: Letters: ASCII ones, and all characters beyond ASCII (whose UTF-8 bytes are beyond it too).
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, TOP, SALT = 3, 200, 16
#: Matches that a task holds before it adds them up.
HELD = 2_000_000
COUNTS = "lang string, term string, n long, docs long, parts array<struct<source: string, n: long>>"
#: Bytes of a term, lower-cased; all others become 0.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256))


def _runs(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All matches of ``TERM`` in ``texts`` and how many each text has; a match is a longest run of a term's bytes, so one look at all bytes finds them."""
    joined = np.frombuffer((b"\0" + b"\0".join(texts) + b"\0").translate(_BYTES), np.uint8)
    inside = joined != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    offsets = np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    matches = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    return matches, np.diff(np.searchsorted(edges[::2], ends), prepend=0)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def _summed(lang: str, sources: list[str], sizes: list[np.ndarray], matches: list[pa.Array]) -> pa.RecordBatch:
    """One row for each term of texts of one language; ``sources`` go by text, ``sizes`` and ``matches`` by batch."""
    coded = pa.chunked_array(matches, pa.binary()).dictionary_encode().combine_chunks()
    term, terms = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    text = np.repeat(np.arange(len(sources)), np.concatenate(sizes))
    held = np.sort(text * terms + term)
    docs = np.bincount(held[_firsts(held)] % max(terms, 1), minlength=terms)
    names, of_text = np.unique(np.array(sources, object), return_inverse=True)
    pairs = np.sort(term * len(names) + of_text[text])
    at = _firsts(pairs)
    n, pairs = np.diff(at, append=len(pairs)), pairs[at]
    bounds = np.searchsorted(pairs, np.arange(terms + 1) * len(names)).astype(np.int32)
    parts = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(pairs % len(names))), pa.array(n, pa.int64())], ["source", "n"])
    columns = [pa.array([lang] * terms, pa.string()), coded.dictionary.cast(pa.string()), pa.array(np.bincount(term, minlength=terms), pa.int64()), pa.array(docs, pa.int64()), pa.ListArray.from_arrays(bounds, parts)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "n", "docs", "parts"])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text as bytes) -> the matches that a task has seen, added up."""
    seen: dict[str, tuple[list, list, list]] = {}
    held = 0
    for batch in batches:
        langs, sources, texts = (c.to_pylist() for c in batch.columns)
        for lang in dict.fromkeys(langs):
            rows = [i for i, x in enumerate(langs) if x == lang]
            matches, sizes = _runs([texts[i] for i in rows])
            for kept, more in zip(seen.setdefault(lang, ([], [], [])), ([sources[i] for i in rows], [sizes], [matches])):
                kept += more
            held += len(matches)
        if held > HELD:
            yield from (_summed(lang, *x) for lang, x in seen.items())
            seen, held = {}, 0
    yield from (_summed(lang, *x) for lang, x in seen.items())


def named(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def counted(docs: DataFrame) -> DataFrame:
    """(text, lang, source) -> (lang, term, n, docs, parts): what each task has counted; parts are (source, n)."""
    return docs.select(*named(docs), text_bytes("text").alias("text")).mapInArrow(_matches, COUNTS)


def kept(counts: DataFrame, least: int) -> DataFrame:
    """Counts of terms in ``least`` documents of their language, with (tid, lang_n, head): the term's number, its count, one row of each."""
    term = Window.partitionBy("term", "lang")  # sorted by term first, which tells rows apart at once
    rows = counts.withColumn("each", F.monotonically_increasing_id())
    rows = rows.select("lang", "term", "parts", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"), F.min("each").over(term).alias("tid"), "each")
    return rows.where(F.col("docs") >= least).select("lang", "term", "parts", "lang_n", "tid", (F.col("each") == F.col("tid")).alias("head"))


def quotient(a: Column, b: Column) -> Column:
    """Whole quotient of two longs."""
    return F.call_function("div", a, b)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + terms)), three digits at a time."""
    left, below, out = n + 1, total + terms, F.lit(1).cast("long")
    for worth in (1_000_000, 1_000, 1):
        out = out + quotient(left * 1000, below) * worth
        left = left * 1000 % below
    return out


def divergence(p: Column, q: Column) -> Column:
    return quotient((p - q) * (p - q), q)


def audited(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(text, lang, source) -> (lang, source, part, item, value, rank): pairs of sources, and the terms that a source overuses."""
    numbered = cut(kept(counted(docs), least))
    heads = numbered.where("head").select("lang", "term", "tid", "lang_n")
    parts = numbered.select("lang", "tid", F.explode("parts").alias("part")).select("lang", "tid", "part.*")
    totals = parts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = heads.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select(*named(docs)).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    whole = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total")]
    groups = cut(groups.select("lang", "source", F.monotonically_increasing_id().alias("gid"), *whole))
    dense = cut(densified(groups, heads, parts))
    return _pairs(groups, dense).unionByName(_terms(groups, heads, dense, top))


def densified(groups: DataFrame, heads: DataFrame, parts: DataFrame) -> DataFrame:
    """(tid, gid, n, p) for every group and every kept term of its language."""
    salted = groups.select("gid", "lang", F.explode(F.array(*[F.lit(x).cast("long") for x in range(SALT)])).alias("salt"))
    zeros = heads.select("lang", "tid", (F.col("tid") % SALT).alias("salt")).join(salted, ["lang", "salt"]).select("tid", "gid", F.lit(0).cast("long").alias("n"))
    counts = parts.join(groups.select("lang", "source", "gid"), ["lang", "source"]).select("tid", "gid", "n")
    dense = zeros.unionByName(counts).groupBy("tid", "gid").agg(F.sum("n").alias("n"))
    return dense.join(groups.select("gid", "total", "terms"), "gid").select("tid", "gid", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))


def _pairs(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """Each pair of sources of a language, by the sum over all kept terms."""
    own, other = dense.select("tid", "gid", "p"), dense.select("tid", F.col("gid").alias("other"), F.col("p").alias("q"))
    met = own.join(other, "tid").where("gid <> other")
    sums = cut(met.groupBy("gid", "other").agg(F.sum(divergence(F.col("p"), F.col("q"))).alias("value")))
    named = groups.select("lang", "source", "gid")
    pairs = named.join(named.select("lang", F.col("source").alias("item"), F.col("gid").alias("other")), "lang").where("gid <> other").join(sums, ["gid", "other"], "left")
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")))


def _terms(groups: DataFrame, heads: DataFrame, dense: DataFrame, top: int) -> DataFrame:
    """The terms of which a group has more than its language, the most telling first."""
    q = heads.join(groups.select("lang", "terms", "lang_total").distinct(), "lang").select("tid", "term", share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    rows = dense.where("n > 0").join(q, "tid").where("p > q").join(groups.select("gid", "lang", "source"), "gid")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


_SHARE = "1 + (1000000000 * ({n} + 1)::hugeint) // ({total} + {terms})"
ORACLE = f"""
with rows as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') as terms
  from documents),
each as (select id, lang, source, unnest(terms) as term from rows),
kept as (select lang, term, count(*) as n from each group by lang, term having count(distinct id) >= {LEAST_DOCUMENTS}),
langs as (select lang, count(*) as terms, sum(n) as total from kept group by lang),
groups as (select distinct lang, source from rows),
counts as (select lang, source, term, count(*) as n from each group by lang, source, term),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.n as lang_n
  from groups g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
totals as (select lang, source, sum(n) as total from dense group by lang, source),
shares as (
  select d.lang, d.source, d.term, d.n, {_SHARE.format(n="d.n", total="t.total", terms="l.terms")} as p,
         {_SHARE.format(n="d.lang_n", total="l.total", terms="l.terms")} as lang_p
  from dense d join totals t using (lang, source) join langs l using (lang)),
sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
found as (
  select g.lang, g.source, 'pair' as part, o.source as item, coalesce(s.value, 0) as value
  from groups g join groups o on g.lang = o.lang and g.source <> o.source
  left join sums s on s.lang = g.lang and s.source = g.source and s.item = o.source
  union all
  select lang, source, 'term', term, (p - lang_p) * (p - lang_p) // lang_p from shares where n > 0 and p > lang_p),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from found)
select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked where part = 'pair' or rank <= {TOP}
"""
