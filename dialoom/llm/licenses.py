"""License scan: phrases in place, and an exact set-similarity join of text blocks with license notices.

A block is a window of words: for a notice of n words, the 2n - 2 consecutive words of a text that begin with one of
the notices' words, whatever lines they stand on; so a notice may be wrapped, prefixed or broken up by fewer words
than it has, and words farther apart make no notice. A block meets a notice when it holds ``CONTAINMENT`` of the
notice's distinct words at least. Only the notices' words can match, so a block is its words out of these, put in the order of their
frequency over all documents, rarest first. The join then needs few candidates, and loses none:

- length: a block holds at least the ``need`` words that the notice asks for;
- prefix: if ``need`` words are shared, then one stands among the first ``size - need + 1`` words of either side;
- position: with a first shared word at places i and j, at most 1 + min(what follows i, what follows j) are shared.

What is left is compared in full. The notices are a short fixed list, so their side is broadcast. The texts
are read twice: for the words' frequencies, and to look up the notices that a text's own rare words lead to;
texts that hold enough words of one of these (a few per cent) are kept for the blocks.

Defined cases: null or wordless text has no words, places or labels, and score 0; rows that repeat are
scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.llm.common import cut

#: What separates words, after A-Z are lowered.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.9
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: (label, notice)
NOTICES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def need(words: int, containment: float = CONTAINMENT) -> int:
    """How many of a notice's words a block must hold."""
    return math.ceil(containment * words - 1e-9)


def reach(words: int) -> int:
    """How many words of a text a notice can stand among."""
    return max(words, 2 * words - 2)


def _plain(text: Column) -> Column:
    """A text's words with one space between."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lowered, BETWEEN, " "))


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column, phrases) -> Column:
    """Where the phrases start, from 0."""

    def at(i: Column) -> Column:
        found = F.lit(False)
        for p in phrases:
            same = F.lit(True)
            for k, w in enumerate(p.split()):
                same = same & (F.try_element_at(words, (i + 1 + k).cast("int")) == F.lit(w))
            found = found | F.coalesce(same, F.lit(False))
        return found

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), at)


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices=NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    phrases = PHRASES if phrases is None else phrases
    wanted = [(label, sorted(set(text.split()))) for label, text in notices]
    spans = [len(text.split()) for _, text in notices]
    vocabulary = sorted({w for _, words in wanted for w in words})
    words = F.split("plain", " ")
    inside = F.concat(F.lit(" "), F.col("plain"), F.lit(" "))
    has = {p: F.contains(inside, F.lit(f" {p} ")) for p in phrases}
    any_ = F.lit(False)
    for c in has.values():
        any_ = any_ | c
    plain = docs.select("doc_id", "text", _plain(F.col("text")).alias("plain"))
    known = F.array_intersect(_strings(vocabulary), words)
    # how many documents hold each notice word: one row for each at most
    order = [r.word for r in plain.select(F.explode(known).alias("word")).groupBy("word").count().orderBy("count", "word").collect()]
    order = [w for w in vocabulary if w not in order] + order
    rank = {w: i for i, w in enumerate(order)}
    prefixes, index = [], {}
    for k, (label, ws) in enumerate(wanted):
        ws, least = sorted(ws, key=rank.__getitem__), need(len(ws), containment)
        prefixes += [(w, spans[k], k, label, ws, i, len(ws), least) for i, w in enumerate(ws[: len(ws) - least + 1])]
        for w in ws[: len(ws) - least + 1]:
            index.setdefault(w, []).append(k)
    templates = docs.sparkSession.createDataFrame(prefixes, "word string, span int, notice int, label string, ws array<string>, i int, size int, least int")

    # a document takes part if it holds enough words of a notice that one of its words leads to
    leads = F.create_map(*[x for w, ks in index.items() for x in (F.lit(w), F.array(*map(F.lit, ks)))])
    met_by = F.array_distinct(F.flatten(F.transform(F.array_intersect("known", _strings(index)), lambda w: F.element_at(leads, w))))
    notices_words, needs = F.array(*[_strings(ws) for _, ws in wanted]), F.array(*[F.lit(need(len(ws), containment)) for _, ws in wanted])
    enough = F.exists(met_by, lambda k: F.size(F.array_intersect("known", F.element_at(notices_words, k + 1))) >= F.element_at(needs, k + 1))
    rows = plain.withColumn("known", known)
    rows = rows.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.when(F.col("plain") == "", F.lit(0)).otherwise(F.length("plain") - F.length(F.replace("plain", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        # the words are bound once; named in the predicate itself, they would be split anew at every place
        F.when(any_, F.element_at(F.transform(F.array(words), lambda w: _places(w, phrases)), 1)).alias("places"),
        F.array_compact(F.array(*[F.when(has[p], F.lit(label)) for p, label in phrases.items()])).alias("base"),
        "known",
        F.when(enough, F.col("text")).alias("text"),
    )
    rows = cut(rows)
    each = rows.where("text is not null").select("row", F.posexplode(F.split(_plain(F.col("text")), " ")).alias("at", "word")).where(F.col("word").isin(order))
    after = Window.partitionBy("row").orderBy("at").rangeBetween(0, reach(max(spans)) - 1)
    starts = each.select("row", "at", F.collect_list(F.struct("at", "word")).over(after).alias("next"))
    least_of = {n: min(need(len(ws), containment) for (_, ws), m in zip(wanted, spans) if m == n) for n in spans}
    starts = starts.where(F.size("next") >= min(least_of.values()))
    windows = F.array(*[F.struct(F.lit(n).alias("span"), F.lit(reach(n)).alias("reach"), F.lit(m).alias("fewest")) for n, m in sorted(least_of.items())])
    starts = starts.select("row", "at", "next", F.explode(windows).alias("w")).select("row", "at", "next", "w.*")
    run = F.filter("next", lambda x: x["at"] < F.col("at") + F.col("reach"))
    starts = starts.select("row", F.col("at").alias("line"), "span", "fewest", F.transform(run, lambda x: x["word"]).alias("run")).where(F.size("run") >= F.col("fewest"))
    blocks = starts.select("row", "line", "span", "fewest", F.array_intersect(_strings(order), "run").alias("block")).withColumn("m", F.size("block")).where(F.col("m") >= F.col("fewest"))
    pairs = blocks.select("row", "line", "span", "block", "m", F.posexplode(F.expr("slice(block, 1, m - fewest + 1)")).alias("j", "word")).join(F.broadcast(templates), ["word", "span"])
    pairs = pairs.where((F.col("m") >= F.col("least")) & (F.col("j") <= F.col("m") - F.col("least")) & (1 + F.least(F.col("size") - 1 - F.col("i"), F.col("m") - 1 - F.col("j")) >= F.col("least")))
    shared = F.size(F.array_intersect("block", "ws"))
    met = pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("least")).groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("met"), F.max(F.col("shared") / F.col("size")).alias("best"))
    return rows.join(met, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(F.coalesce("places", F.expr("array()"))), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("met", F.expr("cast(array() as array<string>)")))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    def plain(x: str) -> str:
        return f"regexp_extract_all(translate(coalesce({x}, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

    phrases = ", ".join(f"('{label}', {p.split()})" for p, label in PHRASES.items())
    notices = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))}, {need(len(set(t.split())))}, {reach(len(t.split()))})" for k, (label, t) in enumerate(NOTICES))
    return f"""
with phrases(label, ws) as (values {phrases}), notices(k, label, ws, least, reach) as (values {notices}),
texts as (select doc_id, text, {plain('text')} as words from documents),
places as (
  select t.doc_id, p.label, i from texts t, phrases p, range(0, len(t.words)) r(i)
  where list_contains(t.words, p.ws[-1]) and t.words[i + 1 : i + len(p.ws)] = p.ws
),
base as (
  select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, list_sort(list(distinct label)) as base from places group by doc_id
),
likely as (select doc_id, words, k from texts, notices where len(list_intersect(list_distinct(words), ws)) >= least),
windows as (
  select doc_id, k, list_distinct(words[i : i + reach - 1]) as block from (select *, unnest(range(1, len(words) + 1)) as i from likely) join notices using (k)
  where list_contains(ws, words[i])),
met as (
  select doc_id, list(distinct label) as met, max(len(list_intersect(block, ws))::double / len(ws)) as best
  from windows join notices using (k) where len(list_intersect(block, ws)) >= least group by doc_id
)
select t.doc_id, len(t.words)::bigint as n_words, coalesce(b.n_base, 0)::bigint as n_base, b.first_word::bigint as first_word, b.last_word::bigint as last_word,
       coalesce(array_to_string(b.base, ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base, []), coalesce(m.met, [])))), ','), '') as labels,
       case when b.n_base > 0 then 1.0 else coalesce(m.best, 0.0) end::double as score
from texts t left join base b using (doc_id) left join met m using (doc_id)
"""


ORACLE = _oracle()
