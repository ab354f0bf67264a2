"""The pipeline's stages on the smallest tables, each judged on its own input."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute
from conftest import DATA

import corpus_pipeline
from dialoom.llm.common import cut, table

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "suffix_dedup", "mix", "pack"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = cut(stage(spark, docs, DATA))
        if name == "pack":
            assert {r.doc_id for r in docs.collect()} == {i for i, _ in before}
            break
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        if name == "toxicity":
            assert 0.7 * len(before) < len(after) <= len(before) and set(after) <= set(before)
        elif name == "near_dedup":
            assert {i for i, _ in after} == {i for i, (_, c) in brute.near_classes(before).items() if c == i}
        elif name == "suffix_dedup":
            removed = brute.byte_repeats(before)
            assert {i for i, _ in after} == {i for i, _ in before}
            assert all((dict(before)[i] == t) == (removed[i][1] == 0) for i, t in after)
        elif name == "mix":
            assert set(after) <= set(before)


ODD = [(1, "trash " * 30, "en", "a", 180), (1, "trash " * 30, "en", "a", 180), (2, None, None, None, None), (None, "x y z", "en", "b", 5), (3, "", "en", "b", 0), (4, "long word " * 30_000, "en", None, 300_000)]


@pytest.mark.parametrize("rows", [[], ODD])
def test_odd_rows(rows, spark):
    """Empty tables, nulls, repeated rows, a very long text, and columns with clashing names, through each stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "`a.b` long, _toxic string, _mix long, _copy long, _id long, row long, tag long, c0 long, score double"
    docs = spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5, 6, 7, 0.5) for r in rows], f"{schema}, {extra}")
    columns, plain = docs.columns, docs.select("doc_id", "text")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name == "pack":
            assert out.count() >= len(rows) - 1 and out.columns[:2] == ["doc_id", "piece"]
            break
        assert out.columns == columns, name
        got = out.collect()
        assert len(got) <= 3 * len(rows) and all(r["a.b"] == 1 and r["_toxic"] == "t" and r["_id"] == 4 and r["row"] == 5 and r["score"] == 0.5 for r in got), name
    assert plain.count() == len(rows)


def test_mix_and_pack_by_definition(spark):
    """The mix repeats rows as its counts say; the packed pieces are the tokenizer's ids of what it is given."""
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from dialoom.llm import mixing, packing

    docs = table(spark, DATA, "documents").where("n_chars < 3000")
    mixed = corpus_pipeline.mix(spark, docs, DATA)
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(docs).select("doc_id", "mix.copies").collect() if r.copies})
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == copies
    frame = corpus_pipeline.pack(spark, mixed, DATA).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for i, text in docs.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 2048)], range(first, len(ids) + 1, 2048))):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += copies[i]
    assert Counter(frame[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == +want


def test_run(spark):
    """The stages one after another, whose rows make up the result."""
    docs = table(spark, DATA, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, DATA))
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(got.collect()) == sorted(corpus_pipeline.pack(spark, docs, DATA).select(*got.columns).collect())
