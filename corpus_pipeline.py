"""The corpus pipeline: toxic documents go, near duplicates go, repeated passages go, sources are mixed, and the mix is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents; the last returns the packed pieces (doc_id, piece, start, length,
ids_crc32, sequence_id, offset). ``run`` hands frames on; a caller may write each stage's result and read
it again, as the stages keep no state. A document that the mix takes more than once is packed as often.

Odd rows: a null text is scored, deduplicated, mixed and packed as the empty one (and stays null until it is
packed); a null id has no label and no duplicates; rows that repeat an id are one document to the near-duplicate
stage (all of them stay, or go) and documents of their own to the others; columns of any name pass through to the
last stage; an empty table passes through all stages.

ORACLE_SQL is None: scores, tokens and packing aren't SQL; the stages are tested against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import minhash, mixing, packing, suffixes, toxicity
from dialoom.llm.common import bucket_of, columns, cut, free_name, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The model learns from labelled documents of this stage's input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
    score = free_name(docs, "_toxic")
    return toxicity.scored(docs, model, score).where(F.col(score) < 0.5).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.deduplicated(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that also start earlier go from the texts; every document stays, if with an empty text."""
    return suffixes.rewritten(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("mix", mix),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table; each stage's rows are written out before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
