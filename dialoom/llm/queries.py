"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm import bpe, divergence, licenses, minhash, mixing, ogg, packing, quality, recompression, spelling, suffixes, topk, toxicity
from dialoom.llm.common import bucket_of, table


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as Ogg and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ogg.read_column(ogg.media_column("text")).alias("m"))
    return docs.select("doc_id", *[f"m.{c}" for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    docs = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    return packing.packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without word windows that start earlier."""
    return recompression.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest products of every fiftieth vector with all others."""
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without byte windows that start earlier."""
    return suffixes.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity; one fifth of the labels, by id, takes no part in training."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
    rows = toxicity.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of each document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality; one third of the labels, by id, takes no part in training."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 3) != 1)
    rows = quality.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's token ids and what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences between the sources of a language, and the terms that each overuses."""
    return divergence.audited(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's neighbours, form and root."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_ogg_media, op2_toxicity, op3_mix_sources, op4_pack_sequences, op5_minhash_dedup, op6_recompression_dedup, op7_exact_topk, op8_suffix_array_dedup, op9_license_scan, op10_quality, op11_bpe_codec, op12_source_divergence, op13_spelling_variants)}
ORACLES = {"op3_mix_sources": mixing.ORACLE, "op7_exact_topk": topk.ORACLE, "op9_license_scan": licenses.ORACLE, "op12_source_divergence": divergence.ORACLE}
