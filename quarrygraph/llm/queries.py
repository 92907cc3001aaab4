"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import linededup, mixing, quality
from .common import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op7_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import sample_segmentations

    found = sample_segmentations(documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"), k=2)
    return found.select(
        "doc_id",
        "round_trip",
        F.size("samples").alias("n_samples"),
        F.transform("samples", lambda s: F.size(s["ids"])).alias("n_pieces"),
        F.col("samples.log_prob").alias("log_prob"),
        F.col("samples.inclusion").alias("inclusion"),
        F.col("samples.ids_crc32").alias("ids_crc32"),
        F.col("samples.ids").alias("ids"),
    )


def op8_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classed

    return classed(documents(spark, sf_dir))


def op9_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(documents(spark, sf_dir), 24)


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every text, read as raw 8-bit samples, are the media column."""
    from .chroma import BYTES, fingerprints, search

    media = documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("media")
    )
    found = search(fingerprints(media, BYTES), F.coalesce(F.col("id") % 50 == 0, F.lit(False)), excerpts=True)
    return found.withColumnRenamed("id", "doc_id")


def op2_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn_profiles, predict_languages

    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    keyed = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    profiles = learn_profiles(keyed.filter(~F.col("held_out")))
    return predict_languages(keyed, profiles)


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(documents(spark, sf_dir)).select(
        "doc_id",
        F.col("__source").alias("source"),
        F.col("__lang").alias("lang"),
        F.col("__topic").alias("topic"),
        F.col("__tokens").alias("n_tokens"),
        F.round("ratio", 6).alias("weight"),
        F.round("prob", 6).alias("prob"),
        "sampled",
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixdedup import dedup_substrings

    return dedup_substrings(documents(spark, sf_dir), keep_bytes=False).withColumnRenamed("kept", "kept_sha256")


QUERIES = {
    "op1_chroma_fingerprints": op1_chroma_fingerprints,
    "op2_rank_order_language": op2_rank_order_language,
    "op3_quality_cascade": op3_quality_cascade,
    "op4_raked_mix": op4_raked_mix,
    "op6_line_dedup": op6_line_dedup,
    "op5_token_counts": op5_token_counts,
    "op7_gumbel_segmentations": op7_gumbel_segmentations,
    "op8_weighted_minhash": op8_weighted_minhash,
    "op9_virtual_slot_shards": op9_virtual_slot_shards,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_cascade": quality.SQL,
    "op4_raked_mix": mixing.SQL,
    "op6_line_dedup": linededup.SQL,
}
