"""One query for each operator, over whole tables and with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import op1_substring, op2_mixing, op3_fingerprint, op4_media, op5_ppm, op6_pii, op7_jaccard, op8_packing, op9_sharding, op10_quality, sql


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_substring.dedup(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing.mix(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_fingerprint.edited_report(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_media.media_report(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_ppm.ppm_scores(table(spark, sf_dir, "documents"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_sharding.assign_shards(table(spark, sf_dir, "documents"))


def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_mix_sources, op3_fingerprints, op4_media_columns, op5_lm_scores, op6_pii_surrogates, op7_jaccard_join, op8_best_fit_packing, op9_shards, op10_quality_votes, pipeline)}

#: What SQL can say (see sql.py); tests/llm holds the others against brute force.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": sql.OP1, "op2_mix_sources": sql.op2(op2_mixing.PASSES), "op7_jaccard_join": sql.OP7, "op9_shards": sql.OP9}
