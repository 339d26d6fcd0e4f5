"""A corpus pipeline from the operators in netloom.llm; each stage works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import op2_mixing, op6_pii, op7_jaccard, op8_packing, op10_quality
from netloom.llm.common import staged
from netloom.llm.queries import tokenizer_path
from netloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return op10_quality.keep_good(docs.select(COLUMNS), ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays."""
    ship(spark)
    return op7_jaccard.keep_one(docs.select(COLUMNS))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by surrogates in the texts; n_chars follows."""
    ship(spark)
    changed = op6_pii.replace_pii(docs.select(COLUMNS))
    return changed.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship(spark)
    return op2_mixing.mixed_rows(docs.select(COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 1024 tokens; the cache is smaller than op8's own, as idle workers keep theirs while other stages run."""
    ship(spark)
    return op8_packing.pack_documents(docs, tokenizer_path(), cache=250_000)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mixture", mixture), ("packing", packing)]
#: Voting, joins by similarity and tokens are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
