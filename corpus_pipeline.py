"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes what its predecessor kept, as written and read again, and its decisions take
effect: rejected documents go, frequent lines go, one document of each near-duplicate group stays,
repeated passages stay where they come first, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exchange, line_dedup, near_dedup, packing, quality_rules, substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars counts the text as it is now."""
    return df.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return _documents(quality_rules.quality(docs, keep=("text", "lang", "source")).where("kept"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents go, but from the last."""
    return _documents(line_dedup.dedup_lines(docs, keep=("lang", "source")))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group stays."""
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id")
    return _documents(docs.join(kept, "doc_id", "left_semi"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that an earlier document or place has go."""
    return _documents(substring_dedup.dedup_substrings(docs, keep=("lang", "source")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Tokens and packing have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else exchange.stored(out, f"stage-{name}")
    return docs
