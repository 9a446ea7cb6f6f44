"""A training-corpus pipeline: five stages, each one operator of ``barline.llm``.

A stage is a function of (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and hands what it reads back to the next stage. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import line_dedup, mixing, ngram_join, quality, sentencepiece_codec
from barline.llm.common import keep_table, table

#: SQL cannot train a classifier or solve for pieces; tests/llm checks stages by brute force.
ORACLE_SQL = None


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that occur earlier. A document goes when lines were taken from it
    and no line with a letter or digit is left; ``n_chars`` follows the text."""
    columns = docs.columns
    out = line_dedup.dedup_lines(docs)
    out = out.filter((F.size("removed") == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    if "n_chars" in columns:
        touched = F.when(F.size("removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", touched)
    return out.select(*columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.deal(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document taken."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality", drop_poor),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("mix", mix_sources),
    ("encode", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
