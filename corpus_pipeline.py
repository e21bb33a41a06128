"""A corpus pipeline of five stages: each takes (spark, docs, sf_dir) and returns a DataFrame.

Stages are written as Parquet and read again, so each begins from a table that any executor can
read. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import bpe, chain, jaccard_join, line_dedup, mixing
from eventide.llm.common import table, written
from eventide.llm.queries import VOCABULARY

# The classifier and the corpus statistics are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go."""
    return chain.judge(docs, table(spark, sf_dir, "labels")).where("not rejected").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents stay, with what is left of their text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return jaccard_join.keep_first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts taken by the mix: whole documents for each pass, parts where a pass takes a part."""
    out = mixing.mixed_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, how many there are, and the hash of what they decode to."""
    out = bpe.bpe(docs.select("doc_id", "source", "text"), VOCABULARY)
    return out.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("source_mix", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
