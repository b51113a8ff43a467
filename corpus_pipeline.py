"""The corpus pipeline: raw documents in, a mix of clean documents out.

Each stage works on what the one before kept and returns the columns of its input, but for the last one, which
returns the mix: ``doc_id, size, source_size, target, taken``. Stages don't hold documents on the driver or in caches, so
that each can be written and read again on its own.

Every stage takes any table with the columns of ``documents``, others beside them, and empty ones. A null text counts as
empty (the first stage drops it); rows that repeat an id or a text are rows of their own, but for near copies, of which one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsieve.llm import decontam, language_id, line_dedup, mixing, near_copies
from glyphsieve.llm.common import OWN, new_path, read_table, remove, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' ``lang``; those whose text is null or without a letter go. No score rejects any. Without any
    ``lang`` there is nothing to learn from, and all go."""
    return language_id.keep_identified(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that five documents hold stay in the one with the largest id (null last); ``text`` and ``n_chars`` follow.
    A null text becomes an empty one."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{OWN}n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked; of each component the document with the least id stays
    (null last; of rows that share the id the one whose text has the least hash). Texts without words are alike."""
    return near_copies.keep_firsts(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten benchmark words, or a shorter item whole, go. An empty benchmark drops none."""
    return decontam.scan(docs, read_table(spark, sf_dir, "benchmark")).where(F.col(f"{OWN}scan.n_hit") == 0).drop(f"{OWN}scan")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes. A null source is one of its own, the last; texts without words take nothing."""
    return mixing.report(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
]

#: A recurrent network and a pseudorandom permutation are beyond SQL; tests/llm holds each other stage's ids and texts against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written and read again; a stage's own tables go once its result is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
