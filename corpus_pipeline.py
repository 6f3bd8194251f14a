"""Corpus cleaning in five stages, each written as Parquet and reread by the next.

Languages are identified and unidentifiable documents go; boilerplate lines go;
one document of each group of near-duplicates stays; documents with benchmark
items go; the texts that are left are encoded and, as a check, decoded again.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from glyphmill.llm import bpe, decontaminate, language_id, line_dedup, minhash  # noqa: E402
from glyphmill.llm._shared import bound_batches, col, free_names, new_path  # noqa: E402


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is identified. Models are trained on up
    to 400 labelled documents a language."""
    bound_batches(spark)
    model = language_id.train(language_id.sample(docs, per_language=400))
    return language_id.drop_unidentified(docs, model)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; ``n_chars`` is counted anew. A
    document of which nothing is left goes."""
    [gone] = free_names(docs.columns, "lines_gone")
    out = line_dedup.line_dedup(docs, max_ratio=0.05, min_pages=5, count_col=gone)
    out = out.where((F.col(gone) == 0) | (F.trim(F.col("text"), F.lit(" \t\r\n")) != ""))
    return out.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*map(col, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near-duplicates."""
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    bound_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the texts' tokens, and whether they decode to the texts."""
    bound_batches(spark)
    return bpe.bpe_encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Cross-entropies, MinHash candidates and BPE merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark)
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
