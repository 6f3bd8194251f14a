"""The queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import arc, decontaminate, knn, line_dedup, sharding
from glyphmill.llm.bpe import VOCABULARY, bpe_encode
from glyphmill.llm.language_id import identify_language, sample, train
from glyphmill.llm.minhash import near_duplicates
from glyphmill.llm.pii import surrogates
from glyphmill.llm.suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), min_words=50)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=3, min_containment=0.8)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates(docs, key="glyphmill")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), max_bytes=128 << 10)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.line_dedup(docs, max_ratio=0.05, min_pages=5, count_col="n_dropped").select("doc_id", "text", "n_dropped")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, min_jaccard=0.5, bands=48, per_band=4)


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.to_warc(arc.read_arc(arc.pages_as_arc(_table(spark, sf_dir, "pages"))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(sample(docs, per_language=400))
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", "pred_lang", "cross_entropy", "accepted")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all."""
    found = knn.top_k(_table(spark, sf_dir, "embeddings"), k=10, queries=F.col("vec_id") % 50 == 0)
    return found.withColumn("distance", F.round("distance", 6))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), VOCABULARY).drop("text")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_pii": op3_pii,
    "op4_sharding": op4_sharding,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash": op6_minhash,
    "op7_arc_to_warc": op7_arc_to_warc,
    "op8_language_id": op8_language_id,
    "op9_top_k": op9_top_k,
    "op10_bpe": op10_bpe,
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op7_arc_to_warc": arc.ORACLE,
    "op9_top_k": knn.ORACLE,
}
