"""Statistics of (key, feature, value) triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keys(triples: DataFrame) -> DataFrame:
    return triples.groupBy("key").agg(F.sum("value").alias("key_freq"))


def features(triples: DataFrame) -> DataFrame:
    """``feature, feature_freq, n_keys``: sum of values and number of keys."""
    return triples.groupBy("feature").agg(F.sum("value").alias("feature_freq"), F.count_distinct("key").alias("n_keys"))


def totals(triples: DataFrame) -> DataFrame:
    return triples.agg(F.count_distinct("key").alias("n_keys"), F.count_distinct("feature").alias("n_features"), F.sum("value").alias("total"))


def tfidf(triples: DataFrame, key_stats: DataFrame, feature_stats: DataFrame) -> DataFrame:
    """Values divided by the number of keys with the feature; triples whose key or
    feature is unknown to the statistics go."""
    known = triples.join(key_stats.select("key"), "key", "left_semi")
    return known.join(feature_stats.select("feature", "n_keys"), "feature").select("key", "feature", (F.col("value") / F.col("n_keys")).alias("value"))


def pmi(triples: DataFrame) -> DataFrame:
    """Pointwise mutual information, log(f * total / (key freq * feature freq))."""
    f = triples.groupBy("key", "feature").agg(F.sum("value").alias("f"))
    total = triples.agg(F.sum("value").alias("total"))
    joined = f.join(keys(triples), "key").join(features(triples).select("feature", "feature_freq"), "feature").crossJoin(F.broadcast(total))  # one row
    return joined.select("key", "feature", F.log(F.col("f") * F.col("total") / (F.col("key_freq") * F.col("feature_freq"))).alias("pmi"))
