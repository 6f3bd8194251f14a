"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import scalar
from glyphmill.plans.counting import MD5
from glyphmill.plans.registry import query, table


@query(f"SELECT p_partkey, {MD5.format(x='p_name')} AS h, CAST({MD5.format(x="p_name || '#3'")} % 1000 AS INTEGER) AS bucket FROM part")
def salted_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.hash60(F.col("p_name")).alias("h"), scalar.bucket(F.col("p_name"), 1000, 3).cast("int").alias("bucket"))


@query("SELECT p_partkey, xor(p_partkey, p_partkey >> 1) AS gray, lpad(bin(xor(p_partkey, p_partkey >> 1)), 24, '0') AS bits FROM part")
def gray_code(spark, d):
    g = scalar.gray(F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", g.alias("gray"), scalar.bit_string(g, 24).alias("bits"))


@query("SELECT event_id, round(1 / (1 + exp(-value / 50)), 9) AS p, round(1 / (1 + exp(-value / 50)) - 0.5, 9) AS centred, CASE WHEN 1 / (1 + exp(-value / 50)) >= 0.7 THEN 1 ELSE -1 END AS decision, CAST(least(greatest(floor(value / 20), 0), 4) AS INTEGER) AS bin, round_even(value, 1) AS rounded FROM events")
def decisions(spark, d):
    p = scalar.sigmoid(F.col("value") / 50)
    return table(spark, d, "events").select("event_id", F.round(p, 9).alias("p"), F.round(scalar.sigmoid(F.col("value") / 50, True), 9).alias("centred"), scalar.decide_binary(p, 0.7, False).alias("decision"), scalar.decide_bin(F.col("value") / 20, 4).cast("int").alias("bin"), F.bround("value", 1).alias("rounded"))


@query("SELECT o_orderkey, abs(o_totalprice - 150000) AS absolute, CASE WHEN (o_totalprice > 150000) = (o_orderstatus = 'F') THEN 0 ELSE 1 END AS sign_loss, CASE WHEN o_totalprice > 300000 THEN o_orderstatus END AS gated FROM orders")
def losses(spark, d):
    t = table(spark, d, "orders")
    return t.select("o_orderkey", F.abs(F.col("o_totalprice") - 150000).alias("absolute"), F.when((F.col("o_totalprice") > 150000) == (F.col("o_orderstatus") == "F"), 0).otherwise(1).alias("sign_loss"), F.when(F.col("o_totalprice") > 300000, F.col("o_orderstatus")).alias("gated"))


@query("WITH h AS (SELECT n_nationkey, n_name, list_transform(range(1, length(n_name) + 1), lambda i: ascii(substr(n_name, i, 1))) AS b FROM nation) SELECT n_nationkey, array_to_string(list_transform(b, lambda x: chr(CAST(65 + x // 26 AS INTEGER)) || chr(CAST(65 + x % 26 AS INTEGER))), '') AS code, n_name AS back FROM h")
def letter_code(spark, d):
    code = scalar.letters(F.encode("n_name", "UTF-8"))
    return table(spark, d, "nation").select("n_nationkey", code.alias("code"), F.decode(scalar.unletters(code), "UTF-8").alias("back"))


@query("SELECT p_partkey, greatest(1, CAST(round(0.7::DOUBLE * (p_size * 1000.0::DOUBLE) / p_partkey) AS INTEGER)) AS hashes, round(power(0.6185::DOUBLE, p_size * 1000.0::DOUBLE / p_partkey), 9) AS error, CAST(ceil(p_partkey * ln(0.01) / ln(0.6185)) AS BIGINT) AS bits, CAST(floor(p_size * 1000 * ln(0.6185) / ln(0.01)) AS BIGINT) AS capacity FROM part WHERE p_partkey > 0")
def bloom_sizing(spark, d):
    m, n = F.col("p_size") * 1000.0, F.col("p_partkey")
    e = F.lit(0.01)
    return table(spark, d, "part").where("p_partkey > 0").select("p_partkey", scalar.bloom_hashes(m, n).alias("hashes"), F.round(scalar.bloom_error(m, n), 9).alias("error"), scalar.bloom_bits(n, e).cast("bigint").alias("bits"), scalar.bloom_capacity(m, e).cast("bigint").alias("capacity"))


@query("SELECT doc_id, CAST(sum(length(x)) AS BIGINT) AS characters, CAST(count(*) FILTER (WHERE regexp_full_match(x, '[A-Z][a-z]+')) AS BIGINT) AS capitalised, bool_or(contains(x, '?')) AS question FROM (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS x FROM documents) GROUP BY 1")
def text_features(spark, d):
    """Word lengths, tokens that wholly match a pattern, and questions."""
    from glyphmill.functions import tokenize

    c = tokenize.whitespace(F.col("text"))
    t = table(spark, d, "documents").select("doc_id", c.alias("c")).where(F.size("c") > 0)
    return t.select("doc_id", F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("characters"), F.size(F.filter("c", lambda x: x.rlike("^(?:[A-Z][a-z]+)$"))).cast("bigint").alias("capitalised"), F.exists("c", lambda x: x.contains("?")).alias("question"))


@query("SELECT o_orderkey, round(1 / (1 + exp(-(0.5 + 2e-6 * o_totalprice - 0.001 * o_custkey))), 9) AS confidence FROM orders")
def logistic_confidence(spark, d):
    scores = F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double"))
    return table(spark, d, "orders").select("o_orderkey", F.round(scalar.confidence(scores, [2e-6, -0.001], 0.5), 9).alias("confidence"))
