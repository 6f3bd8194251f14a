"""Queries of the sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import sketch
from glyphmill.plans.counting import MD5
from glyphmill.plans.registry import query, table


def _positions(key: str, bits: int, salt: str) -> str:
    return f"{MD5.format(x=f"{key} || '#' || {salt}")} % {bits}"


@query(f"WITH b AS (SELECT DISTINCT {_positions('p_name', 65536, 'i')} AS p FROM part, range(1, 6) r(i) WHERE p_partkey % 3 = 0) SELECT p_name, count(b.p) = count(*) AS member FROM (SELECT DISTINCT p_name, {_positions('p_name', 65536, 'i')} AS p FROM part, range(1, 6) r(i)) LEFT JOIN b USING (p) GROUP BY 1")
def bloom_membership(spark, d):
    p = table(spark, d, "part")
    return sketch.bloom_probe(p, "p_name", sketch.bloom_build(p.where("p_partkey % 3 = 0"), "p_name", 65536, 5), 65536, 5)


@query(f"WITH k AS (SELECT DISTINCT c_name, 1 + c_custkey % 4 AS n FROM customer), b AS (SELECT DISTINCT {_positions('c_name', 16384, 'i')} AS p FROM k, range(1, 5) r(i) WHERE i <= n AND c_name LIKE '%1') SELECT c_name, count(b.p) = count(*) AS member FROM (SELECT DISTINCT c_name, {_positions('c_name', 16384, 'i')} AS p FROM k, range(1, 5) r(i) WHERE i <= n) LEFT JOIN b USING (p) GROUP BY 1")
def weighted_bloom(spark, d):
    """A Bloom filter in which each key has its own number of hashes."""
    c = table(spark, d, "customer")
    n = (F.col("c_custkey") % 4 + 1).cast("int")
    return sketch.bloom_probe(c, "c_name", sketch.bloom_build(c.where("c_name like '%1'"), "c_name", 16384, n), 16384, n)


GAINS = "SELECT event_type AS feature, k, sum(value) * (1 - power(0.5, k)) - k * count(*) * 10.0 AS gain FROM events, range(1, 6) r(k) GROUP BY 1, 2"


@query(f"SELECT feature, CAST(k AS INTEGER) AS k, round(gain, 4) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, k) AS r FROM ({GAINS}) WHERE gain > 0) WHERE r = 1")
def hash_allocation(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("feature")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    g = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5))))
    gain = F.col("s") * (1 - F.pow(F.lit(0.5), F.col("k"))) - F.col("k") * F.col("n") * 10.0
    return sketch.allocate(g.select("feature", "k", gain.alias("gain"))).withColumn("gain", F.round("gain", 4))


@query("SELECT user_id, feature, k, round(sum(0.5 ** before - 0.5 ** (before + k)), 6) AS coefficient FROM (SELECT user_id, event_type AS feature, k, coalesce(sum(used) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, 1 + event_id % 2 AS used FROM events)), range(1, 4) r(k) GROUP BY 1, 2, 3".replace("event_type AS feature, k, coalesce", "event_type AS feature, coalesce").replace("SELECT user_id, feature, k, round", "SELECT user_id, feature, CAST(k AS INTEGER) AS k, round"))
def allocation_coefficients(spark, d):
    """What k hashes of a feature are worth after those a user has had before."""
    return _coefficients(table(spark, d, "events"))


def _coefficients(events):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("before", F.coalesce(F.sum(F.col("event_id") % 2 + 1).over(w), F.lit(0)))
    worth = F.pow(F.lit(0.5), F.col("before")) - F.pow(F.lit(0.5), F.col("before") + F.col("k"))
    return e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).groupBy("user_id", F.col("event_type").alias("feature"), "k").agg(F.round(F.sum(worth), 6).alias("coefficient"))


@query(f"WITH c AS (SELECT user_id, list({MD5.format(x="user_id || '/' || event_id || '#7'")} ORDER BY event_id) AS coins FROM events GROUP BY 1) SELECT user_id, CAST(list_reduce(coins, lambda s, x: s + (x < power(2.0, 60 - s))::BIGINT, 0::BIGINT) AS INTEGER) AS state, CAST(power(2.0, list_reduce(coins, lambda s, x: s + (x < power(2.0, 60 - s))::BIGINT, 0::BIGINT)) - 1 AS BIGINT) AS estimate FROM c")
def morris_count(spark, d):
    return sketch.morris(table(spark, d, "events"), "user_id", "event_id")


@query()
def tomb_count(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return sketch.tomb_counts(c, "user_id", "n")


@query()
def reservoir_sum(spark, d):
    e = table(spark, d, "events").withColumn("v", F.col("value") / 50)
    return sketch.reservoir_sum(e, "user_id", "event_id", "v")


@query()
def approximate_reservoir(spark, d):
    """As reservoir_sum, with the votes themselves counted approximately."""
    e = table(spark, d, "events").withColumn("v", F.col("value") / 50)
    return sketch.reservoir_sum(e, "user_id", "event_id", "v", base=1.1)


@query()
def reservoir_average(spark, d):
    return sketch.reservoir_mean(table(spark, d, "events"), "user_id", "event_id", "value", bound=200.0)
