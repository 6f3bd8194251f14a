"""Queries of exact counters, filters, joins, sorting and merging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions.scalar import bucket, hash60
from glyphmill.plans.registry import query, table
from glyphmill.sources import readers

MD5 = "('0x' || substr(md5({x}), 1, 15))::BIGINT"


@query("SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def keyed_count(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("SELECT user_id, arg_max(event_type, event_id) AS last_type, count(*) > 1 AS was_set FROM events GROUP BY 1")
def last_set(spark, d):
    """The value set last for each key, and whether one was set before."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), (F.count("*") > 1).alias("was_set"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS seen_before FROM events")
def first_seen(spark, d):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, d, "events").select("event_id", "user_id", (F.row_number().over(w) > 1).alias("seen_before"))


@query("SELECT DISTINCT p_brand AS key FROM part")
def key_set(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("key")).distinct()


@query("SELECT p_brand AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 10")
def count_table(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("key")).agg(F.count("*").alias("n")).where("n >= 10")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def key_allow_list(spark, d):
    allowed = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(allowed, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS features FROM events GROUP BY 1 HAVING count(*) >= 50")
def user_features(spark, d):
    """Each user's distinct features, of users with enough records."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("event_type")).alias("features")).where("n >= 50").select("user_id", "features")


@query("WITH q AS (SELECT c_custkey AS key FROM customer UNION ALL SELECT -1) SELECT key, coalesce(n, 0) AS n FROM q LEFT JOIN (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1) USING (key)")
def counter_lookup(spark, d):
    """A query table looked up in counts; a key without a count has 0."""
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("key")).union(spark.range(1).select(F.lit(-1).cast("bigint")))
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    return q.join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def group_top_k(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "o_totalprice", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def global_k_least(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(20)


@query("SELECT p_name, max(p_retailprice) AS best FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def distinct_k_best(spark, d):
    """The k best keys, each counted once."""
    return table(spark, d, "part").groupBy("p_name").agg(F.max("p_retailprice").alias("best")).orderBy(F.desc("best"), "p_name").limit(20)


@query(f"SELECT event_id FROM (SELECT event_id, {MD5.format(x='CAST(event_id AS VARCHAR)')} AS h FROM events) ORDER BY h, event_id LIMIT 100")
def uniform_sample(spark, d):
    """A sample of 100 rows, those of the least hashes."""
    e = table(spark, d, "events")
    return e.withColumn("h", hash60(F.col("event_id").cast("string"))).orderBy("h", "event_id").limit(100).select("event_id")


@query(f"SELECT user_id, CAST({MD5.format(x='CAST(user_id AS VARCHAR)')} % 10 AS INTEGER) AS fold FROM events GROUP BY 1")
def k_fold(spark, d):
    """Folds by author, so that no author is in two."""
    return table(spark, d, "events").select("user_id").distinct().select("user_id", bucket(F.col("user_id").cast("string"), 10).cast("int").alias("fold"))


@query(f"SELECT user_id, CASE WHEN h < 90 THEN 'train' WHEN h < 91 THEN 'dev' ELSE 'test' END AS part FROM (SELECT DISTINCT user_id, {MD5.format(x='CAST(user_id AS VARCHAR)')} % 100 AS h FROM events)")
def train_dev_test(spark, d):
    h = bucket(F.col("user_id").cast("string"), 100)
    return table(spark, d, "events").select("user_id").distinct().select("user_id", F.when(h < 90, "train").when(h < 91, "dev").otherwise("test").alias("part"))


@query("SELECT p_brand AS feature, CAST(dense_rank() OVER (ORDER BY p_brand) AS BIGINT) AS id FROM (SELECT DISTINCT p_brand FROM part)")
def feature_map(spark, d):
    return readers.feature_ids(table(spark, d, "part").select(F.col("p_brand").alias("feature")))


@query("WITH f AS (SELECT l_returnflag AS feature, dense_rank() OVER (ORDER BY l_returnflag) AS id FROM (SELECT DISTINCT l_returnflag FROM lineitem)), v AS (SELECT l_orderkey AS key, id, count(*) AS n FROM lineitem JOIN f ON feature = l_returnflag GROUP BY 1, 2) SELECT key, CASE WHEN key % 2 = 0 THEN '+1' ELSE '-1' END || ' ' || string_agg(id || ':' || n, ' ' ORDER BY id) AS line FROM v GROUP BY key")
def instance_rows(spark, d):
    """Instances as lines: label and ids with values, ids by sorted feature."""
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("feature"))
    v = t.join(readers.feature_ids(t), "feature").groupBy("key", "id").agg(F.count("*").alias("value"))
    return readers.instance_lines(v.withColumn("label", F.when(F.col("key") % 2 == 0, 1).otherwise(-1)))


@query("SELECT DISTINCT * FROM (SELECT s_nationkey AS a, c_nationkey AS b FROM supplier JOIN customer ON s_suppkey = c_custkey UNION ALL SELECT c_nationkey, s_nationkey FROM supplier JOIN customer ON s_suppkey = c_custkey)")
def symmetric_pairs(spark, d):
    p = table(spark, d, "supplier").join(table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"))
    return p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
