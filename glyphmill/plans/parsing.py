"""Queries of the parsers. Lines are made of the tables, parsed, and checked
against SQL on the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import tokenize
from glyphmill.plans.registry import query, table
from glyphmill.sources import readers
from glyphmill.storage import new_path

SQL_TOKENS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len(t) AS n_tokens, t[1] AS first_token FROM (SELECT doc_id, {SQL_TOKENS} AS t FROM documents)")
def line_tokens(spark, d):
    t = tokenize.whitespace(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.get(t, F.lit(0)).alias("first_token"))


@query("SELECT p_partkey, lower(string_split(p_name, ' ')[2]) || '_' || lower(string_split(p_name, ' ')[1]) AS joined, len(string_split(p_name, ' ')) AS n FROM part")
def column_parse(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", readers.columns(F.col("p_name"), " ", [1, 0], "_", lower=True).alias("joined"), F.size(readers.columns(F.col("p_name"), " ")).alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '+1' ELSE '-1' END AS label, 3 AS n_fields, l_quantity AS quantity, l_tax AS tax FROM lineitem")
def svmlight_parse(spark, d):
    t = table(spark, d, "lineitem")
    line = F.concat(F.when(F.col("l_returnflag") == "R", "+1").otherwise("-1"), F.lit(" q:"), F.col("l_quantity").cast("string"), F.lit(" d:"), F.col("l_discount").cast("string"), F.lit(" tax:"), F.col("l_tax").cast("string"), F.lit(" # note: "), F.col("l_linestatus"))
    x = t.select("l_orderkey", "l_linenumber", readers.svmlight(line).alias("x"))
    return x.select("l_orderkey", "l_linenumber", "x.label", F.size("x.fields").alias("n_fields"), F.col("x.fields")["q"].alias("quantity"), F.col("x.fields")["tax"].alias("tax"))


@query(f"SELECT doc_id, 2 * quality - 1 AS label, len({SQL_TOKENS}) AS n_tokens FROM documents JOIN labels USING (doc_id)")
def labelled_parse(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    x = readers.labelled(F.concat((2 * F.col("quality") - 1).cast("string"), F.lit("\t"), F.col("text")))
    return t.select("doc_id", x.alias("x")).select("doc_id", F.col("x.labels")[0].cast("int").alias("label"), F.size("x.content").alias("n_tokens"))


@query("SELECT p_partkey, list_value(p_brand, replace(p_type, ' ', '_')) AS content, list_value('NNP', 'NN') AS pos FROM part")
def treebank_parse(spark, d):
    tree = F.concat(F.lit("(S (NP (NNP "), F.col("p_brand"), F.lit(")) (VP (NN "), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit(")))"))
    return table(spark, d, "part").select("p_partkey", readers.treebank_leaves(tree).alias("x")).select("p_partkey", "x.content", "x.pos")


@query(f"SELECT CAST(conv_id AS VARCHAR) || '/' || turn AS key, role AS label, len({SQL_TOKENS}) AS n_tokens FROM conversations WHERE lower(role) <> 'system'")
def message_blocks(spark, d):
    c = table(spark, d, "conversations")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    blocks = c.select(readers.format_message(key, F.when(F.lower("role") == "system", "UNK").otherwise(F.col("role")), tokenize.whitespace(F.col("text"))).alias("value"))
    return readers.messages(blocks).select("key", "label", F.size("content").alias("n_tokens"))


@query("SELECT conv_id, turn, role AS author, regexp_extract_all(lower(replace(coalesce(text, ''), chr(9), ' ')), '(h[^\\n]{3}:/[^\\p{Zs}\\[]+|@[\\p{Ll}\\p{Lu}\\p{Nd}_]*|#[\\p{Ll}\\p{Lu}\\p{Nd}]*|[\\p{Ll}\\p{Lu}\\p{Nd}]+)', 1) AS content FROM conversations")
def tweet_parse(spark, d):
    """A tab, which parts columns, becomes a space."""
    return _tweets(table(spark, d, "conversations"))


def _tweets(c):
    text = F.translate(F.coalesce("text", F.lit("")), "\t", " ")
    x = readers.tweets(F.concat(F.col("turn").cast("string"), F.lit("\t"), F.col("role"), F.lit("\t"), text))
    return c.select("conv_id", "turn", x.alias("x")).select("conv_id", "turn", "x.author", "x.content")


@query("SELECT doc_id, CAST(sum(len(string_split_regex(regexp_replace(x, '[ \\t\\f\\r]+$', ''), '[ \\t\\f\\r]'))) AS BIGINT) AS n_tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) GROUP BY 1")
def document_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(readers.document_tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query("WITH w AS (SELECT s_nationkey AS nation, 0.5::DOUBLE * count(*) AS weight FROM supplier GROUP BY 1) SELECT CAST(c_custkey AS VARCHAR) AS value, weight FROM customer JOIN w ON c_nationkey = nation")
def file_weights(spark, d):
    """Lines of weighted files, here a file a nation with its customers; files of
    nations without suppliers aren't listed."""
    path = new_path(spark)
    c = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").cast("string").alias("value"))
    c.repartition("c_nationkey").write.partitionBy("c_nationkey").text(f"{path}/files")
    files = spark.createDataFrame([(f,) for f in readers.list_files(f"{path}/files", r"part-.*")], "name string")
    w = table(spark, d, "supplier").groupBy("s_nationkey").agg((F.count("*") * 0.5).alias("weight"))
    nation = F.regexp_extract("name", r"c_nationkey=(\d+)", 1).cast("bigint")
    listed = files.join(w, nation == F.col("s_nationkey")).select(F.concat_ws("\t", F.col("weight").cast("string"), "name").alias("value"))
    listed.write.text(f"{path}/list")
    return readers.read_weighted_lines(spark, f"{path}/list").select("value", "weight")


@query(f"SELECT conv_id, arg_min(role, turn) AS role, count(*) AS num_observations, CAST(sum(len({SQL_TOKENS})) AS BIGINT) AS n_tokens FROM conversations GROUP BY 1")
def batch_by_key(spark, d):
    c = table(spark, d, "conversations").withColumn("content", tokenize.whitespace(F.col("text")))
    return readers.merge_by_key(c, "conv_id", "turn", "content", ["role"]).select("conv_id", "role", F.col("num_observations").cast("bigint").alias("num_observations"), F.size("content").cast("bigint").alias("n_tokens"))


@query("WITH v AS (SELECT 'user' AS role, 1 AS vertex UNION ALL SELECT 'assistant', 2) SELECT conv_id, turn, vertex FROM conversations JOIN v USING (role)")
def communications_flatten(spark, d):
    """Communications of a conversation as messages, senders as vertices."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("messages"))
    v = spark.createDataFrame([("user", 1), ("assistant", 2)], "role string, vertex int")
    return c.select("conv_id", F.explode("messages").alias("m")).select("conv_id", "m.*").join(F.broadcast(v), "role").select("conv_id", "turn", "vertex")


@query("SELECT n_name AS src, r_name AS dst, CASE WHEN n_nationkey % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM nation JOIN region ON n_regionkey = r_regionkey")
def dictionary_load(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return readers.dictionary(n.select(F.concat_ws("\t", "n_name", "r_name", F.when(F.col("n_nationkey") % 2 == 0, "0.5")).alias("value")))


@query("SELECT role AS label, conv_id, chr(60) || 'message key=\"' || conv_id || '\" label=\"' || role || '\"' || chr(62) AS head FROM conversations")
def two_column_messages(spark, d):
    c = table(spark, d, "conversations")
    block = readers.format_message(F.col("conv_id"), F.col("role"), tokenize.whitespace(F.col("text")))
    return c.select(F.col("role").alias("label"), "conv_id", F.substring_index(block, "\n", 1).alias("head"))


@query("SELECT page_id, octet_length(encode(html)) AS utf8_bytes, length(html) AS latin_bytes FROM pages")
def recode_bytes(spark, d):
    p = table(spark, d, "pages")
    latin = readers.recode(F.encode("html", "UTF-8"), "UTF-8", "ISO-8859-1")
    return p.select("page_id", F.octet_length(F.encode("html", "UTF-8")).alias("utf8_bytes"), F.octet_length(latin).alias("latin_bytes"))


@query("SELECT n_nationkey, list_value(list_value(list_value(n_name, 'N')), list_value(list_value('a'), list_value('b', 'c'))) AS lattice FROM nation")
def analysis_lattice(spark, d):
    xml = F.concat(F.lit("<x><token><solution><part>"), F.col("n_name"), F.lit("</part><part>N</part></solution></token><token><solution><part>a</part></solution><solution><part>b</part><part>c</part></solution></token></x>"))
    return table(spark, d, "nation").select("n_nationkey", readers.lattice(xml).alias("lattice"))
