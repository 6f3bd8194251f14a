"""Queries of the tokenizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import tokenize
from glyphmill.plans.registry import query, table
from glyphmill.ship import ship
from glyphmill.storage import bound_batches

LINES = "(SELECT doc_id, unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents)"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n")).alias("line"))


def _tokens_sql(rules) -> str:
    return f"list_filter(string_split_regex({tokenize.rewrite_sql('line', rules)}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"


def _summed(lines, tokens):
    return lines.select("doc_id", F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_tokens_sql(tokenize.TREEBANK)}) AS token FROM {LINES}) GROUP BY 1")
def treebank_tokens(spark, d):
    return _summed(_lines(spark, d), tokenize.treebank(F.col("line")))


@query(f"SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest({_tokens_sql(tokenize.BASIC)}) AS token FROM {LINES}) GROUP BY 1")
def basic_tokens(spark, d):
    return _summed(_lines(spark, d), tokenize.basic(F.col("line")))


def _symbols_sql(x: str) -> str:
    for c, new in tokenize.SYMBOLS.items():
        quoted = new.replace("'", "''")
        x = f"replace({x}, '{c}', '{quoted}')"
    return x


@query(f"SELECT page_id, md5({_symbols_sql('html')}) AS digest FROM pages")
def symbol_rewrite(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(tokenize.symbols(F.col("html"))).alias("digest"))


@query(f"SELECT doc_id, md5({tokenize.rewrite_sql('text', tokenize.REPEATS)}) AS digest FROM documents")
def repeat_rewrite(spark, d):
    ship(spark)
    bound_batches(spark)
    return table(spark, d, "documents").select("doc_id", F.md5(tokenize.repeats(F.col("text"))).alias("digest"))


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{tokenize.TWEET_WORD}', 1)) AS token FROM documents) GROUP BY 1")
def tweet_tokens(spark, d):
    return table(spark, d, "documents").select(F.explode(tokenize.tweet_words(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query()
def tweet_tagging(spark, d):
    ship(spark)
    c = table(spark, d, "conversations").select("conv_id", "turn", F.explode(tokenize.tweet_tags(F.col("text"))).alias("x"))
    return c.groupBy("conv_id", "turn", "x.tag").agg(F.count("*").alias("n"), F.min("x.start").alias("first_start"))
