"""Boilerplate lines by their frequency within a site.

Lines are counted by host and 64-bit line hash, so the count shuffles hashes and
no text. Of the lines only those beyond the ratio remain, at most (average
distinct lines a page) / ``max_ratio`` per host; they come back to the documents
as one array per host. That table is written first, so Spark knows its size: it
is broadcast below spark.sql.autoBroadcastJoinThreshold and joined with a
shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import col, cut, free_names, quoted

BLANK = " \t\r"


def _key(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """``host, lines``: hashes of the lines on more than ``max_ratio`` of the
    host's pages, and on ``min_pages`` pages at least."""
    pages = docs.select(col(host_col).alias("host"), col(text_col).alias("t"))
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split("t", "\n"), _key), lambda x: x != ""), lambda x: F.xxhash64(x)))
    often = pages.select("host", F.explode(lines).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("total"))  # reads the hosts' column alone
    beyond = often.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > max_ratio * F.col("total"))
    return beyond.groupBy("host").agg(F.collect_list("h").alias("lines"))


def line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 5, count_col: str | None = None) -> DataFrame:
    """The documents without their hosts' boilerplate lines: all columns and rows,
    ``text_col`` rewritten; with ``count_col`` a column of how many lines went (one
    of that name already there is replaced).

    Every row is a page, repeated rows too. A null host is a host of its own. A
    null or empty text has no lines and stays as it is; an empty line is never
    boilerplate and stays. Lines are compared without blanks at their ends. A
    text whose lines all go becomes empty. An empty table stays empty.
    """
    host, lines, gone = free_names(docs.columns, "host", "lines", "gone")
    bad = cut(boilerplate_lines(docs, host_col, text_col, max_ratio, min_pages)).select(F.col("host").alias(host), F.col("lines").alias(lines))
    joined = docs.join(bad, docs[quoted(host_col)].eqNullSafe(bad[host]), "left")
    all_lines = F.split(col(text_col), "\n")
    keep = F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(F.col(lines), F.xxhash64(_key(x))), F.lit(False)) | (_key(x) == ""))
    out = joined.withColumn(gone, F.when(F.col(lines).isNotNull(), keep))
    text = F.when(F.col(gone).isNull(), col(text_col)).otherwise(F.array_join(gone, "\n"))
    columns = [text.alias(c) if c == text_col else col(c) for c in docs.columns if c != count_col]
    if count_col:
        columns.append(F.when(F.col(gone).isNull(), 0).otherwise(F.size(all_lines) - F.size(gone)).alias(count_col))
    return out.select(columns)


ORACLE = """
WITH p AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT DISTINCT r, source, trim(x, E' \\t\\r') AS line FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS x FROM p)),
n AS (SELECT source, line, count(*) AS n FROM l WHERE line <> '' GROUP BY 1, 2),
t AS (SELECT source, count(*) AS total FROM p GROUP BY 1),
bad AS (SELECT n.source, line FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n >= 5 AND n > 0.05 * total),
per AS (SELECT source, list(line) AS lines FROM bad GROUP BY 1)
SELECT doc_id,
  CASE WHEN lines IS NULL OR text IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(lines, trim(x, E' \\t\\r'))), chr(10)) END AS text,
  CASE WHEN lines IS NULL OR text IS NULL THEN 0 ELSE len(list_filter(string_split(text, chr(10)), lambda x: list_contains(lines, trim(x, E' \\t\\r')))) END AS n_dropped
FROM p LEFT JOIN per ON p.source IS NOT DISTINCT FROM per.source
"""
