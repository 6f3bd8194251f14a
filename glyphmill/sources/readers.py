"""Readers and writers of text formats, and parsers of their lines.

A parser is an expression or a function of DataFrames, so files of any number
are read and parsed in parallel; nothing goes through the driver but file names.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphmill.functions import tokenize
from glyphmill.storage import cut


def list_files(directory: str, pattern: str = ".*") -> list[str]:
    """Files below a directory, in order, whose base name wholly matches; in any
    file system that Spark reads, by its URL."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        found = [os.path.join(d, f) for d, _, files in os.walk(directory) for f in files if re.fullmatch(pattern, f)]
        return sorted(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    walk = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while walk.hasNext():
        at = walk.next().getPath()
        if re.fullmatch(pattern, at.getName()):
            found.append(at.toString())
    return sorted(found)


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``value, file``: lines of plain or .gz files."""
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def read_weighted_lines(spark: SparkSession, list_path: str) -> DataFrame:
    """``value, file, weight`` of a list of ``weight<TAB>file`` lines; lines that
    begin with # don't count."""
    listed = spark.read.text(list_path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t", 2)
    rows = listed.select(parts[0].cast("double").alias("weight"), parts[1].alias("name")).collect()  # as many as files listed
    if not rows:
        return spark.createDataFrame([], "value string, file string, weight double")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def whole(name: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(conf).makeQualified(path).toString()

    weights = spark.createDataFrame([(whole(r["name"]), r["weight"]) for r in rows], "name string, weight double")
    lines = read_lines(spark, sorted({r["name"] for r in rows}))
    # a path as files have it: no escapes, one slash after the scheme
    path = F.regexp_replace(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    return lines.withColumn("name", path).join(weights, "name").select("value", "file", "weight")


def read_documents(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``key, value``: a record for each file, its path as the key."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("key"), "value")


def read_messages(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Message blocks of files; see ``messages``."""
    return messages(spark.read.option("lineSep", "</message>").text(paths))


def document_tokens(text: Column) -> Column:
    """Tokens of a whole document, split at every single blank: runs of blanks
    give empty tokens, trailing ones of a line don't count."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.split(F.regexp_replace(x, r"[ \t\x0B\f\r]+$", ""), r"[ \t\x0B\f\r]"))
    return F.flatten(lines)


def columns(line: Column, sep: str, fields: list[int] | None = None, conjoin: str | None = None, lower: bool = False, tokenizer=None) -> Column:
    """Delimited columns: all or some of them, lower case if wanted, each made
    into tokens by ``tokenizer``, or all joined into one string."""
    parts = F.split(F.lower(line) if lower else line, sep)
    chosen = F.array(*[F.get(parts, F.lit(i)) for i in fields]) if fields is not None else parts
    if tokenizer is not None:
        chosen = F.flatten(F.transform(F.filter(chosen, lambda x: x.isNotNull()), tokenizer))
    return F.array_join(chosen, conjoin) if conjoin is not None else chosen


def svmlight(line: Column) -> Column:
    """struct(label, fields map<string,double>) of ``label id:value ... # note``."""
    text = F.trim(F.regexp_replace(line, r"\s#.*$", ""))
    parts = F.split(text, r"\s+")
    pairs = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.substring_index(x, ":", -1).cast("double").alias("v")))
    return F.struct(parts[0].alias("label"), F.map_from_entries(pairs).alias("fields"))


def labelled(line: Column) -> Column:
    """struct(labels, content) of ``label(,label)*<TAB>content``."""
    parts = F.split(line, "\t", 2)
    return F.struct(F.split(parts[0], ",").alias("labels"), tokenize.whitespace(parts[1]).alias("content"))


def treebank_leaves(line: Column) -> Column:
    """struct(content, pos) of the innermost ``(TAG token)`` of a tree."""
    leaf = F.lit(r"\(([^\s()]+)\s+([^\s()]+)\)")
    return F.struct(F.regexp_extract_all(line, leaf, F.lit(2)).alias("content"), F.regexp_extract_all(line, leaf, F.lit(1)).alias("pos"))


def messages(blocks: DataFrame, text: str = "value", drop_label: str = "unk") -> DataFrame:
    """``key, label, content`` of ``<message key=... label=...>`` blocks, one a
    row. Blocks of the unknown label, in any case, and rests without a head go."""
    head = F.regexp_extract(text, r"<message\s+([^>]*)>", 1)
    attribute = lambda a: F.nullif(F.regexp_extract(head, rf"{a}=\"?([^\s\">]+)\"?", 1), F.lit(""))
    body = F.regexp_extract(text, r"(?s)<message\s+[^>]*>(.*?)(?:</message>|$)", 1)
    out = blocks.where(head != "").select(attribute("key").alias("key"), attribute("label").alias("label"), tokenize.whitespace(body).alias("content"))
    return out.where(F.col("label").isNull() | (F.lower("label") != drop_label))


def format_message(key: Column, label: Column, content: Column) -> Column:
    """A message block; a null label is left out."""
    return F.concat(F.lit('<message key="'), key.cast("string"), F.lit('"'), F.coalesce(F.concat(F.lit(' label="'), label.cast("string"), F.lit('"')), F.lit("")), F.lit(">\n"), F.array_join(content, " "), F.lit("\n</message>"))


def tweets(line: Column) -> Column:
    """struct(author, content) of ``id<TAB>author<TAB>text...``, in lower case."""
    parts = F.split(F.lower(line), "\t")
    return F.struct(F.get(parts, F.lit(1)).alias("author"), F.flatten(F.transform(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), tokenize.tweet_words)).alias("content"))


def dictionary(lines: DataFrame, text: str = "value") -> DataFrame:
    """``src, dst, weight`` of ``src<TAB>dst[<TAB>weight]`` lines, 1.0 by default."""
    p = F.split(text, "\t")
    return lines.select(p[0].alias("src"), F.get(p, F.lit(1)).alias("dst"), F.coalesce(F.try_to_number(F.get(p, F.lit(2)), F.lit("999999.999999")).cast("double"), F.get(p, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))


def merge_by_key(rows: DataFrame, key: str, order: str, content: str, firsts: list[str]) -> DataFrame:
    """One record a key: the first record's other fields, contents in order, how
    many there were, and all of them as ``communications``."""
    fields = [order, content, *firsts]
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
    return grouped.select(key, *[F.col("c")[0][f].alias(f) for f in firsts], F.flatten(F.transform("c", lambda x: x[content])).alias("content"), F.size("c").alias("num_observations"), F.col("c").alias("communications"))


def lattice(xml: Column) -> Column:
    """array per token of array per solution of its parts, from analyses like
    ``<token><solution><part>..</part></solution></token>``."""

    @F.pandas_udf("array<array<array<string>>>")
    def parse(texts):
        from xml.etree import ElementTree

        return texts.map(lambda t: None if t is None else [[[p.text or "" for p in s.iter("part")] for s in w.iter("solution")] for w in ElementTree.fromstring(t).iter("token")])

    return parse(xml)


def recode(data: Column, from_charset: str, to_charset: str) -> Column:
    """Bytes of one character set as bytes of another."""
    return F.encode(F.decode(data, from_charset), to_charset)


def write_counts(counts: DataFrame, path: str, threshold: float | None = None, key: str = "key", value: str = "value") -> None:
    """``key<TAB>value`` lines, those at the threshold or above if there is one."""
    rows = counts if threshold is None else counts.where(F.col(value) >= threshold)
    rows.select(F.concat_ws("\t", F.col(key), F.col(value).cast("string")).alias("value")).write.text(path, compression="gzip")


def write_keys(rows: DataFrame, path: str, key: str = "key") -> None:
    rows.select(F.col(key).cast("string").alias("value")).distinct().write.text(path, compression="gzip")


def instance_lines(instances: DataFrame) -> DataFrame:
    """``key, line``: ``label id:value ...`` with ids ascending, of rows (key,
    label, id, value)."""
    pair = F.struct(F.col("id"), F.concat(F.col("id").cast("string"), F.lit(":"), F.col("value").cast("string")).alias("t"))
    label = F.when(F.col("label") > 0, "+1").otherwise("-1")
    return instances.groupBy("key").agg(F.first(label).alias("l"), F.array_sort(F.collect_list(pair)).alias("p")).select("key", F.concat_ws(" ", "l", F.array_join(F.transform("p", lambda x: x["t"]), " ")).alias("line"))


def feature_ids(features: DataFrame) -> DataFrame:
    """``feature, id`` from 1 on in the features' order. Ids are dense over all, so
    counts of sorted partitions are summed instead of sorting in one task."""
    # written, so that places and sizes are of one and the same partitioning
    ordered = cut(features.select("feature").distinct().orderBy("feature").withColumn("p", F.spark_partition_id()))

    placed = ordered.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("feature")))
    sizes = placed.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(sizes), "p").select("feature", (F.col("before") + F.col("r")).alias("id"))  # a row a partition
