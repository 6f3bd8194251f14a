"""Shards by extendible hashing.

The directory is indexed by the leading bits of a key's hash. Only buckets over
the byte limit split on another bit. Splitting goes by rounds of ``ROUND`` bits:
one aggregation finds the bytes of all prefixes that a round can reach below the
buckets still too large, and the shortest prefixes that fit become shards. Rows
carry only key, hash and size; no text is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm._shared import col, cut

BITS = 60
ROUND = 12


def key_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as a string; null counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def directory(rows: DataFrame, max_bytes: int) -> DataFrame:
    """``depth, prefix, bytes, n``: the shards of rows (h, size). A shard at full
    depth may lie over the limit: its rows share all bits of their hash."""
    big, found = None, None
    for low in range(0, BITS, ROUND):
        high = low + ROUND
        cells = rows.withColumn("top", F.shiftright("h", BITS - low) if low else F.lit(0).cast("bigint"))
        if big is not None:
            cells = cells.join(big, "top", "left_semi")
        cells = cells.groupBy("top", F.shiftright("h", BITS - high).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        cells = cut(cells)
        depths = list(range(low if low == 0 else low + 1, high + 1))
        levels = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("cell", high - d).alias("prefix")) for d in depths]))
        sums = cells.select("size", "n", levels.alias("x")).groupBy("x.depth", "x.prefix").agg(F.sum("size").alias("bytes"), F.sum("n").alias("n"))
        sums = cut(sums.withColumn("fits", (F.col("bytes") <= max_bytes) | (F.col("depth") == BITS)))
        parent = sums.where(~F.col("fits")).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        under = sums.where("fits").withColumn("up", F.shiftright("prefix", 1))
        # at a round's first depth every parent is a bucket known to be too large
        top = under.where(F.col("depth") == depths[0]).select("depth", "prefix", "bytes", "n")
        leaves = under.join(parent, ["depth", "up"], "left_semi").select("depth", "prefix", "bytes", "n").union(top)
        found = leaves if found is None else found.union(leaves)
        big = cut(sums.where(~F.col("fits") & (F.col("depth") == high)).select(F.col("prefix").alias("top")))
        if not big.limit(1).count():
            break
    return found


def shard(docs: DataFrame, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, depth, shard``: every row's shard, named by its hash
    prefix in ``depth`` binary digits ('' if one shard holds all).

    ``n_bytes`` is the text's size in UTF-8, 0 of a null text. Rows of one key,
    repeated rows and those with a null id among them, are never parted, nor is a
    text; so a shard goes over ``max_bytes`` only if all its keys share their 60
    bits, as one oversized document does; it then has depth 60. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = docs.select(col(id_col).alias("doc_id"), key_hash(col(id_col)).alias("h"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("bigint").alias("size"))
    found = cut(directory(rows.select("h", "size"), max_bytes))
    depths = [r[0] for r in found.select("depth").distinct().orderBy("depth").collect()]
    candidates = F.array(*[F.struct(F.lit(d).alias("depth"), (F.shiftright("h", BITS - d) if d else F.lit(0).cast("bigint")).alias("prefix")) for d in depths]) if depths else F.array().cast("array<struct<depth:int,prefix:bigint>>")
    placed = rows.withColumn("x", F.explode(candidates)).select("doc_id", "size", "x.depth", "x.prefix").join(found.select("depth", "prefix"), ["depth", "prefix"])
    name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return placed.select("doc_id", F.col("size").alias("n_bytes"), "depth", name.alias("shard"))


ORACLE = """
WITH r AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
p AS (SELECT d, h >> (60 - d) AS prefix, sum(n) AS bytes FROM r, (SELECT unnest(range(0, 61)) AS d) GROUP BY 1, 2),
leaf AS (SELECT r.doc_id, r.h, r.n, min(p.d) AS d FROM r JOIN p ON p.prefix = r.h >> (60 - p.d) WHERE p.bytes <= 131072 OR p.d = 60 GROUP BY ALL)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(d AS INTEGER) AS depth,
  CASE WHEN d = 0 THEN '' ELSE lpad(bin(h >> (60 - d)), CAST(d AS INTEGER), '0') END AS shard
FROM leaf
"""
