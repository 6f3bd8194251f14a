"""Helpers of the operators: cut lineage, name rows, tell texts apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import bound_batches, cut, free_names, new_path, quoted, shared_dir

__all__ = ["bound_batches", "col", "cut", "digest", "free_names", "map_rows", "marked", "new_path", "quoted", "shared_dir"]


def col(name: str) -> Column:
    """A top-level column by its name, which may hold dots."""
    return F.col(quoted(name))


def digest(text: Column) -> Column:
    """16 bytes that tell texts apart; null of null."""
    return F.unhex(F.md5(text))


def map_rows(df: DataFrame, f, schema) -> DataFrame:
    """mapInArrow of a table whose columns may have any names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(f, schema)


def marked(df: DataFrame, name: str, key: list[Column], members: DataFrame, of: list[Column], most: int = 1 << 26) -> DataFrame:
    """``df`` with a column ``name``, true of every row whose ``key`` is the key ``of``
    a row of ``members`` and of few others, so that a join need send no row for which
    it is false. Keys are places in a bitmap, broadcast in pages of 2**15 bits: 32
    bits or more for each member, up to ``most`` bits in all; of more than most / 32
    members more and more other rows are true too."""
    bits = max(1 << 15, min(most, 1 << (32 * members.count()).bit_length()))
    hashed = lambda k: F.pmod(F.xxhash64(*k), F.lit(bits))
    at, page, bitmap = free_names([*df.columns, name], "at", "page", "bitmap")
    places = members.select(hashed(of).alias("p")).select(F.shiftright("p", 15).alias(page), F.col("p").bitwiseAND(32767).alias("p"))
    pages = F.broadcast(places.repartition(page).groupBy(page).agg(F.bitmap_construct_agg("p").alias(bitmap)))
    found = df.withColumn(at, hashed(key)).join(pages, F.shiftright(at, 15) == F.col(page), "left")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(F.col(at).bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, F.col(at).bitwiseAND(7).cast("int"))
    return found.select(*map(col, df.columns), F.coalesce(bit == 1, F.lit(False)).alias(name))
