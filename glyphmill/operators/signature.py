"""Bit signatures by random signs.

A feature's signs are the bits of its md5, 60 of each half of each digest, so no
table of random numbers is kept. A signature bit is set if the sum of the signs,
weighted by the features' values, is above 0. Bits come as bands of 15.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import scalar
from glyphmill.ship import ship

BAND = 15
DIGESTS = 2
BITS = DIGESTS * 120
_MASK = (1 << 60) - 1


def signs(features: list[str], digests: int = DIGESTS, seed: str = "") -> np.ndarray:
    """A row of +1 and -1 for each feature, 120 of each digest; another ``seed``
    gives other signs."""
    return unfolded(words(features, digests, seed))


def words(features: list[str], digests: int = DIGESTS, seed: str = "") -> np.ndarray:
    """The signs of each feature as bits, 60 of a word."""
    out = np.empty((len(features), digests * 2), np.uint64)
    for a in range(0, len(features), 1 << 14):
        each = []
        for f in features[a : a + (1 << 14)]:
            h = hashlib.md5((seed + f).encode("utf-8", "surrogatepass"))
            each.append(h.digest())
            for j in range(1, digests):
                salted = h.copy()
                salted.update(b"#%d" % j)
                each.append(salted.digest())
        d = np.frombuffer(b"".join(each), np.uint8).reshape(-1, digests, 16)
        first, second = (np.ascontiguousarray(d[:, :, k : k + 8]).view(">u8")[:, :, 0].astype(np.uint64) for k in (0, 7))
        out[a : a + len(d), 0::2] = first >> np.uint64(4)
        out[a : a + len(d), 1::2] = second & np.uint64(_MASK)
    return out


def unfolded(words: np.ndarray) -> np.ndarray:
    """The signs of words, made byte by byte, as eight bytes a bit would take much memory."""
    bits = np.unpackbits(words.astype("<u8", copy=False).view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")[:, :, :60]
    return bits.reshape(len(words), words.shape[1] * 60).view(np.int8) * np.int8(2) - np.int8(1)


def bands(sums: np.ndarray) -> np.ndarray:
    """Bands of the rows' signature bits."""
    on = (sums > 0).reshape(len(sums), sums.shape[1] // BAND, BAND)
    return (on * (1 << np.arange(BAND))).sum(axis=2).astype(np.int32)


def listed(x: np.ndarray, valid: np.ndarray | None = None) -> pa.ListArray:
    ends = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
    mask = None if valid is None or valid.all() else pa.array(np.append(~valid, False))
    return pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~valid, False)) if mask is not None else pa.array(ends), pa.array(x.ravel()))


def _of_bags(bags: pa.ListArray, digests: int, seed: str, step: int = 5_000) -> pa.ListArray:
    """Each distinct token of a batch is hashed once; its signs are held as bits."""
    length = bags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = bags.flatten().fill_null("None").dictionary_encode()
    rows = words(coded.dictionary.to_pylist(), digests, seed)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    end = np.cumsum(length)
    sums = np.zeros((len(bags), digests * 120), np.int64)
    at = 0
    while at < len(bags):
        upto = max(at + 1, int(np.searchsorted(end, end[at] - length[at] + step, side="right")))
        some = at + np.flatnonzero(length[at:upto])
        if len(some):
            begin = end[some[0]] - length[some[0]]
            for part in range(int(begin), int(end[some[-1]]), 4 * step):  # one very long bag in pieces
                stop = min(part + 4 * step, int(end[some[-1]]))
                here = some[(end[some] > part) & (end[some] - length[some] < stop)]
                starts = np.maximum(end[here] - length[here], part) - part
                sums[here] += np.add.reduceat(unfolded(rows[codes[part:stop]]), starts, axis=0, dtype=np.int64)
        at = upto
    return listed(bands(sums), bags.is_valid().to_numpy(zero_copy_only=False))


def of_tokens(content: Column, digests: int = DIGESTS, seed: str = "") -> Column:
    """The bands of a bag of tokens, 8 a digest; nothing is shuffled. Null tokens
    give null."""

    @F.arrow_udf("array<int>")
    def sign(bags: pa.Array) -> pa.Array:
        return _of_bags(bags, digests, seed)

    return sign(content)


def of_triples(triples: DataFrame, sums: bool = False, digests: int = DIGESTS, seed: str = "") -> DataFrame:
    """``key, strength, bands`` of triples (key, feature, value bigint); strength
    is the number of triples. With ``sums`` also the sums, by which signatures of
    parts of the data add up."""
    ship(triples.sparkSession)
    schema = "key string, strength bigint, bands array<int>" + (", sums array<bigint>" if sums else "")
    total_bits = digests * 120
    width = total_bits // BAND

    def add(batches):
        held: tuple | None = None

        def batch(keys, n, total):
            cols = [pa.array(keys, pa.string()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(keys) + 1, width), pa.int32()), pa.array(bands(total).ravel()))]
            if sums:
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(0, total_bits * len(keys) + 1, total_bits), pa.int32()), pa.array(total.ravel())))
            return pa.RecordBatch.from_arrays(cols, ["key", "strength", "bands", "sums"][: len(cols)])

        for b in batches:
            for at in range(0, b.num_rows, 5000):
                part = b.slice(at, 5000)
                keys = part.column(0).to_pylist()
                coded = part.column(1).dictionary_encode()
                weighted = signs(coded.dictionary.to_pylist(), digests, seed)[coded.indices.to_numpy()] * part.column(2).to_numpy()[:, None]
                head = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
                total = np.add.reduceat(weighted, head, axis=0)
                n = np.diff([*head, len(keys)])
                names = [keys[i] for i in head]
                if held and held[0] == names[0]:
                    total[0] += held[2]
                    n[0] += held[1]
                elif held:
                    yield batch([held[0]], [held[1]], held[2][None, :])
                if len(names) > 1:
                    yield batch(names[:-1], n[:-1], total[:-1])
                held = names[-1], int(n[-1]), total[-1]
        if held:
            yield batch([held[0]], [held[1]], held[2][None, :])

    rows = triples.select(F.col("key").cast("string").alias("key"), F.col("feature").cast("string").alias("feature"), F.col("value").cast("bigint").alias("value")).where("key is not null and feature is not null and value is not null")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(add, schema)


def merge(parts: DataFrame) -> DataFrame:
    """Signatures (key, strength, sums) of parts of the data, added up."""
    flat = parts.select("key", "strength", F.posexplode("sums").alias("bit", "s"))
    total = flat.groupBy("key", "bit").agg(F.sum("s").alias("s"), F.sum(F.when(F.col("bit") == 0, F.col("strength"))).alias("n"))
    band = total.groupBy("key", F.floor(F.col("bit") / BAND).alias("band")).agg(F.sum(F.when(F.col("s") > 0, F.expr(f"shiftleft(1, cast(bit % {BAND} as int))")).otherwise(0)).cast("int").alias("v"), F.sum("n").alias("n"))
    return band.groupBy("key").agg(F.sum("n").alias("strength"), F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda x: x["v"]).alias("bands"))


def score(a: Column, b: Column) -> Column:
    """The cosine that two signatures' bands estimate."""
    return scalar.cosine(scalar.hamming(a, b), BITS)


def pair_scores(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """``a, b, score`` of pairs (a, b); -1 if either has no signature."""
    s = signatures.select("key", "bands")
    x = pairs.join(s.select(F.col("key").alias("a"), F.col("bands").alias("x")), "a", "left").join(s.select(F.col("key").alias("b"), F.col("bands").alias("y")), "b", "left")
    return x.select("a", "b", F.coalesce(score(F.col("x"), F.col("y")), F.lit(-1.0)).alias("score"))


def dump(signature: Column) -> Column:
    """Bands as a string of 0 and 1."""
    return F.array_join(F.transform(signature, lambda x: scalar.bit_string(x.cast("bigint"), BAND)), "")
