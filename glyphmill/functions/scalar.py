"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX = 15  # hex digits of an md5 that fit a positive bigint


def hash60(x: Column, digest: int = 0, half: int = 0) -> Column:
    """60 bits of md5 of a string, 0 .. 2**60 - 1; ``digest`` salts, ``half``
    picks the first or second 15 hex digits. Any engine computes the same."""
    salted = x if digest == 0 else F.concat(x, F.lit(f"#{digest}"))
    return F.conv(F.substring(F.md5(salted), 1 + HEX * half, HEX), 16, 10).cast("bigint")


def bucket(x: Column, n: int, salt: int = 0) -> Column:
    """A hash of the string in 0 .. n - 1."""
    return F.pmod(hash60(x, salt), F.lit(n).cast("bigint"))


def sigmoid(x: Column, centred: bool = False) -> Column:
    y = 1 / (1 + F.exp(-x))
    return y - 0.5 if centred else y


def gray(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 1))


def bit_string(x: Column, width: int) -> Column:
    return F.lpad(F.bin(x), width, "0")


def letters(data: Column) -> Column:
    """Bytes as pairs of letters A-Z, base 26, most significant first."""
    h = F.hex(data)
    byte = lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pair = lambda i: F.concat(F.chr(F.floor(byte(i) / 26) + 65), F.chr(byte(i) % 26 + 65))
    return F.when(F.length(h) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(h) / 2 - 1).cast("int")), pair), ""))


def unletters(text: Column) -> Column:
    """The bytes of pairs of letters."""
    at = lambda i: F.ascii(F.substring(text, i, F.lit(1))) - 65
    one = lambda i: F.lpad(F.hex((at(i * 2 + 1) * 26 + at(i * 2 + 2)).cast("bigint")), 2, "0")
    return F.when(F.length(text) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), (F.length(text) / 2 - 1).cast("int")), one), "")))


def bloom_hashes(m: Column, n: Column) -> Column:
    """The best number of hash functions for m bits and n elements."""
    return F.greatest(F.lit(1), F.round(0.7 * m / n)).cast("int")


def bloom_error(m: Column, n: Column) -> Column:
    return F.pow(F.lit(0.6185), m / n)


def bloom_bits(n: Column, error: Column) -> Column:
    """Bits needed for n elements at this rate of false positives."""
    return F.ceil(n * F.log(error) / F.log(F.lit(0.6185)))


def bloom_capacity(m: Column, error: Column) -> Column:
    """Elements that m bits hold at this rate of false positives."""
    return F.floor(m * F.log(F.lit(0.6185)) / F.log(error))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of bands."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda s, x: s + x)


def cosine(differing: Column, bits: int) -> Column:
    """The cosine that so many differing signature bits stand for."""
    return F.cos(differing * F.lit(3.141592653589793) / bits)


def decide_binary(score: Column, threshold: float = 0.0, strict: bool = True) -> Column:
    return F.when(score > threshold if strict else score >= threshold, 1).otherwise(-1)


def decide_bin(score: Column, highest: int) -> Column:
    """Regression bins: the floor, held within 0 .. highest."""
    return F.least(F.greatest(F.floor(score), F.lit(0)), F.lit(highest))


def confidence(scores: Column, weights: list[float], bias: float = 0.0) -> Column:
    """Logistic confidence from an array of scores; null if a score is missing."""
    terms = [F.element_at(scores, i + 1) * w for i, w in enumerate(weights)]
    total = F.lit(bias)
    for t in terms:
        total = total + t
    return sigmoid(total)
