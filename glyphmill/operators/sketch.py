"""Sketches. Coins are hashes of key and position, so results can be repeated.

Order-dependent sketches fold over a key's values in order, in one task a key;
the folds keep a few numbers of state. Counts that needn't be folded are better
summed (``groupBy``), which combines before the shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.scalar import bucket, hash60
from glyphmill.ship import ship


def bloom_positions(key: Column, bits: int, hashes: Column | int) -> Column:
    """The bit positions of a key, one for each of its hashes (at most 32)."""
    n = F.lit(hashes) if isinstance(hashes, int) else hashes
    return F.slice(F.array(*[bucket(key, bits, i) for i in range(1, 33)]), F.lit(1), n) if not isinstance(hashes, int) else F.array(*[bucket(key, bits, i) for i in range(1, hashes + 1)])


def bloom_build(keys: DataFrame, key: str, bits: int, hashes: Column | int) -> DataFrame:
    """``position``: the bits that are set."""
    return keys.select(F.explode(bloom_positions(F.col(key), bits, hashes)).alias("position")).distinct()


def bloom_probe(keys: DataFrame, key: str, bloom: DataFrame, bits: int, hashes: Column | int) -> DataFrame:
    """The keys (distinct) with ``member``: whether all their bits are set."""
    asked = keys.select(key, F.explode(bloom_positions(F.col(key), bits, hashes)).alias("position")).distinct()
    hit = asked.join(bloom.withColumn("hit", F.lit(1)), "position", "left")
    return hit.groupBy(key).agg((F.count("*") == F.sum(F.coalesce("hit", F.lit(0)))).alias("member"))


def allocate(gains: DataFrame) -> DataFrame:
    """The number of hashes for each feature, of rows (feature, k, gain): at most
    one k a feature is chosen, so the best sum is each feature's greatest
    positive gain; the least k in ties."""
    best = gains.where("gain > 0").groupBy("feature").agg(F.max_by(F.struct("k", "gain"), F.struct("gain", -F.col("k"))).alias("b"))
    return best.select("feature", F.col("b.k").alias("k"), F.col("b.gain").alias("gain"))


def morris(rows: DataFrame, key: str, order: str, base: float = 2.0) -> DataFrame:
    """``key, state, estimate``: Morris counters of each key's rows in order. State
    c steps with probability base**-c and stands for (base**c - 1) / (base - 1); a
    base nearer to 1 counts more finely."""
    coin = hash60(F.concat_ws("/", F.col(key).cast("string"), F.col(order).cast("string")), 7)
    coins = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), coin.alias("c"))))
    state = F.aggregate(coins, F.lit(0), lambda s, x: s + F.when(x["c"] < F.lit(2.0**60) * F.pow(F.lit(float(base)), -s), 1).otherwise(0))
    return rows.groupBy(key).agg(state.alias("state")).withColumn("estimate", ((F.pow(F.lit(float(base)), F.col("state")) - 1) / (base - 1)).cast("bigint" if base == 2 else "double"))


def coin(*parts) -> float:
    """A hash in [0, 1)."""
    return int.from_bytes(hashlib.md5("/".join(map(str, parts)).encode()).digest()[:7], "big") / 2**56


class Reservoir:
    """The sum of a stream of +1 and -1 votes from a sample of k of them, of which
    only the number of positive ones is kept. ``base``: the count of votes is a
    Morris counter of this base instead of exact."""

    def __init__(self, k: int, seed, base: float = 0.0):
        self.k, self.seed, self.base = k, seed, base
        self.n = self.positive = self.step = self.state = 0

    def count(self) -> float:
        if not self.base or self.n <= self.k:
            return self.n
        return self.k + (self.base**self.state - 1) / (self.base - 1)

    def vote(self, up: bool) -> None:
        self.n += 1
        if self.n <= self.k:
            self.positive += up
            return
        if self.base and coin(self.seed, "m", self.n) < self.base**-self.state:
            self.state += 1
        if coin(self.seed, "r", self.n) < self.k / max(self.count(), self.k):
            self.positive += up - (coin(self.seed, "p", self.n) < self.positive / self.k)

    def update(self, value: float) -> None:
        """So many votes of the value's sign; a fraction by a coin, by magnitude."""
        self.step += 1
        size = abs(value)
        whole = math.floor(size)
        whole += coin(self.seed, "f", self.step) < size - whole
        for _ in range(whole):
            self.vote(value > 0)

    def total(self) -> float:
        held = min(self.n, self.k)
        return self.count() * (2 * self.positive / held - 1) if held else 0.0


class ReservoirAverage:
    """The mean of reals within [-bound, bound], each split into ``grain`` votes."""

    def __init__(self, k: int, seed, bound: float = 1.0, grain: int = 16, base: float = 0.0):
        self.votes, self.bound, self.grain = Reservoir(k, seed, base), bound, grain

    def update(self, value: float) -> None:
        x = max(-1.0, min(1.0, value / self.bound))
        v = self.votes
        v.step += 1
        share = (x + 1) / 2 * self.grain
        up = math.floor(share)
        up += coin(v.seed, "a", v.step) < share - up
        for i in range(self.grain):
            v.vote((i * up) // self.grain != ((i + 1) * up) // self.grain)

    def mean(self) -> float:
        held = min(self.votes.n, self.votes.k)
        return self.bound * (2 * self.votes.positive / held - 1) if held else 0.0


class Tomb:
    """Talbot's layered counters: a key's count is the number of consecutive
    layers in which its bit is set, on a logarithmic codebook; each layer is a
    Bloom filter with one hash."""

    def __init__(self, bits: int, layers: int, base: float = 2.0, seed: str = ""):
        self.layers = [bytearray(bits) for _ in range(layers)]
        self.codebook = [0.0]
        for c in range(layers):
            self.codebook.append(self.codebook[-1] + base**c)
        self.seed, self.draws = seed, 0

    def _cell(self, key, layer: int) -> int:
        h = hashlib.md5(f"{self.seed}/{layer}/{key}".encode()).digest()
        return int.from_bytes(h[:7], "big") % len(self.layers[layer])

    def level(self, key) -> int:
        for i, layer in enumerate(self.layers):
            if not layer[self._cell(key, i)]:
                return i
        return len(self.layers)

    def get(self, key) -> float:
        return self.codebook[self.level(key)]

    def increment(self, key, n: int = 1) -> None:
        for _ in range(n):
            c = self.level(key)
            if c == len(self.layers):
                return
            self.draws += 1
            if coin(self.seed, key, self.draws) < 1 / (self.codebook[c + 1] - self.codebook[c]):
                self.layers[c][self._cell(key, c)] = 1

    def set(self, key, value: float) -> None:
        c = max(i for i, v in enumerate(self.codebook) if v <= value)
        for i in range(c):
            self.layers[i][self._cell(key, i)] = 1

    def bits_required(self) -> int:
        return sum(map(len, self.layers))


def _fold(rows: DataFrame, key: str, order: str, value: str, make, result) -> DataFrame:
    """``key, n, estimate`` of a state folded over each key's values in order."""
    ship(rows.sparkSession)

    def fold(k: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values = pd.concat(batches).sort_values([order])[value]
        state = make(k[0])
        for v in values:
            state.update(float(v))
        yield pd.DataFrame({key: [k[0]], "n": [len(values)], "estimate": [result(state)]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, order, value).groupBy(key).applyInPandas(fold, f"{key} {kind}, n bigint, estimate double")


def reservoir_sum(rows: DataFrame, key: str, order: str, value: str, k: int = 256, base: float = 0.0) -> DataFrame:
    return _fold(rows, key, order, value, lambda seed: Reservoir(k, seed, base), Reservoir.total)


def reservoir_mean(rows: DataFrame, key: str, order: str, value: str, k: int = 256, bound: float = 1.0, grain: int = 16, base: float = 0.0) -> DataFrame:
    return _fold(rows, key, order, value, lambda seed: ReservoirAverage(k, seed, bound, grain, base), ReservoirAverage.mean)


def tomb_counts(counts: DataFrame, key: str, n: str, tables: int = 8, bits: int = 4096, layers: int = 16) -> DataFrame:
    """``key, n, estimate`` of layered counters: keys go by hash to ``tables``
    tables of so many bits a layer, each filled and read in its own task."""
    ship(counts.sparkSession)

    def fill(k: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values("key")
        tomb = Tomb(bits, layers, seed=str(k[0]))
        for key_, n_ in zip(rows["key"], rows["n"], strict=True):
            tomb.increment(key_, int(n_))
        yield pd.DataFrame({"key": rows["key"], "n": rows["n"], "estimate": [tomb.get(x) for x in rows["key"]]})

    rows = counts.select(F.col(key).cast("string").alias("key"), F.col(n).cast("bigint").alias("n"))
    return rows.groupBy(bucket(F.col("key"), tables, 5).alias("table")).applyInPandas(fill, "key string, n bigint, estimate double")
