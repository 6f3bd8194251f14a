"""n-grams counted and matched chunk by chunk in Python, for texts of any number.

An n-gram occurs no more often than those within it, so orders are counted one after
the other and only n-grams whose shorter ones are frequent are sent. Which these are
a bitmap tells, of at most 8 MiB; it lets some others pass, which costs shuffle alone,
as all counts are of the strings themselves. Phrases are looked up once for each of
the n-grams that differ in a part of the documents, not at every place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators import signature
from glyphmill.ship import ship
from glyphmill.storage import bound_batches, cut

#: Tokens of a chunk or part, unless one record has more; pairs of a bucket.
TOKENS, PAIRS = 1 << 20, 1 << 21
MOST_BITS = 1 << 26
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _M)


def _hashed(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A polynomial of the bytes of each string, and the power of its length: that of
    strings joined follows from theirs."""
    s = strings.cast(pa.large_binary())
    off = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1]
    size = np.diff(off)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(size.max(initial=0)), _M)))
    h = np.zeros(len(s), np.uint64)
    if some := int(off[-1] - off[0]):
        data = np.frombuffer(s.buffers()[2], np.uint8)[off[0] : off[-1]]
        place = np.repeat(off[1:] - off[0], size) - 1 - np.arange(some)
        h[size > 0] = np.add.reduceat(_BYTE[data] * power[place], (off[:-1] - off[0])[size > 0])
    return h, power[size]


class _Bitmap:
    """Of n-grams (ngram): whether one may be among them."""

    def __init__(self, known: DataFrame):
        spark = known.sparkSession
        ship(spark)
        self.shift = 64 - max(15, min(MOST_BITS.bit_length() - 1, (32 * known.count()).bit_length()))
        shift = np.uint64(self.shift)

        def place(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array((_mix(_hashed(b.column(0))[0]) >> shift).astype(np.int64))], ["p"])

        at = known.select("ngram").mapInArrow(place, "p bigint")
        pages = at.groupBy(F.shiftright("p", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bits"))
        bits = np.zeros(1 << (64 - self.shift - 3), np.uint8)
        for r in pages.toLocalIterator():
            bits[r.page << 12 : (r.page + 1) << 12] = np.frombuffer(r.bits, np.uint8)
        self.bits = spark.sparkContext.broadcast(bits)

    def has(self, h: np.ndarray) -> np.ndarray:
        p = (_mix(h) >> np.uint64(self.shift)).astype(np.int64)
        return (self.bits.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0


class _Chunk:
    """Tokens of some records, as codes of the words that differ."""

    def __init__(self, content: pa.ListArray):
        size = content.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = content.flatten().fill_null("").dictionary_encode()
        self.words, self.c = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.records, self.doc = len(size), np.repeat(np.arange(len(size)), size)
        self.start = np.cumsum(size) - size
        self.end = self.start + size
        self.word_hash, self.power = _hashed(self.words)

    def whole(self, k: int) -> np.ndarray:
        """Where the n-grams of order k start."""
        n = max(0, len(self.c) - k + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])

    def hash(self, k: int) -> np.ndarray:
        h = self.word_hash[self.c]
        for j in range(1, k):
            if len(h) < 2:
                return h[:0]
            last = self.c[j:]
            h = (h[:-1] * _M + _BYTE[32]) * self.power[last] + self.word_hash[last]
        return h

    def distinct(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the n-grams at these places, where each different one is first, and which
        of them each is."""
        code, top = self.c[at], len(self.words)
        for j in range(1, k):
            if top * len(self.words) >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
                top = len(code)
            code, top = code * len(self.words) + self.c[at + j], top * len(self.words)
        _, first, which = np.unique(code, return_index=True, return_inverse=True)
        return at[first], which

    def strings(self, at: np.ndarray, k: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.c[at + j])) for j in range(k)]
        return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")


def _gathered(batches: Iterator[pa.RecordBatch], content: int) -> Iterator[pa.Table]:
    """Batches put together or cut, so that each has about TOKENS tokens."""
    held, n = [], 0
    for b in batches:
        size = pc.fill_null(pc.list_value_length(b.column(content)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < b.num_rows:
            upto = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), TOKENS - n, side="right")))
            held.append(b.slice(at, upto - at))
            n += int(size[at:upto].sum())
            at = upto
            if n >= TOKENS or at < b.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _one(t: pa.Table, i: int) -> pa.Array:
    c = t.column(i).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def _sliced(arrays: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    b = pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names)
    for at in range(0, b.num_rows, 1 << 16):
        yield b.slice(at, 1 << 16)


def _order(docs: DataFrame, k: int, shorter: _Bitmap | None, weighted: bool, distinct: bool) -> DataFrame:
    kind = "double" if weighted else "bigint"

    def count(batches):
        for t in _gathered(batches, 0):
            x = _Chunk(_one(t, 0))
            at = x.whole(k)
            if shorter is not None and len(at):
                ok = shorter.has(x.hash(k - 1))
                at = at[ok[at] & ok[at + 1]]
            if not len(at):
                continue
            first, which = x.distinct(at, k)
            if distinct:
                n = np.bincount(np.unique(which * x.records + x.doc[at]) // x.records)
            elif weighted:
                n = np.bincount(which, _one(t, 1).to_numpy(zero_copy_only=False)[x.doc[at]])
            else:
                n = np.bincount(which)
            yield from _sliced([x.strings(first, k), n], ["ngram", "freq"])

    return docs.mapInArrow(count, f"ngram string, freq {kind}").groupBy("ngram").agg(F.sum("freq").alias("freq"))


def frequent(docs: DataFrame, n: int, least: float, content: str = "content", weight: str | None = None, distinct: bool = False) -> DataFrame:
    """``ngram, freq`` of the n-grams of the orders 1 to n with a frequency of at least
    ``least``, above 0: their number, the sum of the records' weights (0 or more; null
    is 1), or with ``distinct`` the number of records. Tokens hold no blanks."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(content), *([F.coalesce(F.col(weight), F.lit(1.0)).cast("double").alias("w")] if weight else []))
    out, shorter = None, None
    for k in range(1, n + 1):
        level = _order(rows, k, shorter, weight is not None, distinct).where(F.col("freq") >= least)
        if k < n:
            level = cut(level)
            shorter = _Bitmap(level)
        out = level if out is None else out.union(level)
    return out


def last_class(docs: DataFrame, known: DataFrame, longest: int, by: str, name: str, content: str = "content") -> DataFrame:
    """``phrase, class`` of n-grams (ngram): ``name`` of the record with the greatest
    ``by``, a bigint, that has the phrase."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    known = cut(known.select("ngram"))
    bitmap = _Bitmap(known)

    def last(batches):
        for t in _gathered(batches, 0):
            x = _Chunk(_one(t, 0))
            ids = _one(t, 1).fill_null(int(np.iinfo(np.int64).min)).to_numpy(zero_copy_only=False)
            for k in range(1, longest + 1):
                at, first, which = _passing(x, k, bitmap)
                if not len(at):
                    continue
                order = np.lexsort((ids[x.doc[at]], which))
                of = pa.array(x.doc[at][order[np.append(np.flatnonzero(np.diff(which[order])), len(order) - 1)]])
                yield from _sliced([x.strings(first, k), _one(t, 1).take(of), _one(t, 2).take(of)], ["ngram", "by", "class"])

    kind = dict(docs.dtypes)[name]
    rows = docs.select(content, F.col(by).cast("bigint"), name).mapInArrow(last, f"ngram string, by bigint, class {kind}")
    return known.join(rows, "ngram").groupBy(F.col("ngram").alias("phrase")).agg(F.max_by("class", "by").alias("class"))


class Matches:
    """Every phrase of a table (phrase, ...) at every place of documents (key, content),
    overlapping and nested ones too; ``carry`` names a column of the phrases to keep."""

    def __init__(self, docs: DataFrame, phrases: DataFrame, longest: int, key: str = "key", content: str = "content", carry: str | None = None):
        spark = docs.sparkSession
        ship(spark)
        bound_batches(spark)
        self.longest, self.key_type = longest, dict(docs.dtypes)[key]
        self.carry_type = dict(phrases.dtypes)[carry] if carry else None

        def pack(batches):
            place, i = TaskContext.get().partitionId() << 32, 0
            for t in _gathered(batches, 1):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t.combine_chunks())
                n = int(pc.sum(pc.list_value_length(t.column(1))).as_py() or 0)
                yield pa.RecordBatch.from_arrays([pa.array([place + i], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "n", "docs"])
                i += 1

        self.parts = cut(docs.select(F.col(key).alias("key"), F.col(content).alias("content")).mapInArrow(pack, "part bigint, n bigint, docs binary"))
        known = cut(phrases.select(F.col("phrase").alias("ngram"), *([F.col(carry).alias("carry")] if carry else [])).where("ngram is not null").dropDuplicates(["ngram"]))
        self.bitmap = bitmap = _Bitmap(known)

        def candidates(batches):
            for b in batches:
                for part, packed in zip(b.column(0), b.column(1), strict=True):
                    x = _Chunk(_unpacked(packed)[1])
                    for k in range(1, longest + 1):
                        _, first, _ = _passing(x, k, bitmap)
                        if len(first):
                            yield from _sliced([np.full(len(first), part.as_py()), (k << 32) + np.arange(len(first)), x.strings(first, k)], ["part", "code", "ngram"])

        own = self.parts.select("part", "docs").mapInArrow(candidates, "part bigint, code bigint, ngram string")
        self.found = own.join(known, "ngram").select("part", "code", *(["carry"] if carry else []))

    def each(self, f: Callable, schema: str) -> DataFrame:
        """What ``f(keys, chunk, doc, start, end, which, phrases, carried)`` gives of each part."""
        bitmap, longest, carried = self.bitmap, self.longest, self.carry_type is not None

        def both(docs: pa.Table, codes: pa.Table) -> pa.Table:
            keys, content = _unpacked(docs.column("docs")[0])
            x = _Chunk(content)
            code = codes.column("code").to_numpy()
            by = np.argsort(code)
            code = code[by]
            doc, start, end, which, names, n = [], [], [], [], [], 0
            for k in range(1, longest + 1):
                at, first, of = _passing(x, k, bitmap)
                own = code[code >> 32 == k] & 0xFFFFFFFF
                number = np.full(len(first), -1, np.int64)
                number[own] = np.arange(n, n + len(own))
                hit = number[of] >= 0 if len(at) else np.zeros(0, bool)
                start.append(at[hit])
                end.append(at[hit] + k)
                which.append(number[of][hit] if len(at) else np.zeros(0, np.int64))
                names.append(x.strings(first[own], k))
                n += len(own)
            start, end, which = (np.concatenate(v) for v in (start, end, which))
            kept = codes.column("carry").combine_chunks().take(pa.array(by)) if carried else None
            return f(keys, x, x.doc[start], start, end, which, pa.concat_arrays([c.cast(pa.string()) for c in names]), kept)

        return self.parts.select("part", "docs").groupBy("part").cogroup(self.found.groupBy("part")).applyInArrow(both, schema)

    def places(self) -> DataFrame:
        """``key, phrase, start, end`` of all matches, end exclusive."""

        def rows(keys, x, doc, start, end, which, phrases, kept):
            base = x.start[doc]
            return pa.table({"key": keys.take(pa.array(doc)), "phrase": phrases.take(pa.array(which)), "start": pa.array((start - base).astype(np.int32)), "end": pa.array((end - base).astype(np.int32))})

        return self.each(rows, f"key {self.key_type}, phrase string, start int, end int")

    def sums(self, by_length: bool = False) -> DataFrame:
        """``key, phrase, value, norm`` of each record by itself: how often it has the
        phrase, or with ``by_length`` that times the phrase's characters, and the
        record's total."""

        def rows(keys, x, doc, start, end, which, phrases, kept):
            pair, n = np.unique(doc * (len(phrases) + 1) + which, return_counts=True)
            doc, which = pair // (len(phrases) + 1), pair % (len(phrases) + 1)
            if by_length:
                n = n * pc.utf8_length(phrases).to_numpy(zero_copy_only=False).astype(np.int64)[which]
            norm = np.zeros(x.records, np.int64)
            np.add.at(norm, doc, n)
            return pa.table({"key": keys.take(pa.array(doc)), "phrase": phrases.take(pa.array(which)), "value": pa.array(n.astype(np.int64)), "norm": pa.array(norm[doc])})

        return self.each(rows, f"key {self.key_type}, phrase string, value bigint, norm bigint")

    def by_class(self) -> DataFrame:
        """``key, class, value, share`` of each record by itself: matches of the phrases
        of each class, the column carried, and their share of all."""

        def rows(keys, x, doc, start, end, which, phrases, kept):
            coded = kept.dictionary_encode(null_encoding="encode")
            own, classes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary) + 1
            pair, n = np.unique(doc * classes + own[which], return_counts=True)
            doc, own = pair // classes, pair % classes
            total = np.zeros(x.records, np.int64)
            np.add.at(total, doc, n)
            return pa.table({"key": keys.take(pa.array(doc)), "class": coded.dictionary.take(pa.array(own)), "value": pa.array(n.astype(np.int64)), "share": pa.array(n / total[doc])})

        return self.each(rows, f"key {self.key_type}, class {self.carry_type}, value bigint, share double")

    def scores(self, width: int = 1) -> DataFrame:
        """``key, scores`` of each record with any tokens by itself: the sums of its
        matches' weights, the column carried, array<double> of so many."""

        def rows(keys, x, doc, start, end, which, phrases, kept):
            some = np.flatnonzero(x.end > x.start)
            weights = kept.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            pair, n = np.unique(doc * (len(phrases) + 1) + which, return_counts=True)
            doc, which = pair // (len(phrases) + 1), pair % (len(phrases) + 1)
            total = np.stack([np.bincount(doc, n * weights[which, i], x.records).astype(np.float64) for i in range(width)], axis=1)
            return pa.table({"key": keys.take(pa.array(some)), "scores": signature.listed(total[some])})

        return self.each(rows, f"key {self.key_type}, scores array<double>")

    def bags(self) -> DataFrame:
        """``key, ids, values`` of each record with any tokens by itself: the numbers of
        its matches, the column carried, and how often they are."""

        def rows(keys, x, doc, start, end, which, phrases, kept):
            some = np.flatnonzero(x.end > x.start)
            pair, n = np.unique(doc * (len(phrases) + 1) + which, return_counts=True)
            doc, which = pair // (len(phrases) + 1), pair % (len(phrases) + 1)
            ends = pa.array(np.searchsorted(doc, np.append(some, x.records)).astype(np.int32))
            ids = kept.take(pa.array(which))
            return pa.table({"key": keys.take(pa.array(some)), "ids": pa.ListArray.from_arrays(ends, ids), "values": pa.ListArray.from_arrays(ends, pa.array(n.astype(np.float64)))})

        return self.each(rows, f"key {self.key_type}, ids array<{self.carry_type}>, values array<double>")

    def best(self, k: int) -> DataFrame:
        """``key, top`` of each record with any tokens by itself: the at most k phrases
        that weigh most, number times the weight carried, then by phrase."""

        def rows(keys, x, doc, start, end, which, phrases, kept):
            some = np.flatnonzero(x.end > x.start)
            weights = kept.to_numpy(zero_copy_only=False)
            rank = np.empty(len(phrases), np.int64)
            rank[pc.array_sort_indices(phrases.cast(pa.binary())).to_numpy()] = np.arange(len(phrases))
            pair, n = np.unique(doc * (len(phrases) + 1) + which, return_counts=True)
            doc, which = pair // (len(phrases) + 1), pair % (len(phrases) + 1)
            order = np.lexsort((rank[which], -(n * weights[which]), doc))
            doc, which = doc[order], which[order]
            first = np.arange(len(doc)) - np.searchsorted(doc, doc) < k
            doc, which = doc[first], which[first]
            ends = pa.array(np.searchsorted(doc, np.append(some, x.records)).astype(np.int32))
            return pa.table({"key": keys.take(pa.array(some)), "top": pa.ListArray.from_arrays(ends, phrases.take(pa.array(which)))})

        return self.each(rows, f"key {self.key_type}, top array<string>")

    def _pairs(self, half: int) -> DataFrame:
        """``bucket, packed``: phrases with the tokens about them and counts, of each part,
        in buckets of whole phrases."""
        tokens = self.parts.agg(F.sum("n")).first()[0] or 0
        buckets = max(1, int(self.parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * half * tokens // PAIRS))

        def rows(keys, x, doc, start, end, which, phrases, kept):
            if not len(which):
                return pa.table({"bucket": pa.array([], pa.int32()), "packed": pa.array([], pa.binary())})
            code = []
            for j in range(1, half + 1):
                for side, at, ok in ((j - 1, start - j, start - j >= x.start[doc]), (half + j - 1, end + j - 1, end + j - 1 < x.end[doc])):
                    code.append((which[ok] * len(x.words) + x.c[at[ok]]) * (2 * half) + side)
            code, n = np.unique(np.concatenate(code), return_counts=True)
            p, t = code // (2 * half * len(x.words)), code % (2 * half * len(x.words))
            bucket = (_mix(_hashed(phrases)[0]) % np.uint64(buckets)).astype(np.int64)[p]
            order = np.argsort(bucket, kind="stable")
            p, t, n, bucket = p[order], t[order], n[order], bucket[order]
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
            out = [_packed_pairs(p[a:b], t[a:b], n[a:b], phrases, x.words, 2 * half) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pa.table({"bucket": pa.array(bucket[edges[:-1]].astype(np.int32)), "packed": pa.array(out, pa.binary())})

        return self.each(rows, "bucket int, packed binary")

    def contexts(self, half: int, least: int = 1) -> DataFrame:
        """``phrase, feature, value``: how often a token is up to ``half`` places left or
        right of a phrase, as side, distance and token, at least ``least`` times."""

        def rows(packed: pa.Table) -> pa.Table:
            phrases, features, p, t, n = _merged_pairs(packed, half)
            ok = n >= least
            return pa.table({"phrase": phrases.take(pa.array(p[ok])), "feature": features(t[ok]), "value": pa.array(n[ok])})

        return self._pairs(half).groupBy("bucket").applyInArrow(rows, "phrase string, feature string, value bigint")

    def signatures(self, half: int) -> DataFrame:
        """``key, strength, bands``: the signatures of the phrases' contexts."""

        def rows(packed: pa.Table) -> pa.Table:
            phrases, features, p, t, n = _merged_pairs(packed, half)
            kind, which = np.unique(t, return_inverse=True)
            words = np.concatenate([signature.words(features(kind[a : a + 50_000]).to_pylist()) for a in range(0, len(kind), 50_000)]) if len(kind) else np.zeros((0, 4), np.uint64)
            total = np.zeros((len(phrases), signature.BITS), np.int64)
            for a in range(0, len(p), 4000):  # few, so that they stay in the cache
                own, begin = np.unique(p[a : a + 4000], return_index=True)
                signs, m = signature.unfolded(words[which[a : a + 4000]]), n[a : a + 4000]
                if m.max() > 1:
                    signs = signs * m.astype(np.int32 if m.max() < 1 << 18 else np.int64)[:, None]
                total[own] += np.add.reduceat(signs, begin, axis=0, dtype=np.int64 if signs.itemsize == 8 else np.int32)
            some = np.unique(p)
            return pa.table({"key": phrases.take(pa.array(some)), "strength": pa.array(np.bincount(p, minlength=len(phrases))[some]), "bands": signature.listed(signature.bands(total[some]))})

        return self._pairs(half).groupBy("bucket").applyInArrow(rows, "key string, strength bigint, bands array<int>")


def _unpacked(packed: pa.Scalar) -> tuple[pa.Array, pa.ListArray]:
    t = pa.ipc.open_stream(packed.as_py()).read_all()
    return _one(t, 0), _one(t, 1)


def _passing(x: _Chunk, k: int, bitmap: _Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where n-grams are that the bitmap lets pass, and the different ones of them."""
    at = x.whole(k)
    if len(at):
        at = at[bitmap.has(x.hash(k)[at])]
    return at, *x.distinct(at, k)


def _packed_pairs(p: np.ndarray, t: np.ndarray, n: np.ndarray, phrases: pa.Array, words: pa.Array, sides: int) -> bytes:
    own, p = np.unique(p, return_inverse=True)
    token, which = np.unique(t // sides, return_inverse=True)
    text = ["\n".join(a.to_pylist()).encode() for a in (phrases.take(pa.array(own)), words.take(pa.array(token)))]
    numbers = np.stack([np.diff(p, prepend=0), which * sides + t % sides, n]).astype("<i8")
    # byte by byte, as most bytes are 0
    raw = np.array([len(text[0]), len(text[1]), numbers.shape[1]], "<i8").tobytes() + b"".join(text) + np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked_pairs(packed: bytes) -> tuple[pa.Array, pa.Array, np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    a, b, n = (int(v) for v in np.frombuffer(raw, "<i8", 3))
    phrases, words = (pa.array(raw[u:v].decode().split("\n"), pa.string()) for u, v in ((24, 24 + a), (24 + a, 24 + a + b)))
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 24 * n, 24 + a + b).reshape(8, -1).T).view("<i8").reshape(3, n)
    return phrases, words, numbers


def _merged_pairs(packed: pa.Table, half: int):
    """Phrases, the features of codes, and pairs with their counts in order of phrases."""
    sides = 2 * half
    phrases, words, ps, ts, ns, base = [], [], [], [], [], [0, 0]
    for blob in packed.column("packed"):
        a, b, c = _unpacked_pairs(blob.as_py())
        phrases.append(a)
        words.append(b)
        ps.append((np.cumsum(c[0]) + base[0]).astype(np.int32))
        ts.append(c[1] + base[1] * sides)
        ns.append(c[2].astype(np.float64))
        base = [base[0] + len(a), base[1] + len(b)]
    phrases, words = (pa.concat_arrays(v).dictionary_encode() for v in (phrases, words))
    p, t = phrases.indices.to_numpy()[np.concatenate(ps)].astype(np.int64), np.concatenate(ts)
    ps = ts = None
    t = words.indices.to_numpy()[t // sides].astype(np.int64) * sides + t % sides
    top = len(words.dictionary) * sides
    code = p * top + t
    p = t = None
    code, which = np.unique(code, return_inverse=True)
    # whole numbers below 2**53, so that sums of doubles are exact
    n = np.bincount(which, np.concatenate(ns)).astype(np.int64)
    side = pa.array([f"{s}{j}" for s in "LR" for j in range(1, half + 1)])

    def features(t: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(side.take(pa.array(t % sides)), words.dictionary.take(pa.array(t // sides)), "")

    return phrases.dictionary, features, code // top, code % top, n
