"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations make the whole signature. The first scatters a shingle's place
in a universe of D places; coordinate j is the least value, over the document's
places x, of the second permutation shifted round by j, pi[(x + j) mod D]. One
shingle's values for all coordinates are thus one contiguous slice of pi, and a
signature is the elementwise least of such slices.

Equal shingle sets are one node from the start, so copies cost nothing further.
Nodes that share a band are candidates. Stars about the least node of each band
join candidates to neighbourhoods; a neighbourhood of bounded size is verified in
one task, to which each of its texts goes once. Of larger ones each band is taken
by itself, in blocks where it is still too large; a pair then counts in the first
band that it shares. So every candidate pair is verified, no list of pairs is
made, and only counts and a spanning forest leave the tasks. A bitmap of the texts
that are wanted keeps the others from being sent at all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import _text
from glyphmill.llm._shared import bound_batches, col, cut, digest, free_names, marked, quoted
from glyphmill.llm.components import components
from glyphmill.ship import ship

UNIVERSE = 1 << 20
_TABLES: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _permutations(coords: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and a view of the second whose row x has the values
    of all coordinates for a shingle at place x."""
    if (coords, seed) not in _TABLES:
        rng = np.random.default_rng(seed)
        sigma = rng.permutation(UNIVERSE).astype(np.int32)
        pi = rng.permutation(UNIVERSE).astype(np.int32)
        _TABLES[coords, seed] = sigma, np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: coords - 1])), coords)
    return _TABLES[coords, seed]


def signature(shingles: np.ndarray, coords: int, seed: int = 1) -> np.ndarray:
    """Circulant MinHash signature of a non-empty set of 64-bit shingles."""
    sigma, rows = _permutations(coords, seed)
    places = sigma[(shingles & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = np.full(coords, UNIVERSE, np.int32)
    for at in range(0, len(places), 512):
        np.minimum(out, rows[places[at : at + 512]].min(axis=0), out=out)
    return out


def shingle_sets(texts: pa.Array | list, k: int):
    """The sorted distinct k-word shingles of each text in turn; of a text of
    fewer words the one shingle of all its words, of one without words none."""
    for _, group in _text.pieces(texts):
        h, _, _, of = _text.words(group)
        all_shingles = _text.shingles(h, k)
        for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(all_shingles[a : b - k + 1])
            elif b > a:
                yield _text.shingles(h[a:b], b - a)
            else:
                yield np.empty(0, np.uint64)


def _sketches(rows: DataFrame, k: int, bands: int, per_band: int) -> DataFrame:
    """``id, dg, n, s1, s2, bands`` of rows (id, dg, t): the set's size, two hashes
    of the whole set and a hash of each band; size 0 and no bands without words."""

    def sketch(batches):
        salt = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            size, total, mixed, sigs = [], [], [], []
            for s in shingle_sets(batch.column(2), k):
                size.append(len(s))
                total.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                mixed.append(int(np.bitwise_xor.reduce(_text.mix(s ^ np.uint64(0x9E3779B97F4A7C15))).view(np.int64)) if len(s) else 0)
                if len(s):
                    sigs.append(signature(s, bands * per_band))
            h = np.zeros((len(sigs), bands), np.uint64) + _text.mix(salt + np.uint64(7))
            if sigs:
                sig = np.stack(sigs).reshape(-1, bands, per_band).astype(np.uint64)
                for j in range(per_band):
                    h = _text.mix(h ^ sig[:, :, j]) + salt
            ends = np.concatenate(([0], np.cumsum(np.where(np.array(size, np.int64) > 0, bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int32()), pa.array(total, pa.int64()), pa.array(mixed, pa.int64()), lists], ["id", "dg", "n", "s1", "s2", "bands"])

    added = [T.StructField(c, t) for c, t in (("n", T.IntegerType()), ("s1", T.LongType()), ("s2", T.LongType()), ("bands", T.ArrayType(T.LongType())))]
    return rows.mapInArrow(sketch, T.StructType([*rows.schema.fields[:2], *added]))


def _shared_band(x: np.ndarray, y: np.ndarray, only: int | None) -> np.ndarray:
    """Which rows of x share a band with which of y; with ``only`` which have that
    one as the first that they share."""
    met = np.zeros((len(x), len(y)), bool)
    open_ = np.ones_like(met)
    for j in range(x.shape[1]):
        same = x[:, j, None] == y[:, j]
        if only is None:
            met |= same
            continue
        here = same & open_
        open_ &= ~same
        met[x[:, j] == only] |= here[x[:, j] == only]
    return met


def _similar(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Whether the Jaccard similarity of a[i] and b[j], place by place, is so high."""
    sizes = [np.array([len(s) for s in x], np.int64) for x in (a, b)]
    every, inverse, count = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1  # a shingle of one text alone is in no intersection
    width = -(-int(common[-1] + 1) // 64) if len(every) else 0
    both = np.zeros(len(i), np.int64)
    if width * (len(a) + len(b)) <= 1 << 23:
        bits = np.zeros((len(a) + len(b), width), np.uint64)
        row = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))
        kept = count[inverse] > 1
        place = common[inverse[kept]]
        np.bitwise_or.at(bits, (row[kept], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        step = max(1, (1 << 21) // max(width, 1))
        for at in range(0, len(i), step):
            both[at : at + step] = np.bitwise_count(bits[i[at : at + step]] & bits[len(a) + j[at : at + step]]).sum(axis=1, dtype=np.int64)
    else:
        for n, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            both[n] = len(np.intersect1d(a[p], b[q], assume_unique=True))
    return (both > 0) & (both >= least * (sizes[0][i] + sizes[1][j] - both) - 1e-12)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place of each place's component in the graph of edges i, j."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _verify(k: int, least: float):
    """Of rows (g, only, i, j, side, u, copies, bands, t) sorted by g, i, j: ``u, v,
    links`` of each node with a verified pair in the group: a node of its component
    there, and how many documents its partners stand for."""

    def judge(key, us, sides, copies, bands, sets):
        order = np.unique(us * 2 + sides, return_index=True)[1]  # a row may have come twice
        us, sides, copies, bands, sets = us[order], sides[order], copies[order], bands[order], [sets[o] for o in order]
        x = np.flatnonzero(sides == 0)
        y = x if key[2] == key[3] else np.flatnonzero(sides == 1)
        met = _shared_band(bands[x], bands[y], key[1])
        if key[2] == key[3]:
            met = np.triu(met, 1)
        i, j = np.nonzero(met)
        if not len(i):
            return None
        yes = _similar([sets[n] for n in x], [sets[n] for n in y], i, j, least)
        i, j = x[i[yes]], y[j[yes]]
        links = np.bincount(i, copies[j], len(us)) + np.bincount(j, copies[i], len(us))
        label = _forest(len(us), i, j)
        some = links > 0
        return us[some], us[label[some]], links[some].astype(np.int64)

    def run(batches):
        key, held = None, []
        for batch in batches:
            g, only, i, j, sides, us, copies = (c.to_pylist() for c in batch.columns[:7])
            flat = batch.column(7)
            matrix = flat.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(us), -1)
            out = []
            for row, s in enumerate(shingle_sets(batch.column(8), k)):
                now = (g[row], None if only[row] is None else np.uint64(only[row] & (1 << 64) - 1), i[row], j[row])
                if now != key:
                    if len(held) > 1:
                        out.append(judge(key, *_columns(held)))
                    key, held = now, []
                held.append((us[row], sides[row], copies[row], matrix[row], s))
            yield _triples(out)
        if len(held) > 1:
            yield _triples([judge(key, *_columns(held))])

    return run


def _columns(held: list[tuple]):
    us, sides, copies, bands, sets = zip(*held, strict=True)
    return np.array(us, np.int64), np.array(sides, np.int64), np.array(copies, np.float64), np.stack(bands), list(sets)


def _triples(found: list) -> pa.RecordBatch:
    parts = [f for f in found if f is not None]
    cols = [np.concatenate([p[n] for p in parts]) if parts else np.empty(0, np.int64) for n in range(3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["u", "v", "links"])


def _blocks(members: DataFrame, nodes: int, shingles: int) -> DataFrame:
    """Rows (g, only, u, n) with the pairs of blocks that each goes to; a group of
    at most so many nodes and shingles is one block."""
    total = members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / nodes), F.ceil(F.sum("n") / shingles)).cast("int").alias("nb"))
    own = F.pmod(F.xxhash64("u"), F.col("nb")).cast("int")
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    left = F.transform(F.sequence(F.col("b"), F.col("nb") - 1), lambda o: pair(F.col("b"), o, 0))
    right = F.transform(F.filter(F.sequence(F.lit(0), F.col("b")), lambda o: o < F.col("b")), lambda o: pair(o, F.col("b"), 1))
    placed = members.join(total, "g").withColumn("b", own)
    return placed.select("g", "only", "u", F.explode(F.concat(left, right)).alias("p")).select("g", "only", "u", "p.i", "p.j", "p.side")


def _judged(docs, k, min_jaccard, bands, per_band, id_col, text_col, nodes, shingles):
    """``id, dg, rid, group_id, n_links, keep`` of every row of docs."""
    rows = docs.select(col(id_col).alias("id"), digest(col(text_col)).alias("dg"), col(text_col).alias("t"))
    sketches = cut(_sketches(rows, k, bands, per_band).withColumn("rid", F.monotonically_increasing_id()))
    least = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "dg", "rid")).alias("least")
    same = cut(
        sketches.where("n > 0").groupBy("n", "s1", "s2").agg(F.count("*").alias("copies"), least, F.first("bands").alias("bands"))
        .withColumn("u", F.monotonically_increasing_id())
    )
    placed = same.select("u", F.explode("bands").alias("band"))
    meets = placed.groupBy("band").agg(F.min("u").alias("v"), F.max("u").alias("most")).where("v <> most").select("band", "v")
    met = cut(placed.join(meets, "band"))
    near = cut(components(met.select("u", "v")))
    around = near.union(near.select(F.col("root").alias("u"), "root").distinct()).join(same.select("u", "n", F.col("least.id").alias("x"), F.col("least.dg").alias("y")), "u")
    size = around.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    around = cut(around.join(size, "root"))
    fits = (F.col("m") <= nodes) & (F.col("s") <= shingles)
    whole = around.where(fits).select(F.col("root").alias("g"), F.lit(None).cast("long").alias("only"), "u", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    large = around.where(~fits).select("u", "n")
    by_band = _blocks(met.select("u", F.col("band").alias("g"), F.col("band").alias("only")).join(large, "u").select("g", "only", "u", "n"), nodes, shingles)
    wanted = whole.union(by_band).join(same.select("u", "copies", "bands", F.col("least.id").alias("x"), F.col("least.dg").alias("y")), "u")
    asked = marked(rows, "asked", [F.col("dg"), F.col("id")], around, [F.col("y"), F.col("x")]).where("asked").drop("asked")
    sent = wanted.join(asked, (F.col("y") == F.col("dg")) & F.col("x").eqNullSafe(F.col("id"))).select("g", "only", "i", "j", "side", "u", "copies", "bands", "t")
    verified = cut(sent.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_verify(k, min_jaccard), "u long, v long, links long"))
    links = verified.groupBy("u").agg(F.sum("links").alias("links"))
    parts = cut(components(verified.select("u", "v")))
    node = same.select("n", "s1", "s2", "u", "copies", "least").join(parts, "u", "left").join(links, "u", "left")
    node = node.where("copies > 1 or links > 0").withColumn("root", F.coalesce("root", "u"))
    first = node.groupBy("root").agg(F.min("least").alias("head"))
    node = cut(node.join(first, "root").select("n", "s1", "s2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "head"))
    every = sketches.select("id", "dg", "rid", "n", "s1", "s2").join(node, ["n", "s1", "s2"], "left")
    alone = F.col("head").isNull()
    return every.select("id", "dg", "rid", F.when(alone, F.col("id")).otherwise(F.col("head.id")).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (alone | (F.col("rid") == F.col("head.rid"))).alias("keep"), (~alone).alias("grouped"))


def near_duplicates(docs: DataFrame, k: int = 3, min_jaccard: float = 0.5, bands: int = 48, per_band: int = 4, id_col: str = "doc_id", text_col: str = "text", block_nodes: int = 2048, block_shingles: int = 4_000_000) -> DataFrame:
    """``doc_id, group_id, n_links, keep`` of every document, one row for each row.

    Two documents are linked if their sets of ``k``-word shingles have a Jaccard
    similarity of ``min_jaccard`` or more; ``n_links`` counts a document's links,
    copies too. Groups are the connected components; ``group_id`` is a group's
    least doc_id, and ``keep`` marks the one row that stands for the group. A
    document without links is a group of its own.

    A pair at the threshold becomes a candidate with probability
    1 - (1 - min_jaccard**per_band)**bands, 0.95 by default; more similar pairs
    more surely, equal sets always. All candidates are verified exactly, whatever
    the size of a band; ``block_nodes`` and ``block_shingles`` bound a task's
    memory, never the result. Null text and text without words has no link; text
    of fewer than ``k`` words has one shingle. Ids may be of any type. Rows that
    repeat an id, or have none, are documents of their own: null ids come last in
    a group, and of rows equal in id and text one is kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    found = _judged(docs, k, min_jaccard, bands, per_band, id_col, text_col, block_nodes, block_shingles)
    return found.select(F.col("id").alias("doc_id"), "group_id", "n_links", "keep")


def drop_near_duplicates(docs: DataFrame, k: int = 3, min_jaccard: float = 0.5, bands: int = 48, per_band: int = 4, id_col: str = "doc_id", text_col: str = "text", block_nodes: int = 2048, block_shingles: int = 4_000_000) -> DataFrame:
    """The documents of which one of each group of near-duplicates stays, that of
    the least id; all columns. Every row is judged by its own text: unlike texts
    under one id stay, null ids are judged like others and null texts stay. Of
    rows equal in id and text one stays. Else as in ``near_duplicates``."""
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    found = _judged(docs, k, min_jaccard, bands, per_band, id_col, text_col, block_nodes, block_shingles).where("grouped")
    x, y, whole, some = free_names(docs.columns, "x", "y", "whole", "some")
    per = cut(found.groupBy("id", "dg").agg(F.count("*").alias("n"), F.max("keep").alias("keep")).where("n > 1 or not keep").select(F.col("id").alias(x), F.col("dg").alias(y), "keep"))
    either = marked(docs, some, [digest(col(text_col))], per, [F.col(y)])
    untouched, asked = (either.where(c).select(*map(col, docs.columns)) for c in (~F.col(some), F.col(some)))
    here = (digest(asked[quoted(text_col)]) == F.col(y)) & asked[quoted(id_col)].eqNullSafe(F.col(x))
    left = untouched.unionByName(asked.join(per.select(x, y), here, "left_anti"))
    twice = per.where("keep").select(x, y)
    if not twice.limit(1).count():
        return left
    repeated = asked.join(twice, here).groupBy(x, y).agg(F.first(F.struct(*[col(c) for c in docs.columns])).alias(whole))
    return left.unionByName(repeated.select(f"{whole}.*"))
