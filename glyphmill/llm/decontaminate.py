"""Benchmark items in documents, by a prefix-filtered set join.

An item is the set of its k-word shingles. A document contains an item if some
window of the item's length holds at least ``min_containment`` of the item's
shingles. Such a window holds one of the item's *prefix*: with m shingles, n of
them needed, the m - n + 1 rarest ones. So only prefix shingles make candidates,
and the rarer they are, the fewer.

The text is read once, for the places where any shingle of the benchmark stands
(``hits``). Rarity, candidates, bounds and the check of whole windows all come
from that small table. While the benchmark's shingles number at most
``max_local``, every worker looks them up in a sorted array; beyond that, the
documents' shingles are joined with them by a shuffle.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm import _text
from glyphmill.llm._shared import col, cut, digest, free_names, quoted
from glyphmill.ship import ship


def item_shingles(items: DataFrame, k: int) -> DataFrame:
    """``item, k, pos, h`` of the shingles of rows (item, t): of ``k`` words, or of
    all the words of a text that has fewer."""

    def find(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], []]
            for first, group in _text.pieces(batch.column(1)):
                h, _, _, of = _text.words(group)
                for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
                    n = min(k, b - a)
                    s = _text.shingles(h[a:b], n).view(np.int64).tolist() if n else []
                    for c, v in zip(out, ([ids[first + i]] * len(s), [n] * len(s), range(len(s)), s), strict=True):
                        c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["item", "k", "pos", "h"])

    return items.mapInArrow(find, "item long, k int, pos int, h long")


def shingle_positions(rows: DataFrame, sizes: list[int], only: np.ndarray | None = None) -> DataFrame:
    """``dg, pos, h`` of all shingles of so many words of rows (dg, t), or of those
    in the sorted array ``only``."""

    def find(batches):
        for batch in batches:
            for first, group in _text.pieces(batch.column(1)):
                h, _, _, of = _text.words(group)
                for k in sizes:
                    s = _text.shingles(h, k)
                    ok = _text.inside(of, k)
                    if only is not None and len(s) and len(only):
                        at = np.minimum(np.searchsorted(only, s), len(only) - 1)
                        ok &= only[at] == s
                    at = np.flatnonzero(ok)
                    if not len(at) or only is not None and not len(only):
                        continue
                    text = np.searchsorted(of, at, side="right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first + text)), pa.array((at - of[text]).astype(np.int32)), pa.array(s[at].view(np.int64))], ["dg", "pos", "h"])

    return rows.mapInArrow(find, "dg binary, pos int, h long")


def _best_windows(batches):
    """Of rows (dg, item, pos, h, w, need, m) sorted by dg, item, pos: for each
    (dg, item) the most distinct shingles in any w consecutive positions, and
    where the first such window begins, if they are as many as needed."""
    key, held, counts = None, deque(), {}
    best, start, need, m = 0, 0, 0, 0
    out: list[tuple] = []

    def batch():
        got = list(zip(*out, strict=True)) or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["dg", "item", "start_word", "matched", "n_shingles"])

    for b in batches:
        for i, item, pos, h, w, n, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (i, item):
                if key is not None and best >= need:
                    out.append((*key, start, best, m))
                key, best, need, m = (i, item), 0, n, size
                held.clear()
                counts.clear()
            held.append((pos, h))
            counts[h] = counts.get(h, 0) + 1
            while held[0][0] <= pos - w:
                old = held.popleft()[1]
                counts[old] -= 1
                if not counts[old]:
                    del counts[old]
            if len(counts) > best:
                best, start = len(counts), held[0][0]
        if len(out) >= 10_000:
            yield batch()
    if key is not None and best >= need:
        out.append((*key, start, best, m))
    yield batch()


def _found(docs, benchmark, k, min_containment, text_col, item_col, item_text_col, max_local):
    """``dg, item_id, start_word, matched, n_shingles`` by the digest of the text."""
    items = cut(benchmark.select(col(item_col).alias("item_id"), col(item_text_col).alias("t")).where("t is not null").withColumn("item", F.monotonically_increasing_id()))
    src = docs.select(digest(col(text_col)).alias("dg"), col(text_col).alias("t")).where("t is not null")
    shingles = cut(item_shingles(items.select("item", "t"), k).groupBy("item", "k", "h").agg(F.max("pos").alias("last")))
    sizes = [r[0] for r in shingles.select("k").distinct().orderBy("k").collect()]  # 1 .. k
    distinct = shingles.select("h").distinct()
    if distinct.limit(max_local + 1).count() <= max_local:
        local = np.sort(distinct.toPandas()["h"].to_numpy(np.int64).view(np.uint64))
        hits = shingle_positions(src, sizes, local)
    else:
        hits = shingle_positions(src, sizes).join(distinct, "h", "left_semi")
    hits = cut(hits.distinct())
    rarity = hits.groupBy("h").agg(F.count("*").alias("n"))
    per_item = Window.partitionBy("item")
    ranked = (
        shingles.join(rarity, "h", "left")
        .withColumn("rank", F.row_number().over(per_item.orderBy(F.coalesce("n", F.lit(0)), "h")))
        .withColumn("m", F.count("*").over(per_item).cast("int"))
        .withColumn("w", (F.max("last").over(per_item) + 1).cast("int"))
        .withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("m") * F.lit(min_containment) - F.lit(1e-9))).cast("int"))
    )
    ranked = cut(ranked.select("item", "h", "rank", "m", "w", "need"))
    prefix = ranked.where("rank <= m - need + 1").select("item", "h", "w")
    # positional bound: only what lies within a window's reach of a prefix hit;
    # length bound: as many hits there as are needed, before windows are slid
    pairs = prefix.join(hits, "h").groupBy("dg", "item").agg(F.collect_set(F.floor(F.col("pos") / F.col("w"))).alias("near"))
    block = F.floor(F.col("pos") / F.col("w"))
    reach = (
        hits.join(pairs, "dg").join(ranked.select("item", "h", "m", "w", "need"), ["item", "h"])
        .where(F.arrays_overlap("near", F.array(block - 1, block, block + 1)))
        .withColumn("there", F.count("*").over(Window.partitionBy("dg", "item"))).where("there >= need")
    )
    found = reach.select("dg", "item", "pos", "h", "w", "need", "m").repartition("dg").sortWithinPartitions("dg", "item", "pos").mapInArrow(_best_windows, "dg binary, item long, start_word int, matched int, n_shingles int")
    return found.join(items.select("item", "item_id"), "item")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 3, min_containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_local: int = 4_000_000) -> DataFrame:
    """``doc_id, item_id, start_word, matched, n_shingles``: every document and
    benchmark item of which some window of the item's length has ``matched`` of
    the item's ``n_shingles`` distinct shingles, at least ``min_containment`` of
    them; the best window, the first in ties.

    Words are compared in lower case without punctuation. An item of fewer than
    ``k`` words is one shingle of all of them; one without words is never found.
    Every row of either table is judged by itself: those that repeat an id and
    those without one too, ids may be of any type. Null texts give no row. Other
    columns are ignored. Empty tables give an empty result.
    """
    ship(docs.sparkSession)
    found = cut(_found(docs, benchmark, k, min_containment, text_col, item_col, item_text_col, max_local))
    named = docs.select(col(id_col).alias("doc_id"), digest(col(text_col)).alias("dg"))
    return named.join(found, "dg").select("doc_id", "item_id", "start_word", "matched", "n_shingles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 3, min_containment: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_local: int = 4_000_000) -> DataFrame:
    """The documents in which no benchmark item is found, all columns, rows as
    they were, whatever their ids; null texts stay. Else as in ``contaminated``."""
    ship(docs.sparkSession)
    [bad] = free_names(docs.columns, "bad")
    found = cut(_found(docs, benchmark, k, min_containment, text_col, item_col, item_text_col, max_local).select(F.col("dg").alias(bad)).distinct())
    return docs.join(found, digest(docs[quoted(text_col)]) == F.col(bad), "left_anti")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, i - 1 AS pos, array_to_string(t[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM w, range(1, 4) r(k))),
b AS (SELECT item_id, t, least(3, len(t)) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS t FROM benchmark) WHERE len(t) > 0),
s AS (SELECT item_id, g, max(pos) AS pos FROM (SELECT item_id, i - 1 AS pos, array_to_string(t[i:i + k - 1], ' ') AS g FROM (SELECT item_id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM b)) GROUP BY 1, 2),
z AS (SELECT item_id, count(*) AS m, max(pos) + 1 AS w FROM s GROUP BY 1),
hit AS (SELECT DISTINCT doc_id, item_id, d.pos, g FROM d JOIN s USING (g)),
win AS (SELECT x.doc_id, x.item_id, x.pos AS start, m, count(DISTINCT y.g) AS n
  FROM hit x JOIN z USING (item_id) JOIN hit y ON y.doc_id = x.doc_id AND y.item_id = x.item_id AND y.pos >= x.pos AND y.pos < x.pos + z.w GROUP BY 1, 2, 3, 4),
best AS (SELECT doc_id, item_id, m, max(n) AS n FROM win GROUP BY 1, 2, 3)
SELECT doc_id, item_id, CAST(min(start) AS INTEGER) AS start_word, CAST(best.n AS INTEGER) AS matched, CAST(best.m AS INTEGER) AS n_shingles
FROM best JOIN win USING (doc_id, item_id) WHERE win.n = best.n AND best.n >= ceil(best.m * 0.8 - 1e-9) GROUP BY 1, 2, 4, 5
"""
