"""Exact nearest neighbours by pivot-table elimination.

The table holds every vector's distance to many pivots. By the triangle inequality
the greatest difference of two vectors' entries is a lower bound of their distance.
A query takes its candidates in the order of their bounds and stops at the first
bound beyond its k-th distance.

Vectors near one pivot, in rings of like distance to it, form small cells. Blocks of
queries that lie together visit cells, those of the least bounds first, by rounds of
ever more cells; after each round only the cells stay whose bound doesn't pass the
k-th distances found so far. Nothing but the pivots goes to every worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm._shared import col, cut
from glyphmill.ship import ship

EPS = 1e-9
#: Pivots whose ranges describe a cell or a block of queries.
SPANS = 16


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those before it."""
    chosen = [0]
    near = np.linalg.norm(vectors - vectors[0], axis=1)
    while len(chosen) < min(n, len(vectors)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(vectors - vectors[chosen[-1]], axis=1))
    return vectors[chosen]


def _matrix(column, width: int, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def _ids(column) -> np.ndarray:
    return np.array(column.to_pylist()) if len(column) else np.empty(0, np.int64)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def nearest(q, q_table, q_id, bound, x, x_table, x_id, k: int, first: int = 64):
    """Of each query the k least (distance, id) among the vectors of another id and
    within the query's bound: query indices, vector indices, distances, and how many
    distances were evaluated. ``x_table`` has a row a pivot."""
    found: list[tuple] = []
    evaluated = 0
    slack = 1e-5 * (1 + float(np.abs(x_table).max(initial=0)))  # single precision must not raise a bound
    for n in range(len(q)):
        lower = np.abs(x_table - q_table[n][:, None]).max(axis=0) - slack
        near = np.flatnonzero((lower <= bound[n]) & (x_id != q_id[n]))
        if not len(near):
            continue
        near = near[np.argsort(lower[near], kind="stable")]
        limit, at, step = bound[n], 0, first
        best, far = np.empty(0, np.int64), np.empty(0)
        while at < len(near) and lower[near[at]] <= limit + EPS:
            part = near[at : at + step]
            part = part[: np.searchsorted(lower[part], limit + EPS, side="right")]
            at, step = at + step, step * 2
            evaluated += len(part)
            d = np.sqrt(((x[part] - q[n]) ** 2).sum(axis=1))
            best, far = np.concatenate((best, part)), np.concatenate((far, d))
            least = np.lexsort((x_id[best], far))[:k]
            best, far = best[least], far[least]
            if len(best) == k:
                limit = min(limit, far[-1])
        fine = far <= bound[n] + EPS
        found.append((np.full(int(fine.sum()), n), best[fine], far[fine]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), evaluated
    return (*(np.concatenate(c) for c in zip(*found, strict=True)), evaluated)


def top_k(vectors: DataFrame, k: int = 10, queries: Column | None = None, n_pivots: int = 64, pivot_sample: int = 2000, cell_size: int = 64, query_block: int = 1024, stripe: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, rank, neighbor_id, distance``: of every vector for which the
    condition ``queries`` holds (all by default) the k nearest of another id among
    all vectors, by Euclidean distance, exactly; of equal distances the lesser id
    first.

    Pivots are chosen among the ``pivot_sample`` vectors of the least hashed ids;
    they, ``cell_size``, ``query_block`` and ``stripe`` (cells that a task takes)
    decide about cost only, never about the result. Ids are integers or strings.
    Null ids, null vectors and those with null, NaN or infinite elements or of
    another length than the commonest have no rows and are nobody's neighbours.
    Every row is a vector of its own: rows of one id are not each other's
    neighbours, but each may be a third's, and each is a query. With fewer than k
    others a vector has fewer rows. Other columns are ignored; an empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    names = {f.name: f.dataType for f in vectors.schema.fields}
    kind = names[id_col].simpleString()
    asked = F.coalesce(queries, F.lit(False)) if queries is not None else F.lit(True)
    raw = vectors.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("v"), asked.alias("q")).where("id is not null and v is not null and size(v) > 0")
    fine = raw.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    width = fine.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if width is None:
        return fine.select(F.col("id").alias("vec_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbor_id"), F.lit(0.0).alias("distance"))
    width = width["w"]
    points = fine.where(F.size("v") == width)
    few = points.orderBy(F.xxhash64("id"), "id", "v").limit(pivot_sample).select("v").collect()
    pivots = choose_pivots(np.array([r["v"] for r in few]), n_pivots)
    n_pivots = len(pivots)

    def measure(batches):
        for b in batches:
            x = _matrix(b.column(1), width)
            t = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)
            near = t.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(t.astype(np.float32)), pa.array(near.astype(np.int32)), pa.array(t[np.arange(len(t)), near])], ["id", "v", "q", "t", "p", "d"])

    table = points.mapInArrow(measure, f"id {kind}, v array<double>, q boolean, t array<float>, p int, d double")
    # a global sort by nearest pivot and distance; every so many rows of a sorted
    # partition are a cell, whatever the number of pivots
    cell = F.floor(F.monotonically_increasing_id() / cell_size)
    table = cut(table.orderBy("p", "d", "id").withColumn("cell", cell).select("id", "v", "q", "t", "cell"))

    def around(batches, step=2048):
        """Queries with an upper bound of their k-th distance, from the vectors stored next to them."""
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                some = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False))
                if not len(some):
                    continue
                ids, x, t = _ids(part.column(0)), _matrix(part.column(1), width), _matrix(part.column(3), n_pivots, np.float32)
                bound = np.full(len(some), np.inf)
                i, _, d, _ = nearest(x[some], t[some], ids[some], bound, x, np.ascontiguousarray(t.T), ids, k)
                count = np.bincount(i, minlength=len(some))
                bound[count == k] = d[np.cumsum(count)[count == k] - 1]
                out = part.take(pa.array(some))
                yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(3), out.column(4), pa.array(bound)], ["id", "v", "t", "cell", "bound"])

    asking = table.mapInArrow(around, f"id {kind}, v array<double>, t array<float>, cell long, bound double")
    asking = cut(asking.orderBy("cell", "id").withColumn("qid", F.monotonically_increasing_id()).withColumn("block", F.floor(F.col("qid") / query_block)))
    spans = F.array(*[f(F.element_at("t", p + 1)) for p in range(min(SPANS, n_pivots)) for f in (F.min, F.max)])
    blocks = asking.groupBy("block").agg(spans.alias("qs"), F.max("bound").alias("bound"))
    cells = table.groupBy("cell").agg(spans.alias("xs"))
    gaps = [F.greatest(F.element_at("qs", 2 * p + 1) - F.element_at("xs", 2 * p + 2), F.element_at("xs", 2 * p + 1) - F.element_at("qs", 2 * p + 2)) for p in range(min(SPANS, n_pivots))]
    gap = F.greatest(*gaps, F.lit(0.0)).cast("double") - 1e-5 * (1 + F.greatest(*[F.element_at("xs", 2 * p + 2) for p in range(min(SPANS, n_pivots))], F.lit(0.0)))
    # the stated queries against all vectors, block by cell
    visits = blocks.crossJoin(cells).withColumn("gap", gap).where("gap <= bound")
    turn = F.row_number().over(Window.partitionBy("block").orderBy("gap", "cell")) - 1
    visits = cut(visits.withColumn("turn", F.floor(turn / stripe)).select("block", "cell", "gap", "turn"))

    def visit(key, qs: pa.Table, xs: pa.Table) -> pa.Table:
        q_id, x_id = _ids(qs.column("id")), _ids(xs.column("id"))
        if not len(q_id) or not len(x_id):
            i = j = np.empty(0, np.int64)
            d = np.empty(0)
        else:
            x_table = np.ascontiguousarray(_matrix(xs.column("t"), n_pivots, np.float32).T)
            i, j, d, _ = nearest(_matrix(qs.column("v"), width), _matrix(qs.column("t"), n_pivots, np.float32), q_id, qs.column("bound").to_numpy(), _matrix(xs.column("v"), width), x_table, x_id, k)
        return pa.table({"qid": qs.column("qid").take(pa.array(i)), "id": qs.column("id").take(pa.array(i)), "other": xs.column("id").take(pa.array(j)), "distance": d})

    found, begin, end = None, 0, 1
    while True:
        now = visits.where((F.col("turn") >= begin) & (F.col("turn") < end))
        sent = table.join(now, "cell").select(F.col("block").alias("x_block"), F.col("turn").alias("x_turn"), "id", "v", "t")
        asked_now = asking.join(now.select("block", "turn").distinct(), "block")
        got = asked_now.groupBy("block", "turn").cogroup(sent.groupBy("x_block", "x_turn")).applyInArrow(visit, f"qid long, id {kind}, other {kind}, distance double")
        got = cut(got)
        found = got if found is None else found.union(got)
        begin, end = end, end * 8
        if not visits.where(F.col("turn") >= begin).limit(1).count():
            break
        rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance"))
        kth = found.withColumn("r", rank).where(F.col("r") == k).select("qid", F.col("distance").alias("kth"))
        asking = cut(asking.join(kth, "qid", "left").withColumn("bound", F.least("bound", F.coalesce("kth", F.lit(float("inf"))))).drop("kth"))
        limit = asking.groupBy("block").agg(F.max("bound").alias("bound"))
        visits = cut(visits.where(F.col("turn") >= begin).join(limit, "block").where(F.col("gap") <= F.col("bound") + EPS).select("block", "cell", "gap", "turn"))
        if not visits.limit(1).count():
            break
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("vec_id"), "rank", F.col("other").alias("neighbor_id"), "distance")


ORACLE = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbor_id) AS rank FROM p) WHERE rank <= 10
"""
