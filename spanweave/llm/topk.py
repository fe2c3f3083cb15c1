"""Operator 10: exact top-k by inner product through a pivot-distance index.

Inner products become distances by one more component: with R2 the largest squared norm, a
vector x gets sqrt(R2 - |x|^2), a query 0; then |q - x|^2 = |q|^2 + R2 - 2 q.x, so the highest
scores are the nearest vectors and the triangle inequality holds.

Index: every vector is keyed by its nearest pivot and its distance to it. Sorted by that key and
cut into blocks of bounded rows, a block covers an annulus of one or more pivots. Pivots come from
a bounded sample (``SAMPLE`` rows by hash, farthest first, ``PIVOTS`` of them); they only steer
the search, every row is indexed and the result is exact.

Search: queries are cut into blocks the same way. Each query starts with the k-th best distance
within the sample as its radius. Query blocks meet index blocks through an equi-join on the pivot,
where the triangle inequality lets the two annuli reach each other. Inside a pair the block's
annuli (``RING`` rows each) are expanded by their lower bound, nearest first, until no query's
radius, which shrinks with each annulus, reaches the next. The k best of each pair meet in a last
ranking that keeps k rows a query before the shuffle.

Scores are integer inner products (long, wrapping like Spark's). Defined cases: vectors that are
null, or hold null or non-finite components, and rows without id take no part; a shorter vector
counts as padded with zeros; rows with the query's id are its own row; equal rows all are
candidates, and rows with equal id and vector are one query; fewer than k candidates give fewer
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanweave.llm.common import stored

SCALE = 256
SAMPLE = 2048
PIVOTS = 24
BLOCK = 16384
QUERY_BLOCK = 1024
RING = 1024
EPS = 1e-6


def _dense(values: list, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim), np.int64)
    for r, v in enumerate(values):
        out[r, :len(v)] = v
    return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """A list<long> column as rows of ``dim`` numbers, short ones padded with zeros."""
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.int64, copy=False)
    return _dense(col.to_pylist(), dim)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a with all rows of b."""
    if a.size and b.size:
        top = max(1.0, float(np.abs(a.astype(np.float64)).max())) * max(1.0, float(np.abs(b.astype(np.float64)).max()))
        if top * a.shape[1] < 2 ** 53:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Space:
    """The augmented space: pivots, largest squared norm and dimension."""

    def __init__(self, pivots: np.ndarray, dim: int, top: float):
        self.dim, self.top = dim, top
        self.pivots = pivots.astype(np.float64)
        self.rest = np.sqrt(np.maximum(0.0, top - (self.pivots ** 2).sum(axis=1)))

    def distances(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        x = rows.astype(np.float64)
        norm = (x ** 2).sum(axis=1)
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.top - norm))
        d2 = ((norm + last ** 2)[:, None] + self.top - 2 * (x @ self.pivots.T + last[:, None] * self.rest[None, :]))
        return np.sqrt(np.maximum(0.0, d2))

    def radius(self, queries: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which a vector has the given score."""
        norm = (queries.astype(np.float64) ** 2).sum(axis=1)
        return np.sqrt(np.maximum(0.0, norm + self.top - 2.0 * scores))

    def slack(self) -> float:
        """Larger than the rounding errors of distances."""
        return EPS * (1.0 + self.top ** 0.5)


def _farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    if not len(rows):
        return rows
    x = rows.astype(np.float64)
    chosen, gap = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _kth(ids: np.ndarray, scores: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """k-th best score of each query among vectors of other ids (lowest long if there are fewer)."""
    scores = np.where(ids[:, None] == names[None, :], np.iinfo(np.int64).min, scores)
    if scores.shape[1] < k:
        return np.full(len(ids), np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def exact_topk(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
               k: int = 5, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query, exact."""
    d = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = vectors.select(F.col(id_col).cast("bigint").alias("id"), d.alias("x"), is_query.alias("q")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    good = good.select("id", "q", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    shape = good.agg(F.max(norm).alias("top"), F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n"),
                     F.count_if("q").alias("asked")).first()
    dim, top = shape["dim"] or 0, shape["top"] or 0.0
    sample = good.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).collect()
    sample_ids = np.array([r["id"] for r in sample], np.int64)
    sample_rows = _dense([r["v"] for r in sample], dim)
    space = Space(_farthest_first(sample_rows, PIVOTS), dim, top)

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(2), dim)
                dist = space.distances(rows)
                near = dist.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(near.astype(np.int32)),
                     pa.array(dist[np.arange(len(near)), near])], names=["id", "q", "v", "pivot", "dist"])

    index = good.mapInArrow(keyed, "id bigint, q boolean, v array<bigint>, pivot int, dist double")

    def cut(rows: DataFrame, size: int, query: bool) -> DataFrame:
        """Rows in key order as blocks: ids and vectors as bytes, and the ring of each pivot it holds
        (index), or its distances to every pivot with the largest starting radius (queries)."""
        def run(batches):
            from pyspark import TaskContext
            number, ids, vecs, pivots, dists, held = TaskContext.get().partitionId() << 32, [], [], [], [], 0

            def block():
                nonlocal number
                x, v = np.concatenate(ids), np.concatenate(vecs)
                p, d = np.concatenate(pivots), np.concatenate(dists)
                number += 1
                if query:
                    to = space.distances(v, query=True)
                    least = _kth(x, _scores(v, sample_rows), sample_ids, k)
                    far = np.where(least == np.iinfo(np.int64).min, np.inf, space.radius(v, least.astype(np.float64)))
                    rings = [(j, float(to[:, j].min()), float(to[:, j].max())) for j in range(to.shape[1])]
                    reach = float(far.max())
                else:
                    rings = [(int(j), float(d[p == j].min()), float(d[p == j].max())) for j in np.unique(p)]
                    reach = 0.0
                return {"block": number, "ids": x.tobytes(), "vecs": v.tobytes(), "reach": reach,
                        "rings": [dict(zip(("pivot", "lo", "hi"), r)) for r in rings]}

            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    part = batch.slice(lo, size)
                    take = [part]
                    if held + part.num_rows > size:
                        take = [part.slice(0, size - held), part.slice(size - held)]
                    for one in take:
                        if one.num_rows:
                            ids.append(one.column(0).to_numpy(zero_copy_only=False))
                            vecs.append(_matrix(one.column(2), dim))
                            pivots.append(one.column(3).to_numpy(zero_copy_only=False))
                            dists.append(one.column(4).to_numpy(zero_copy_only=False))
                            held += one.num_rows
                        if held == size:
                            yield pa.RecordBatch.from_pylist([block()], schema=arrow)
                            ids, vecs, pivots, dists, held = [], [], [], [], 0
            if held:
                yield pa.RecordBatch.from_pylist([block()], schema=arrow)

        arrow = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("vecs", pa.binary()), ("reach", pa.float64()),
                           ("rings", pa.list_(pa.struct([("pivot", pa.int32()), ("lo", pa.float64()),
                                                         ("hi", pa.float64())])))])
        parts = max(1, -(-shape["asked" if query else "n"] // size))
        spread = rows.repartitionByRange(parts, "pivot", "dist", F.xxhash64("id", "v")).sortWithinPartitions(
            "pivot", "dist")
        return stored(spread.mapInArrow(run, "block bigint, ids binary, vecs binary, reach double, "
                                             "rings array<struct<pivot:int,lo:double,hi:double>>"), "index")

    blocks = cut(index, BLOCK, False)
    queries = cut(index.where("q").dropDuplicates(["id", "v"]), QUERY_BLOCK, True)

    annuli = blocks.select(F.col("block").alias("b"), F.inline("rings"))
    asked = queries.select(F.col("block").alias("qb"), "reach", F.inline("rings")).withColumnRenamed(
        "lo", "qlo").withColumnRenamed("hi", "qhi")
    slack = F.lit(space.slack())
    meet = asked.join(annuli, "pivot").where(
        (F.col("lo") - F.col("reach") <= F.col("qhi") + slack)
        & (F.col("hi") + F.col("reach") + slack >= F.col("qlo"))).select("qb", "b").distinct()
    pairs = (meet.join(queries.select(F.col("block").alias("qb"), F.col("ids").alias("qids"), F.col("vecs").alias("qvecs")), "qb")
                 .join(blocks.select(F.col("block").alias("b"), "ids", "vecs"), "b")
                 .select("qids", "qvecs", "ids", "vecs"))

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                qids, ids = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in (0, 2))
                q, v = (np.frombuffer(batch.column(c)[r].as_py(), np.int64).reshape(len(x), dim)
                        for c, x in ((1, qids), (3, ids)))
                yield _expand(space, qids, q, ids, v, k, sample_ids, sample_rows)

    found = pairs.mapInArrow(search, "query_id bigint, qkey bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _expand(space: Space, qids, q, ids, v, k, sample_ids, sample_rows) -> pa.RecordBatch:
    """The k best of one index block for one query block: rings nearest first, until none is in reach."""
    worst = np.iinfo(np.int64).min
    far = _kth(qids, _scores(q, sample_rows), sample_ids, k)
    to = space.distances(q, query=True)
    dist = space.distances(v)
    near = dist.argmin(axis=1)
    dist = dist[np.arange(len(near)), near]
    order = np.lexsort((dist, near))
    rings = [order[i:i + RING] for i in range(0, len(order), RING)]
    rings = [part for ring in rings for part in np.split(ring, np.flatnonzero(np.diff(near[ring])) + 1)]
    low = np.stack([np.maximum(dist[g[0]] - to[:, near[g[0]]], to[:, near[g[0]]] - dist[g[-1]]) for g in rings], axis=1)
    names = np.full((len(q), k), np.iinfo(np.int64).max)
    best = np.full((len(q), k), worst)
    for j in np.argsort(low.min(axis=0), kind="stable"):
        reach = np.where(far == worst, np.inf, space.radius(q, far.astype(np.float64)))
        live = np.flatnonzero(low[:, j] <= reach + space.slack())
        if not len(live):
            continue
        ring = rings[j]
        score = np.where(qids[live][:, None] == ids[ring][None, :], worst, _scores(q[live], v[ring]))
        both = np.concatenate([best[live], score], axis=1)
        name = np.concatenate([names[live], np.broadcast_to(ids[ring], score.shape)], axis=1)
        top = np.lexsort((name, ~both), axis=1)[:, :k]
        best[live], names[live] = np.take_along_axis(both, top, 1), np.take_along_axis(name, top, 1)
        far[live] = np.maximum(far[live], best[live, k - 1])
    r, c = np.nonzero(best != worst)
    mark = (q * (np.arange(1, q.shape[1] + 1, dtype=np.int64) * 0x9E3779B1)).sum(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (qids[r], mark[r], names[r, c], best[r, c])],
                                      names=["query_id", "qkey", "vec_id", "score"])


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH good AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([q.v[i] * c.v[i] FOR i IN generate_series(1, least(len(q.v), len(c.v)))]) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
