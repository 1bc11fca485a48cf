"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt to blocks of bounded size, both as tables, and
each pair of blocks (of vectors of one length) meets in a task: it holds the
queries, and streams the candidates.  A tile of the product is computed on int8
vectors.  With r the length of what rounding took from a unit vector, the cosine
differs from the tile's value by at most r_a + r_b * |b'|, so pairs whose upper
bound stays below a query's k-th best lower bound are dropped; the rest are
recomputed in double precision and kept in one heap per query.  The heaps of all
tasks, k rows each at most, are merged at the end.

Rows that agree in id and vector are counted before they are dealt, so no
frequent id or row makes a block large.  Of equal candidates within a batch at
most k rows of each id are kept, and of those the 2k of smallest id: at most k
of them are a query's own, so its k smallest others are among them.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, and null ids neither; a query meets the candidates of
its own vector's length; equal scores go to the smaller id; repeated rows are candidates each
(a query's own id is never returned, and a repeated query id is one query, with
the least of its vectors); with fewer candidates than k all are returned; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches, written

SCHEMA = "query_id long, vec_id long, score double"
TILE = 2048


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine & F.exists("embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long"), F.col("embedding").alias("v"))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length, in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


class Quantised:
    """Unit vectors, their int8 form (held as float32, in which tiles of up to 1,040 dimensions are exact, else as float64) and bounds."""

    def __init__(self, x: np.ndarray):
        big = np.abs(x).max(axis=1, keepdims=True)
        x = x / big  # so that squares neither overflow nor vanish
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        self.step = np.abs(unit).max(axis=1) / 127
        whole = np.rint(unit / self.step[:, None]).astype(np.int8)
        near = whole * self.step[:, None]
        self.rest = np.sqrt(((unit - near) ** 2).sum(axis=1)) + 1e-9
        self.size = np.sqrt((near**2).sum(axis=1))
        self.tile = whole.astype(np.float32 if whole.shape[1] <= 1040 else np.float64)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal rows give equal results wherever they stand."""
    sa, sb = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    small = np.minimum(sa, sb).min(initial=1.0) < 1e-100 or np.maximum(sa, sb).max(initial=1.0) > 1e100
    if small:
        a, b = a / sa, b / sb
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _ranks(group: np.ndarray) -> np.ndarray:
    """Each row's number among the rows of its group, in their order."""
    by = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    rank = np.empty(len(group), np.int64)
    rank[by] = np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rank


def fewer_copies(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors, at most k rows of each id, and of those the 2k of smallest id."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    raw = np.ascontiguousarray(x).view([("", x.dtype)] * x.shape[1]).ravel()
    _, group = np.unique(raw, return_inverse=True)
    _, pair = np.unique(np.stack([group, ids]), axis=1, return_inverse=True)
    own = np.flatnonzero(_ranks(pair.ravel()) < k)
    own = own[_ranks(group[own]) < 2 * k]
    return ids[own], x[own]


class Block:
    """Queries of one length, with a heap of their best candidates so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k, self.qq = ids, q, k, Quantised(q)
        self.best = [[] for _ in ids]  # heaps of (score, -id)
        self.floor = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        q_ids, q, k, qq, best, floor = self.ids, self.q, self.k, self.qq, self.best, self.floor
        ids, x = fewer_copies(ids, x, k)
        for at in range(0, len(ids), TILE):
            c_ids, c = ids[at : at + TILE], x[at : at + TILE]
            cc = Quantised(c)
            for lo in range(0, len(q_ids), TILE):
                hi = min(lo + TILE, len(q_ids))
                about = (qq.tile[lo:hi] @ cc.tile.T) * (qq.step[lo:hi, None] * cc.step[None, :])
                error = qq.rest[lo:hi, None] + qq.size[lo:hi, None] * cc.rest[None, :]
                about[q_ids[lo:hi, None] == c_ids[None, :]] = -np.inf
                if about.shape[1] >= k:
                    lower = np.partition(about - error, -k, axis=1)[:, -k]
                    lower = np.maximum(lower, floor[lo:hi])
                else:
                    lower = floor[lo:hi]
                i, j = np.nonzero((about + error >= lower[:, None]) & (about > -np.inf))
                for part in range(0, len(i), 65_536):
                    pi, pj = i[part : part + 65_536], j[part : part + 65_536]
                    for s, row, vec in zip(cosines(q[lo + pi], c[pj]).tolist(), (lo + pi).tolist(), c_ids[pj].tolist(), strict=True):
                        heap = best[row]
                        if len(heap) < k:
                            heapq.heappush(heap, (s, -vec))
                        elif (s, -vec) > heap[0]:
                            heapq.heapreplace(heap, (s, -vec))
                for row in np.unique(i).tolist():
                    if len(best[lo + row]) == k:
                        floor[lo + row] = best[lo + row][0][0]


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, block: int = 16_384, candidates: int = 131_072) -> DataFrame:
    """The k nearest of each query (ids divisible by ``every``): query_id, rank, vec_id, score.

    Blocks hold about ``block`` queries and ``candidates`` candidates, fewer
    where that would leave cores idle.  Larger ones are copied less: a vector is
    sent to as many tasks as the other side has blocks.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    own = usable(embeddings).groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    vectors = written(own.withColumn("width", F.size("v")), "vectors")
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, n_queries = vectors.count(), queries.count()
    # Hashing deals rows evenly.
    q_blocks = max(1, -(-n_queries // block))
    c_blocks = max(1, -(-n // candidates), min(4 * spark.sparkContext.defaultParallelism, n // 1024))
    side = lambda df, i, q, c: df.select(F.size("v").alias("width"), q.alias("q"), c.alias("c"), F.lit(i).alias("side"), "vec_id", "copies", "v")
    every_block = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = side(queries.withColumn("copies", F.lit(1)), 0, F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int"), every_block(c_blocks))
    right = side(vectors, 1, every_block(q_blocks), F.pmod(F.xxhash64("vec_id", "v"), F.lit(c_blocks)).cast("int"))

    def found(b: Block) -> Iterator[pa.RecordBatch]:
        rows = [(int(b.ids[i]), -v, s) for i, heap in enumerate(b.best) for s, v in heap]
        for at in range(0, len(rows), 65_536):
            cols = list(zip(*rows[at : at + 65_536], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, held = None, None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                ids, x = part.column(4).to_numpy(), _matrix(part.column(6))
                if key != tuple(keys[lo, :3]):
                    if own is not None:
                        yield from found(own)
                    key, own, held = tuple(keys[lo, :3]), None, []
                if keys[lo, 3] == 0:
                    held.append((ids, x))
                    continue
                if held:
                    own, held = Block(np.concatenate([i for i, _ in held]), np.concatenate([q for _, q in held]), k), []
                if own is not None:
                    copies = part.column(5).to_numpy()
                    own.meet(np.repeat(ids, copies), np.repeat(x, copies, axis=0))
        if own is not None:
            yield from found(own)

    dealt = left.unionByName(right).repartition("width", "q", "c").sortWithinPartitions("width", "q", "c", "side")
    # Each task gives at most k rows per query, so a query's merge is small.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return dealt.mapInArrow(run, SCHEMA).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
