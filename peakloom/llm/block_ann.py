"""Nearest neighbours by a block matrix join with int8 product tiles.

Vectors are cut into blocks by a hash of their row; every query block meets every candidate block in
one tile.  A tile multiplies int8 versions (exact in float32) and bounds the error by the norms of
what rounding took away.  Pairs whose upper bound reaches the k-th best lower bound are recomputed in
double precision, and a heap keeps the k best of each query, per tile and when tiles are merged.  The
bounds hold, so the result is exact.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part.  Vectors of
different length never meet.  Rows with equal ids are different rows; a query skips only its own row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import settle, with_row

BLOCK_ROWS = 8_192
K = 20


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """_row, vec_id, vec (array of double) and dim of the vectors that take part."""
    vec = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        with_row(df.select("vec_id", vector))
        .select("_row", "vec_id", vec.alias("vec"))
        .filter(F.col("vec").isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0))
        .withColumn("dim", F.size("vec"))
    )


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32), scale, norm of the scaled values, norm of the error."""
    scale = np.abs(vectors).max(axis=1) / 127
    scale[scale == 0] = np.finfo(np.float64).tiny
    small = np.rint(vectors / scale[:, None])
    near = small * scale[:, None]
    return small.astype(np.float32), scale, np.linalg.norm(near, axis=1), np.linalg.norm(vectors - near, axis=1)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added component by component so that equal vectors give equal values."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


# Products of int8 values fit into float32 without rounding up to 127 * 127 * width < 2 ** 24.
SLAB = 1_024


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 values of any width: slabs in float32, their sum in float64."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], SLAB):
        total += a[:, at : at + SLAB] @ b[:, at : at + SLAB].T
    return total


def tile(q_rows, q: np.ndarray, c_rows, c_ids, c: np.ndarray, k: int, step: int = 256) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Place of each query with its best (score, -vec_id) pairs among the candidates of the tile."""
    c8, cs, cn, ce = quantised(c)
    norm = np.linalg.norm(c, axis=1)
    for at in range(0, len(q), step):
        part = q[at : at + step]
        q8, qs, qn, qe = quantised(part)
        rough = int8_products(q8, c8) * (qs[:, None] * cs[None, :])
        # <q, c> = <q', c'> + <q', c - c'> + <q - q', c>; a little more covers rounding.
        slack = qn[:, None] * ce[None, :] + qe[:, None] * norm[None, :]
        slack += 1e-9 * (np.abs(rough) + slack) + np.finfo(np.float64).tiny
        own = q_rows[at : at + step, None] == c_rows[None, :]
        low = np.where(own, -np.inf, rough - slack)
        if low.shape[1] > k:
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, -k]
        else:
            floor = np.full(len(part), -np.inf)
        qi, ci = np.nonzero((rough + slack >= floor[:, None]) & ~own)
        score = exact_products(part[qi], c[ci])
        cuts = np.searchsorted(qi, np.arange(len(part) + 1))
        for i in range(len(part)):
            some = slice(cuts[i], cuts[i + 1])
            yield at + i, heapq.nlargest(k, zip(score[some].tolist(), (-c_ids[ci[some]]).tolist(), strict=True))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("vec").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query row.

    Both sides come from :func:`usable`, so ``_row`` tells the rows apart.
    """
    blocks = lambda df: max(1, math.ceil(df.count() / block_rows))
    n_c, n_q = blocks(vectors), blocks(queries)
    place = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = vectors.select("_row", "vec_id", "vec", "dim", place(n_c).alias("cb")).withColumn("qb", every(n_q))
    q = queries.select("_row", "vec_id", "vec", "dim", place(n_q).alias("qb")).withColumn("cb", every(n_c))
    keys = ["dim", "qb", "cb"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"_row": [], "query_id": [], "score": [], "vec_id": []}
        if len(left) and len(right):
            rows, ids = (left.column(n).to_numpy() for n in ("_row", "vec_id"))
            c_rows, c_ids = (right.column(n).to_numpy() for n in ("_row", "vec_id"))
            for i, best in tile(rows, _matrix(left), c_rows, c_ids, _matrix(right), k):
                out["_row"].append(rows[i])
                out["query_id"].append(ids[i])
                out["score"].append([s for s, _ in best])
                out["vec_id"].append([-v for _, v in best])
        kinds = {"_row": pa.int64(), "query_id": pa.int64(), "score": pa.list_(pa.float64()), "vec_id": pa.list_(pa.int64())}
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})

    lists = "_row bigint, query_id bigint, score array<double>, vec_id array<bigint>"
    found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet, lists)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one query lie together; a heap of k is kept for it."""
        now, name, heap = None, None, []

        def done():
            best = sorted(heap, reverse=True)
            return [(name, i + 1, -v, s) for i, (s, v) in enumerate(best)]

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["_row"] != now:
                    out += done()
                    now, name, heap = r["_row"], r["query_id"], []
                for s, v in zip(r["score"], r["vec_id"], strict=True):
                    (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (s, -v))
            if out:
                yield _ranked(out)
        if heap:
            yield _ranked(done())

    kept = found.repartition("_row").sortWithinPartitions("_row")
    return kept.mapInArrow(merge, "query_id bigint, rank int, vec_id bigint, score double")


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    query, rank, vec, score = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(query, pa.int64()), pa.array(rank, pa.int32()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())],
        ["query_id", "rank", "vec_id", "score"],
    )


def search(embeddings: DataFrame, every: int = 20, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``; rows without an id take no part."""
    vectors = settle(usable(embeddings).filter("vec_id IS NOT NULL"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % every == 0), k, block_rows)
