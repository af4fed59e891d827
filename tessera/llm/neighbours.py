"""Nearest neighbours by a block matrix join.

Rows and queries are packed into blocks; each pair of a query block and a row
block is one tile. A tile multiplies int8 codes, which gives every inner
product with a bound on its quantisation error; only pairs whose upper bound
reaches the best lower bounds are computed again in double precision, and heaps
merge the survivors. The result is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


EXACT = (1 << 24) // (127 * 127)  # dimensions


def _usable(vec: str) -> Column:
    x = F.col(vec)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    col = t.column(name).combine_chunks()
    flat = np.asarray(col.flatten(), dtype=np.float64)
    return flat.reshape(len(col), -1)


def _codes(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (held as float32), scales, norms, norms of what the codes miss."""
    scale = np.abs(m).max(axis=1) / 127.0
    scale[scale == 0] = 1.0  # denormal vectors
    units = m / scale[:, None]  # so that no square overflows or vanishes
    code = np.rint(units).astype(np.int8)
    return code.astype(np.float32), scale, np.linalg.norm(units, axis=1) * scale, np.linalg.norm(units - code, axis=1) * scale


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of codes; exact, as float32 holds the sums of slices of EXACT dimensions."""
    total = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        total += a[:, d : d + EXACT] @ b[:, d : d + EXACT].T
    return total


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added up from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def search_tile(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, step: int = 1024) -> list[tuple[int, int, float]]:
    """The k nearest of ``rows`` to each of ``q`` by (score descending, id), never a query's own id."""
    qc, qs, qn, qm = _codes(q)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    floor = np.full(len(q_ids), -np.inf)

    def keep(qi: np.ndarray, ri: np.ndarray, part: np.ndarray, part_ids: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            scores = exact_products(q[qi], part[ri])
        for i, j, s in zip(qi.tolist(), ri.tolist(), np.where(np.isnan(scores), -np.inf, scores).tolist(), strict=True):
            heap, item = heaps[i], (s, -int(part_ids[j]))
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)

    for at in range(0, len(ids), step):
        part, part_ids = rows[at : at + step], ids[at : at + step]
        rc, rs, rn, rm = _codes(part)
        own = q_ids[:, None] == part_ids[None, :]
        with np.errstate(over="ignore"):
            bounded = np.isfinite(qn.max() * rn.max() * 4)
        if not bounded:
            # Products beyond double precision have no bound: every pair is computed.
            keep(*np.nonzero(~own), part, part_ids)
            continue
        near = code_products(qc, rc) * qs[:, None] * rs[None, :]
        # |q.r - near| <= |missed q| |r| + |coded q| |missed r|, and a little for rounding.
        error = qm[:, None] * rn[None, :] + (qn + qm)[:, None] * rm[None, :]
        error += (1e-12 + q.shape[1] * 2.0**-52) * (qn[:, None] * rn[None, :] + 1e-300)
        low = np.where(own, -np.inf, near - error)
        if low.shape[1] > k:
            sure = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
            floor = np.maximum(floor, sure)
        qi, ri = np.nonzero((near + error >= floor[:, None]) & ~own)
        keep(qi, ri, part, part_ids)
        floor = np.maximum(floor, np.array([h[0][0] if len(h) == k else -np.inf for h in heaps]))
    return [(int(i), -j, s) for i, heap in zip(q_ids, heaps, strict=True) for s, j in heap]


def nearest(df: DataFrame, queries: Column, *, k: int = 20, key: str = "vec_id", vec: str = "embedding", query_block: int = 1024, row_block: int = 8192) -> DataFrame:
    """For each row where ``queries`` holds, its ``k`` nearest other rows by inner product.

    Returns query_id, rank (int, from 1), vec_id, score (double); ties go to
    the smaller id. Vectors that are null, empty, all zero or hold a null or
    non-finite component take no part, nor do rows without an id; a query meets
    rows of its own length only. A row never finds a row of its own id; other
    ids' equal vectors all count. Products beyond double precision are infinite,
    and sums of infinities of both signs count as the least. Fewer than k candidates give fewer rows, an
    empty table none. Other columns are ignored.
    """
    rows = df.filter(F.col(key).isNotNull() & _usable(vec)).select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), F.size(vec).alias("dim"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = cut(rows, "vectors")
    n, n_q = rows.agg(F.count("*"), F.count(F.when(F.col("is_query"), 1))).first()
    r_blocks, q_blocks = max(1, math.ceil(n / row_block)), max(1, math.ceil(n_q / query_block))
    block = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.filter("is_query").select("id", "v", "dim", block(q_blocks, 1).alias("qb"), each(r_blocks).alias("rb"))
    right = rows.select("id", "v", "dim", each(q_blocks).alias("qb"), block(r_blocks, 2).alias("rb"))

    def tile(q: pa.Table, r: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if q.num_rows and r.num_rows:
            found = search_tile(q.column("id").to_numpy(), _matrix(q, "v"), r.column("id").to_numpy(), _matrix(r, "v"), k)
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    tiles = left.groupBy("dim", "qb", "rb").cogroup(right.groupBy("dim", "qb", "rb")).applyInArrow(tile, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
