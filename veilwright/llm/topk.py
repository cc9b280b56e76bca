"""Exact top-k search by inner product with a pivot table.

Each row's distances to the pivots are computed once and stored. For a query q and a row c, the largest
|d(q, p) - d(c, p)| over the pivots p is a lower bound of their distance, and with both norms it gives an upper
bound of their inner product. Rows are evaluated in falling order of that bound until it is below the k-th
best score found, so the result is exact whatever the pivots are.

Rows stay where they are; queries come to them in blocks of bounded size, one block at a time, so that neither the
driver nor the executors ever hold more than a block of them. Each task keeps k rows a query.

Products are exact: of vectors of moderate size in doubles, of larger ones in integers of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwright.llm.runtime import Scratch, ship

TABLE = "vec_id long, ints binary, norm2 double, pivots binary"
EXACT = 2.0**52  # squared norms below this: no partial sum of a product of two such vectors leaves the exact doubles
LONG = 2**63 - 1


@dataclass(frozen=True)
class Params:
    """scale: components become floor(scale * x); pivots: chosen farthest-first from a sample of at most `sample`
    rows; query_block: queries that are sent to executors at a time; chunk: rows evaluated between two tests of
    the stopping rule."""

    scale: int = 256
    pivots: int = 16
    sample: int = 1024
    query_block: int = 4096
    chunk: int = 512


def quantised(x: list[float | None] | None, scale: int) -> np.ndarray | None:
    """floor(scale * x) as doubles, which hold it exactly; None for vectors that take no part: null, or with null or
    non-finite components (scale * x beyond the doubles is not finite either)."""
    if x is None or None in x:
        return None
    with np.errstate(over="ignore"):
        v = scale * np.array(x, dtype=np.float64)
    return np.floor(v) if np.isfinite(v).all() else None


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(a.shape[1], b.shape[1])
    return a[:, :n] @ b[:, :n].T


def _norms2(v: np.ndarray) -> np.ndarray:
    return (v * v).sum(axis=1)


def _distances(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(_norms2(v)[:, None] + _norms2(p)[None, :] - 2 * _products(v, p), 0))


def _integers(v: np.ndarray) -> list[int]:
    return [int(x) for x in v]


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    near = _distances(sample, sample[chosen])[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def build(vectors: DataFrame, params: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """The pivot table of vectors (vec_id, embedding): one row for each that takes part."""
    spark = vectors.sparkSession
    ship(spark)
    scale = params.scale
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    drawn = [quantised(r["x"], scale) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(params.sample).collect()]
    pivots = _pivots(_matrix([v for v in drawn if v is not None and v @ v < EXACT]), params.pivots)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, v) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (v := quantised(x, scale)) is not None]
            if got:
                norm2 = np.array([float(v @ v) for _, v in got])
                d = _distances(_matrix([v for _, v in got]), pivots) if len(pivots) else np.zeros((len(got), 0))
                ints = [v.astype("<i4" if n < EXACT else "<f8").tobytes() for (_, v), n in zip(got, norm2, strict=True)]
                cols = [pa.array([i for i, _ in got], pa.int64()), pa.array(ints, pa.binary()), pa.array(norm2), pa.array([x.astype("<f8").tobytes() for x in d], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "ints", "norm2", "pivots"])

    return (scratch or Scratch(spark, "topk")).keep(rows.mapInArrow(index, TABLE), "pivots")


def _columns(b: pa.RecordBatch | list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, list[int]]]:
    """Ids, vectors, squared norms and pivot distances of rows, and the large vectors' integers by row."""
    ids, ints, norm2, piv = (b.column(i).to_pylist() for i in range(4)) if isinstance(b, pa.RecordBatch) else zip(*b, strict=True)
    v = [np.frombuffer(bytes(x), "<i4" if n < EXACT else "<f8").astype(np.float64) for x, n in zip(ints, norm2, strict=True)]
    large = {i: _integers(x) for i, (x, n) in enumerate(zip(v, norm2, strict=True)) if n >= EXACT}
    return np.array(ids, dtype=np.int64), _matrix(v), np.array(norm2), np.frombuffer(b"".join(map(bytes, piv)), "<f8").reshape(len(v), -1), large


Best = tuple[list[int], list[int]]  # scores and ids, best first


def _least(best: Best) -> float:
    """The last score of best as a double; infinite where doubles end before it."""
    last = best[0][-1]
    try:
        return float(last)
    except OverflowError:
        return np.inf if last > 0 else -np.inf


def _merge(best: Best, score: list[int], ids: list[int], k: int) -> Best:
    found = sorted(zip((-x for x in [*best[0], *score]), [*best[1], *ids], strict=True))[:k]
    return [-x for x, _ in found], [i for _, i in found]


def _searched(queries: Broadcast, k: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, q2, qp, q_large = _columns(queries.value)
        best: list[Best] = [([], [])] * len(q_ids)
        for b in batches:
            for at in range(0, len(b), 8192):
                ids, c, c2, cp, c_large = _columns(b.slice(at, 8192))
                width = min(q.shape[1], c.shape[1])
                for first in range(0, len(q_ids), 256):
                    part = slice(first, first + 256)
                    low = np.zeros((len(q_ids[part]), len(ids)))
                    for p in range(cp.shape[1]):
                        np.maximum(low, np.abs(qp[part, p][:, None] - cp[:, p][None, :]), out=low)
                    both = q2[part][:, None] + c2[None, :]
                    # 1 over the true bound at least: rounding must not hide a row
                    bound = (both - low * low) / 2 + 1 + 1e-9 * both
                    bound[np.isnan(bound)] = np.inf  # norms beyond the doubles bound nothing
                    for j in range(len(bound)):
                        i, up = first + j, bound[j]
                        left = np.flatnonzero(ids != q_ids[i])
                        if len(best[i][0]) == k:
                            left = left[up[left] >= _least(best[i])]
                        left = left[np.argsort(-up[left], kind="stable")]
                        for x in range(0, len(left), chunk):
                            if len(best[i][0]) == k and up[left[x]] < _least(best[i]):
                                break
                            now = left[x : x + chunk]
                            if i in q_large or any(n in c_large for n in now.tolist()) if c_large or q_large else False:
                                own = q_large.get(i) or _integers(q[i])
                                score = [sum(map(mul, own, c_large.get(n) or _integers(c[n]))) for n in now.tolist()]
                            else:
                                score = c[now, :width] @ q[i, :width]
                                if len(best[i][0]) == k:
                                    now, score = now[score >= _least(best[i])], score[score >= _least(best[i])]
                                top = np.lexsort((ids[now], -score))[:k]
                                now, score = now[top], [int(s) for s in score[top]]
                            best[i] = _merge(best[i], score, ids[now].tolist(), k)
        rows = [(q, v, s) for q, (score, v_ids) in zip(q_ids.tolist(), best, strict=True) for s, v in zip(score, v_ids, strict=True)]
        if rows:
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([str(r[2]) for r in rows])]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    return run


def search(table: DataFrame, queries: DataFrame, k: int = 5, params: Params = Params(), scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of a pivot table with the highest inner product for each of queries
    (rows of the same table), ties to the smaller vec_id, the query's own vec_id left out.

    A query that repeats an id is answered with the others of it; empty tables give none. A score beyond 64 bits comes
    back as the nearest long; it is ranked by its true value.
    """
    spark = table.sparkSession
    ship(spark)
    scratch, found, held = scratch or Scratch(spark, "topk"), [], []

    def run() -> None:
        sent = spark.sparkContext.broadcast([tuple(r) for r in held])
        found.append(scratch.keep(table.mapInArrow(_searched(sent, k, params.chunk), "query_id long, vec_id long, score string"), "found"))
        sent.unpersist()
        held.clear()

    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) >= params.query_block:
            run()
    if held:
        run()
    if not found:
        found = [table.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.col("vec_id").cast("string").alias("score"))]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    # scores of whole numbers in doubles and longs may need more than 38 digits; those are rare and are told by sign and length
    exact, digits = F.col("score").try_cast("decimal(38,0)"), F.length(F.ltrim("score", F.lit("-")))
    negative = F.startswith("score", F.lit("-"))
    size = F.when(exact.isNotNull(), F.lit(0)).when(negative, -digits).otherwise(digits)
    order = [size.desc(), F.coalesce(exact, F.lit(0)).desc(), F.when(negative, F.col("score")).asc(), F.when(~negative, F.col("score")).desc(), "vec_id"]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    nearest = F.coalesce(F.col("score").try_cast("long"), F.when(negative, F.lit(-LONG - 1)).otherwise(F.lit(LONG)))
    return out.select("query_id", rank.cast("int").alias("rank"), "vec_id", nearest.alias("score")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, params: Params = Params()) -> DataFrame:
    """search() of all rows of vectors (vec_id, embedding) for those whose vec_id is divisible by `every`.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id. Of vectors
    of different lengths the components that both have are multiplied. Rows that repeat a vec_id are one query (the
    first by its numbers) and each a candidate for others. An empty table gives an empty result.
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    table = build(vectors, params, scratch)
    queries = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("ints", "norm2", "pivots")).alias("x")).select("vec_id", "x.*")
    return search(table, queries, k, params, scratch)
