"""Approximate nearest neighbours with randomly rotated one-bit codes.

A vector, less a centre, is turned by a random rotation; the signs of its components are its code, one bit each, kept with
two correction scalars: the length of the residual and the code's inner product with the residual's direction. From code
and scalars a query estimates the distance and a bound of the estimate's error. In each pair of a block of vectors and a
block of queries the vectors whose lower bound is below the tenth exact distance so far are reranked with the original vectors.

Every vector is indexed; only the centre is fitted, on a bounded sample (``SAMPLE`` vectors). Blocks have bounded sizes on
both sides. The search is of all queries against all vectors, which is what the stated query set asks for.

Cases: vectors that are null or zero or hold null or non-finite components take no part, nor do null ids; vectors of different
lengths are searched apart; rows with the query's id are not its candidates; equal vectors are ordered by id; fewer
candidates give fewer rows; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = 10_000
BLOCK = 8192
QUERIES = 1024
#: Width of the error bound in standard deviations of an estimate.
WIDTH = 2.5


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vector (doubles), dim of the rows that take part."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        .where("vec_id is not null and vector is not null")
        .where(F.forall("vector", good) & F.exists("vector", lambda x: x != 0))
        .withColumn("dim", F.size("vector"))
    )


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector of each length, from the sample."""
    rows = vectors.select("dim", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    groups: dict[int, list] = {}
    for r in rows:
        groups.setdefault(r["dim"], []).append(r["vector"])
    return {d: np.mean(np.array(v), axis=0) for d, v in groups.items()}


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten() if isinstance(lists, pa.Array) else pa.concat_arrays([c.flatten() for c in lists.chunks])
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def index(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, dim, code (packed bits), length and align (the correction scalars) of every usable vector."""
    middle = vectors.sparkSession.sparkContext.broadcast(centres(vectors))

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
                residual = _matrix(pa.chunked_array([rows.column("vector")]), dim) - middle.value.get(dim, 0.0)
                length = np.linalg.norm(residual, axis=1)
                turned = residual / np.where(length > 0, length, 1)[:, None] @ rotation(dim).T
                bits = np.packbits(turned > 0, axis=1)
                align = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("vec_id"),
                        rows.column("vector"),
                        rows.column("dim"),
                        pa.array([b.tobytes() for b in bits], pa.binary()),
                        pa.array(length),
                        pa.array(align),
                    ],
                    names=["vec_id", "vector", "dim", "code", "length", "align"],
                )

    return vectors.mapInArrow(run, "vec_id long, vector array<double>, dim int, code binary, length double, align double")


def _nearest(ids: np.ndarray, distance: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest of each query, nearest first, ties to the smaller id."""
    order = np.lexsort((ids, distance, query))
    starts = np.flatnonzero(np.diff(query[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def search_block(
    ids: np.ndarray, data: np.ndarray, codes: np.ndarray, length: np.ndarray, align: np.ndarray,
    query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, distance) of the nearest found in a block."""
    dim = data.shape[1]
    residual = queries - centre
    size = np.linalg.norm(residual, axis=1)
    turned = residual / np.where(size > 0, size, 1)[:, None] @ rotation(dim).T
    signs = np.unpackbits(codes, axis=1)[:, :dim].astype(np.float32) * 2 - 1
    safe = np.where(align > 0, align, 1)
    product = (turned.astype(np.float32) @ signs.T).astype(float) / math.sqrt(dim) / safe
    error = WIDTH * np.sqrt(np.maximum(0, 1 - safe**2)) / safe / math.sqrt(max(1, dim - 1))
    scale = 2 * size[:, None] * length
    estimate = size[:, None] ** 2 + length**2 - scale * product
    lower = estimate - scale * error
    own = query_ids[:, None] == ids
    estimate[own] = lower[own] = np.inf
    exact = lambda q, v: np.sqrt(((data[v] - queries[q]) ** 2).sum(axis=1))
    some = min(k, len(ids))
    first = np.argpartition(estimate, some - 1, axis=1)[:, :some]
    q = np.repeat(np.arange(len(queries)), some)
    reached = np.where(own[q, first.ravel()], np.inf, exact(q, first.ravel())).reshape(-1, some).max(axis=1)
    out = []
    for a in range(0, len(queries), 64):  # survivors of some queries at a time
        q, v = np.nonzero((lower[a : a + 64] <= (reached[a : a + 64] ** 2 * (1 + 1e-9))[:, None]) & ~own[a : a + 64])
        q += a
        d = exact(q, v)
        best = _nearest(ids[v], d, q, k)
        out.append((q[best], v[best], d[best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by Euclidean distance."""
    rows = index(usable(vectors))
    sizes = usable(vectors).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, parts = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // query_block))
    middle = vectors.sparkSession.sparkContext.broadcast(centres(usable(vectors)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"block": F.pmod(F.xxhash64("vec_id", "code"), F.lit(blocks)).cast("int"), "part": every(parts)})
    asked = usable(vectors).where(is_query)
    right = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).withColumn("block", every(blocks))

    def run(some: pa.Table, queries: pa.Table) -> pa.Table:
        names = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not some.num_rows or not queries.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names.items()})
        dim = some.column("dim")[0].as_py()
        number = lambda t, c: t.column(c).to_numpy()
        codes = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint8).reshape(some.num_rows, -1)
        ids, query_ids = number(some, "vec_id"), number(queries, "vec_id")
        q, v, d = search_block(
            ids, _matrix(some.column("vector"), dim), codes, number(some, "length"), number(some, "align"),
            query_ids, _matrix(queries.column("vector"), dim), middle.value.get(dim, np.zeros(dim)), k,
        )
        return pa.table({"query_id": query_ids[q], "vec_id": ids[v], "score": d})

    keys = ["dim", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")
    # each block sends k rows a query; Spark keeps the first k of each partition before the shuffle
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
