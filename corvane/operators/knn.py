"""Exact nearest neighbours in blocks, the graph they make, and its modularity."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import edge_weight

BLOCK_ROWS = 20_000
DIGITS = 9  # distances are rounded before they are ranked, so that ties do not hang on the order of a sum
QUERIES_AT_ONCE, BASE_AT_ONCE = 256, 4_096  # sides of the tile of distances that a task holds
CANDIDATES_AT_ONCE = 1 << 14


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _exact(q: np.ndarray, b: np.ndarray, at: np.ndarray, of: np.ndarray, metric: str) -> np.ndarray:
    out = np.empty(len(at))
    for i in range(0, len(at), CANDIDATES_AT_ONCE):
        x, y = q[at[i : i + CANDIDATES_AT_ONCE]], b[of[i : i + CANDIDATES_AT_ONCE]]
        out[i : i + CANDIDATES_AT_ONCE] = 1 - np.einsum("ij,ij->i", x, y) if metric == "cosine" else np.sqrt(((x - y) ** 2).sum(1))
    return np.round(out, DIGITS)


def _nearest(k: int, metric: str):
    """The k nearest of a base block for each row of a query block. A tile of distances in single precision finds candidates, with room for its error; their distances are then made in double."""

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and base.num_rows:
            keys, ids, q, b = queries.column("id").to_numpy(), base.column("base_id").to_numpy(), _matrix(queries.column("v")), _matrix(base.column("base_v"))
            if metric == "cosine":
                for x in (q, b):
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            small_q, small_b = q.astype(np.float32), b.astype(np.float32)
            qq, bb = (np.einsum("ij,ij->i", x, x) for x in (small_q, small_b))
            room = 2e-7 * (q.shape[1] + 8) * (1.0 if metric == "cosine" else 2 * float(qq.max() + bb.max())) + 10.0**-DIGITS
            for i in range(0, len(q), QUERIES_AT_ONCE):
                tile = slice(i, i + QUERIES_AT_ONCE)
                n = len(keys[tile])
                near, place = np.full((n, k), np.inf), np.full((n, k), -1)
                for j in range(0, len(b), BASE_AT_ONCE):
                    d = small_q[tile] @ small_b[j : j + BASE_AT_ONCE].T
                    if metric == "cosine":
                        np.subtract(1, d, out=d)
                    else:
                        d *= -2
                        d += qq[tile, None]
                        d += bb[None, j : j + BASE_AT_ONCE]
                    bound = near[:, -1] if metric == "cosine" else near[:, -1] ** 2
                    if not np.isfinite(bound).all() and d.shape[1] > k + 1:  # the row itself may be among them
                        bound = np.minimum(bound, np.partition(d, k, axis=1)[:, k] + room)
                    at, of = np.nonzero(d <= (bound + room)[:, None])
                    of += j
                    other = keys[tile][at] != ids[of]
                    at, of = at[other], of[other]
                    if not len(at):
                        continue
                    row = np.concatenate((np.repeat(np.arange(n), k), at))
                    column = np.concatenate((place.ravel(), of))
                    value = np.concatenate((near.ravel(), _exact(q[tile], b, at, of, metric)))
                    order = np.lexsort((ids[column], value, row))  # ties go to the lower id
                    row, column, value = row[order], column[order], value[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
                    best = rank < k
                    near, place = value[best].reshape(n, k), column[best].reshape(n, k)
                at, rank = np.nonzero(np.isfinite(near))
                found.append((keys[tile][at], ids[place[at, rank]], near[at, rank]))
        key, neighbour, distance = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"id": pa.array(key, pa.int64()), "neighbour": pa.array(neighbour, pa.int64()), "distance": pa.array(distance, pa.float64())})

    return run


def knn(vectors: DataFrame, k: int, metric: str = "cosine", queries: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, distance, rank) of each query's k nearest other rows; ties go to the lower id.

    Rows are dealt to blocks of about ``block_rows`` by a digest of their id; each pair of a query block and a base
    block is one task's matrix product, in tiles, whose best k go on. A task holds two blocks as numbers and one tile, whatever the size of the table.
    ``vectors`` and ``queries`` have id and v.
    """
    queries = vectors if queries is None else queries
    blocks = max(1, ceil(vectors.count() / block_rows))
    query_blocks = max(blocks, int(vectors.sparkSession.sparkContext.defaultParallelism))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select(F.col("id").cast("long").alias("id"), "v", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).alias("q"), numbers(blocks).alias("b"))
    right = vectors.select(F.col("id").cast("long").alias("base_id"), F.col("v").alias("base_v"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), numbers(query_blocks).alias("q"))
    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(_nearest(k, metric), "id long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def edges(neighbours: DataFrame, metric: str = "cosine") -> DataFrame:
    """Undirected graph (src < dst, weight): a pair that is found twice gets its mean weight."""
    ends = F.least("id", "neighbour").alias("src"), F.greatest("id", "neighbour").alias("dst")
    return neighbours.where("id <> neighbour").select(*ends, edge_weight(F.col("distance"), metric).alias("w")).groupBy("src", "dst").agg(F.avg("w").alias("weight"))


def modularity(graph: DataFrame, partition: DataFrame, label: str = "cluster") -> DataFrame:
    """One row: weighted modularity at resolution 1; ``partition`` has id and the label."""
    of = lambda end: partition.select(F.col("id").alias(end), F.col(label).alias(f"c_{end}"))
    e = graph.join(of("src"), "src").join(of("dst"), "dst")
    ends = e.select(F.explode(F.array(F.struct(F.col("c_src").alias("c"), "weight", F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0).alias("inside")), F.struct(F.col("c_dst").alias("c"), "weight", F.lit(0.0).alias("inside")))).alias("x")).select("x.*")
    per = ends.groupBy("c").agg(F.sum("weight").alias("degree"), F.sum("inside").alias("inside"))
    total = graph.agg(F.sum("weight").alias("total"))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("total") - F.pow(F.col("degree") / (2 * F.col("total")), 2)).alias("modularity"))
