"""Exact top-k inner products: branch and bound over blocks of dimensions, vectors stored vertically."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nidalytics.plans.stages import cut

#: Queries in a block; a block is broadcast, each one is a pass over the vectors.
QUERY_BLOCK = 8192
#: Components in a tile of vectors and in a tile of queries.
TILE_VALUES = 1 << 18
#: Dimensions that are accumulated before candidates are judged again.
DIMENSIONS = 16
#: Of so many vectors of the query block the first threshold is taken.
SEEDS = 512
EXACT = 1 << 53


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as a double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor with a component that is null, infinite or not a number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def vertical(lists: pa.ListArray) -> np.ndarray:
    """A row per dimension, a column per vector; short vectors are zero beyond their end."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy()
    width = int(sizes.max(initial=0))
    if flat.size == width * len(sizes):
        return np.ascontiguousarray(flat.reshape(len(sizes), width).T)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return np.ascontiguousarray(out.T)


def resized(columns: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` dimensions, with zeros for those that are missing."""
    if columns.shape[0] >= width:
        return columns[:width]
    return np.concatenate([columns, np.zeros((width - columns.shape[0], columns.shape[1]), columns.dtype)])


def remaining_mass(columns: np.ndarray) -> np.ndarray:
    """Norm of what follows each block of dimensions, a row per block, rounded up."""
    starts = range(DIMENSIONS, max(1, columns.shape[0]) + DIMENSIONS, DIMENSIONS)
    if columns.dtype == object:  # no bound without exact floats: nothing is abandoned
        return np.full((len(starts), columns.shape[1]), np.inf)
    squares = columns**2
    return np.sqrt(np.stack([squares[s:].sum(axis=0) for s in starts])) * (1 + 1e-9)


class Best:
    """The k best candidates of each query so far: scores, ids (null last among equals) and row numbers."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.least = k, least
        self.rows = [(np.zeros(0, object), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))] * n

    def add(self, q: int, score: np.ndarray, null: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        joined = [np.concatenate(x) for x in zip(self.rows[q], (score, null, ids, rows), strict=True)]
        order = np.lexsort((joined[3], joined[2], joined[1], -joined[0]))[: self.k]
        self.rows[q] = tuple(x[order] for x in joined)
        if order.size == self.k:
            self.least[q] = max(self.least[q], joined[0][order[-1]])


def search_tile(queries: np.ndarray, query_mass: np.ndarray, query_rows: np.ndarray, tile: np.ndarray, ids, null, rows, best: Best, first: int) -> None:
    """Offer the vectors of a tile to a tile of queries (both vertical, equal dimensions).

    The first block of dimensions is one product for all pairs. Then the pairs whose sum so far plus the
    product of the norms that remain (Cauchy-Schwarz) cannot reach the query's k-th best score go; of the
    rest each query keeps a compact list, which shrinks from block to block.
    """
    mass = remaining_mass(tile)
    sums = queries[:DIMENSIONS].T @ tile[:DIMENSIONS]
    for q in range(queries.shape[1]):
        least = best.least[first + q]
        alive = np.flatnonzero(sums[q] + (query_mass[0, q] * mass[0] + 1) >= least)
        alive = alive[rows[alive] != query_rows[q]]
        score = sums[q, alive]
        for block in range(1, mass.shape[0]):
            if not alive.size:
                break
            dims = slice(block * DIMENSIONS, (block + 1) * DIMENSIONS)
            score = score + queries[dims, q] @ tile[dims, alive]
            hopeful = score + (query_mass[block, q] * mass[block, alive] + 1) >= least
            alive, score = alive[hopeful], score[hopeful]
        if alive.size:
            best.add(first + q, score, null[alive], ids[alive], rows[alive])


def _found(block: Broadcast, k: int):
    """mapInArrow: (row, id, vector) to (query row, id, row, score), k for each query and task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_rows, query_ids, query_null, vectors = block.value  # vectors: dimensions x queries
        order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=1), kind="stable")  # heavy dimensions first
        top = int(np.abs(vectors).max(initial=0))
        n, width = vectors.shape[1], max(1, vectors.shape[0])
        best: Best | None = None
        forms: dict[type, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            lists = batch.column("vector")
            step = max(1, TILE_VALUES // max(1, int(lists.value_lengths().to_numpy(zero_copy_only=False).max())))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                tile = resized(vertical(part.column("vector")), vectors.shape[0])[order]
                # float64 is exact up to 2^53; beyond, Python's integers are
                kind = np.float64 if top * int(np.abs(tile).max(initial=0)) * width < EXACT and top * top * width < EXACT else object
                tile = tile.astype(kind)
                if kind not in forms:
                    whole = vectors[order].astype(kind)
                    forms[kind] = whole, remaining_mass(whole)
                whole, mass = forms[kind]
                if best is None:
                    best = Best(n, k, seeds(whole, k))
                ids = part.column("id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                numbers, rows = ids.fill_null(0).to_numpy(), part.column("row").to_numpy()
                across = max(1, TILE_VALUES * 4 // max(1, tile.shape[1]))
                for first in range(0, n, across):
                    some = slice(first, first + across)
                    search_tile(whole[:, some], mass[:, some], query_rows[some], tile, numbers, null, rows, best, first)
        for q, (score, null, ids, rows) in enumerate(best.rows if best else []):
            if len(score):
                who = [np.full(len(score), x[q]) for x in (query_rows, query_ids, query_null)]
                columns = [who[0], pa.array(who[1], mask=who[2]), pa.array(ids, mask=null), rows, pa.array([int(s) for s in score], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_row", "query_id", "vec_id", "row", "score"])

    return run


def seeds(queries: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches for sure: its k-th best among a few other queries.

    The queries are vectors too, so what they offer is a bound from below; the own row is left out.
    """
    n = queries.shape[1]
    few = queries[:, :SEEDS]
    least = np.full(n, -np.inf)
    if few.shape[1] <= k or queries.dtype == object:
        return least
    for first in range(0, n, 1024):
        mine = queries[:, first : first + 1024]
        scores = mine.T @ few
        own = np.arange(first, first + mine.shape[1])
        inside = own < few.shape[1]
        scores[np.flatnonzero(inside), own[inside]] = -np.inf
        least[first : first + mine.shape[1]] = np.sort(scores, axis=1)[:, -k]
    return least


def top_inner_products(
    table: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For every row that ``is_query``: the k other rows with the largest integer inner product.

    Columns: query_id, rank (from 1), vec_id, score. Components become floor(scale * x). Rows are told apart
    by a row number, so of repeated rows (also with equal ids) each is a query and a candidate of its own,
    and only the row itself is left out; among equal scores the smaller id ranks first, null last. Vectors that
    are null or hold null or non-finite components take no part. Vectors may differ in length: a missing
    component counts as zero. Integers beyond 64 bits are taken at that limit. A row whose ``is_query`` is null is no query. A score beyond 64 bits is an error.
    An empty table, or one without queries, gives no rows.

    The integer vectors are written once. Queries are dealt evenly into blocks of about ``query_block``; each
    block is broadcast and compared with all rows in one pass, without a shuffle of the rows. A task hands on at most k
    rows per query, and only those that reach the k-th best score among a few vectors of the block.
    """
    spark = table.sparkSession
    vector = F.col(vector_column)
    rows = table.where(usable(vector)).select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), integer_vector(vector, scale).alias("vector")
    )
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    asking = rows.where("asks").select("row", "vector", "id")
    n = asking.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-n // query_block)
    queries = cut(asking.repartition(blocks).withColumn("block", F.spark_partition_id()), by="block")
    best = []
    for b in range(blocks):
        mine = queries.where(F.col("block") == b).select("row", "id", "vector").toArrow()
        if not mine.num_rows:
            continue
        vectors = vertical(mine.column("vector").combine_chunks())
        ids = mine.column("id").combine_chunks()
        block = spark.sparkContext.broadcast((mine.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), vectors))
        found = rows.select("row", "id", "vector").mapInArrow(_found(block, k), "query_row long, query_id long, vec_id long, row long, score long")
        by = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        best.append(cut(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)))
        block.unpersist()
    out = best[0]
    for more in best[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "vec_id", "score")
