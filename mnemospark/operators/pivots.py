"""Vectors in cells around pivots, for exact searches that pass over far cells.

Pivots are fitted on a bounded sample by k-means; every vector goes to the cell of its
nearest pivot and keeps its distance to it, its reach. By the triangle inequality a
query at distance d of a pivot is at least d - r from every vector of reach r or less
and r - d from every vector of reach r or more, so a stretch of a cell whose bound
passes what a query still needs is not compared with it. Nothing else is left out.
Shorter vectors count as filled up with zeros; null vectors have no place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.search import in_blocks
from mnemospark.session import materialize

CELLS, SAMPLE = 64, 4096
#: Rows of a cell, by reach, that are compared or passed over together.
STRETCH = 256


def as_matrix(lists: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of doubles, of at least ``width`` columns; shorter rows end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return np.nan_to_num(out)


def same_width(*matrices: np.ndarray) -> list[np.ndarray]:
    width = max(m.shape[1] for m in matrices)
    return [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances, to within a rounding error of the squares' sum."""
    a, b = same_width(a, b)
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def fit_pivots(rows: DataFrame, vector: str, cells: int = CELLS, sample: int = SAMPLE, turns: int = 6) -> np.ndarray:
    """Pivots from ``sample`` vectors at most, chosen by the hash of their values; none for an empty table."""
    some = rows.where(F.col(vector).isNotNull()).select(F.col(vector).alias("v")).orderBy(F.xxhash64("v")).limit(sample)
    points = as_matrix(some.toArrow().column("v"))
    pivots = points[np.linspace(0, len(points) - 1, min(cells, len(points))).astype(int)] if len(points) else points
    for _ in range(turns if len(pivots) else 0):
        own = distances(points, pivots).argmin(axis=1)
        sums, counts = np.zeros_like(pivots), np.bincount(own, minlength=len(pivots))
        np.add.at(sums, own, points)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return pivots


def assigned(rows: DataFrame, key: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(key, vector, cell, reach) of every vector, in order of cell and reach within evenly dealt partitions."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = distances(as_matrix(batch.column("vector")), pivots)
                cell = gap.argmin(axis=1)
                reach = gap[np.arange(len(cell)), cell]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(reach)], ["key", "vector", "cell", "reach"])

    own = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = own.mapInArrow(run, f"key {kind}, vector array<double>, cell int, reach double")
    return placed.repartitionByRange(parts, "cell", "reach").sortWithinPartitions("cell", "reach")


class Nearest:
    """Queries and the least distances found for them so far."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, k: int, first: int) -> None:
        self.vectors, self.k = vectors, k
        self.gap = distances(vectors, pivots)
        self.near = np.zeros(self.gap.shape, bool)
        best = np.argsort(self.gap, axis=1)[:, :first]
        self.near[np.arange(len(vectors))[:, None], best] = True
        self.limit = np.full(len(vectors), np.inf)

    def step(self, limit: np.ndarray, held: np.ndarray, vectors: np.ndarray, cells: np.ndarray, reaches: np.ndarray, seeds: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """From rows sorted by cell and reach: the queries and row numbers whose distance may count, and how many were compared.

        ``seeds``: each query in its first cells alone; else in all others. ``limit`` and
        ``held``, the least distances so far, are brought up to date.
        """
        cut = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        for low, high in zip([0, *cut.tolist()], [*cut.tolist(), len(cells)], strict=True):
            for start in range(low, high, STRETCH):
                stop = min(start + STRETCH, high)
                gap = self.gap[:, cells[start]]
                bound = np.maximum(gap - reaches[start:stop].max(), reaches[start:stop].min() - gap)
                asked = np.flatnonzero((self.near[:, cells[start]] == seeds) & (bound * (1 - 1e-9) - 1e-6 <= limit))
                if not len(asked):
                    continue
                found = distances(self.vectors[asked], vectors[start:stop])
                query, row = np.nonzero(found <= limit[asked][:, None] + 1e-6)
                held[asked] = np.sort(np.concatenate([held[asked], found], axis=1), axis=1)[:, : self.k]
                limit[asked] = np.minimum(limit[asked], held[asked, -1])
                yield asked[query], start + row, len(asked) * (stop - start)


def nearest(queries: DataFrame, rows: DataFrame, k: int, query: str = "query_id", wanted: str = "query_vector", key: str = "vec_id", vector: str = "embedding", cells: int = CELLS, block_rows: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest other rows of each query, as (query, key, distance, rank), and what it took, as (block, compared, rows).

    The distances to a query's four nearest cells come first and give the limit for
    all other cells. Queries go in blocks of ``block_rows`` rows, each broadcast. Of
    equal distances the smaller key is nearer; a row is no neighbour of its own key.
    """
    spark = rows.sparkSession
    kind, query_kind = dict(rows.dtypes)[key], dict(queries.dtypes)[query]
    pivots = fit_pivots(rows, vector, cells)
    schema = f"query {query_kind}, key {kind}, distance double, compared bigint"
    table = materialize(assigned(rows, key, vector, pivots), "cells") if len(pivots) else None
    found, took, names = None, [], ["query", "key", "distance", "compared"]
    total = table.count() if table is not None else 0
    for number, block in enumerate(in_blocks(queries.where(F.col(wanted).isNotNull()).select(F.col(query).alias("query"), F.col(wanted).cast("array<double>").alias("wanted")), block_rows)):
        own = block.toArrow()
        if not total or not own.num_rows:
            continue
        ids = own.column("query").combine_chunks()
        state = Nearest(as_matrix(own.column("wanted")), pivots, k + 1, 4)  # one more, as a query may meet itself

        def compared(state: Nearest, seeds: bool, ids: pa.Array = ids) -> DataFrame:
            sent = spark.sparkContext.broadcast((state, ids))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                state, ids = sent.value
                keys_none = None
                limit, held, asked = state.limit.copy(), np.full((len(state.limit), state.k), np.inf), 0
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    vectors, keys = as_matrix(batch.column("vector")), batch.column("key")
                    keys_none = pa.nulls(1, keys.type)
                    for q, row, n in state.step(limit, held, vectors, batch.column("cell").to_numpy(), batch.column("reach").to_numpy(), seeds):
                        asked += n
                        a, b = same_width(state.vectors[q], vectors[row])
                        exact = np.sqrt(((a - b) ** 2).sum(axis=1))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q, pa.int64())), keys.take(pa.array(row, pa.int64())), pa.array(exact), pa.nulls(len(q), pa.int64())], names)
                if keys_none is not None:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, ids.type), keys_none, pa.nulls(1, pa.float64()), pa.array([asked], pa.int64())], names)

            return table.mapInArrow(run, schema)

        first = materialize(compared(state, True), "nearest")
        order = Window.partitionBy("query").orderBy("distance", "key")
        limits = first.where("query IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k + 1).select("query", "distance").toArrow()
        place = {q: i for i, q in enumerate(ids.to_pylist())}
        for q, d in zip(limits.column("query").to_pylist(), limits.column("distance").to_pylist(), strict=True):
            state.limit[place[q]] = d
        both = materialize(first.unionByName(compared(state, False)), "nearest")
        best = both.where(F.col("query") != F.col("key")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = best if found is None else found.unionByName(best)
        took.append((number, both.agg(F.sum("compared")).first()[0] or 0, total * own.num_rows))
    if found is None:
        found = spark.createDataFrame([], f"{schema}, rank int")
    named = found.select(F.col("query").alias(query), F.col("key").alias(key), "distance", "rank")
    return named, spark.createDataFrame(took, "block bigint, compared bigint, rows bigint")
