"""Exact nearest neighbours by Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import written

#: About how many query vectors one pass of ``knn_batch`` takes.
BLOCK_QUERIES = 4096
#: Queries of one matrix product.
SLICE = 256


def l2(vector: Column, query: list[float]) -> Column:
    """Distance in double precision, as a native expression."""
    other = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector.cast("array<double>"), other, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def knn(embeddings: DataFrame, query: list[float], k: int, scope: Column | None = None) -> DataFrame:
    """The ``k`` nearest of the rows in scope; ties by ``chunk_id``. The scope is applied first."""
    rows = embeddings if scope is None else embeddings.where(scope)
    return rows.select("chunk_id", l2(F.col("embedding"), query).alias("distance")).orderBy("distance", "chunk_id").limit(k)


def scoped(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Embeddings of the chunks given."""
    return embeddings.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


class _Best:
    """The ``k`` nearest rows of each query of a block so far; equal distances keep the least keys."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.squares = (queries * queries).sum(axis=1)
        self.reach = np.full(len(queries), np.inf)
        self.held = pd.DataFrame({"q": np.zeros(0, np.int64), "distance": np.zeros(0), "chunk_id": []})

    def far(self, x: np.ndarray) -> np.ndarray:
        """Queries that no row of ``x`` can serve: by the triangle, none is nearer than the way to their centre less their radius."""
        centre = x.mean(axis=0)
        radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max())
        way = np.sqrt(((self.queries - centre) ** 2).sum(axis=1))
        slack = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (way + radius)
        return way - radius - slack > self.reach

    def add(self, x: np.ndarray, keys: np.ndarray) -> int:
        """Gives the number of queries that were spared."""
        near = np.flatnonzero(~self.far(x))
        squares, found = (x * x).sum(axis=1), []
        for lo in range(0, len(near), SLICE):
            at = near[lo : lo + SLICE]
            q, own = self.queries[at], self.squares[at]
            square = np.maximum(0, squares[None, :] + own[:, None] - 2 * q @ x.T)
            # Products and differences round to within a part of ``unit``: what may be among the k nearest is within two such errors.
            unit = 4 * (x.shape[1] + 4) * np.finfo(np.float64).eps * (np.sqrt(squares.max()) + np.sqrt(own)) ** 2
            least = np.partition(square, min(self.k, len(keys)) - 1, axis=1)[:, min(self.k, len(keys)) - 1]
            kept_q, kept_x = np.nonzero(~(square > np.minimum(least + 2 * unit, self.reach[at] ** 2 * (1 + 1e-9) + 2 * unit)[:, None]))
            exact = np.sqrt(((x[kept_x] - q[kept_q]) ** 2).sum(axis=1))
            found.append(pd.DataFrame({"q": at[kept_q], "distance": exact, "chunk_id": keys[kept_x]}))
        if found:
            both = pd.concat([self.held, *found], ignore_index=True) if len(self.held) else pd.concat(found, ignore_index=True)
            self.held = both.sort_values(["q", "distance", "chunk_id"], kind="stable").groupby("q", sort=False).head(self.k)
            last = self.held.groupby("q").agg(n=("distance", "size"), d=("distance", "max"))
            full = last.index[last["n"] == self.k]
            self.reach[full] = last.loc[full, "d"]
        return len(self.queries) - len(near)


def _searched(ids: np.ndarray, queries: np.ndarray, k: int, spared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(queries, k)
        for pdf in batches:
            if len(pdf):
                n = best.add(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["chunk_id"].to_numpy())
                if spared is not None:
                    spared.add(n)
        held = best.held
        yield pd.DataFrame({"query_id": ids[held["q"].to_numpy(np.int64)], "chunk_id": held["chunk_id"], "distance": held["distance"]})

    return run


def by_pivots(embeddings: DataFrame, pivots: int = 64) -> DataFrame:
    """``embeddings`` stored so that near vectors lie together: by the nearest of some of them, and by the way to it.

    The pivots are those of the least hashes, a bounded number; they decide no result. A pivot that many rows
    are nearest to spans many ranges of its distance. Batches read from such a table are small in
    space, so ``knn_batch`` spares most of them most queries.
    """
    chosen = embeddings.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(pivots).select("embedding").collect()
    if not chosen:
        return embeddings
    nearest = F.array_min(F.array(*[F.struct(l2(F.col("embedding"), r.embedding).alias("d"), F.lit(i).alias("p")) for i, r in enumerate(chosen)]))
    laid = embeddings.withColumn("_near", nearest).repartitionByRange("_near.p", "_near.d").sortWithinPartitions("_near.p", "_near.d").drop("_near")
    return written(laid)


def knn_batch(embeddings: DataFrame, queries: DataFrame, k: int, spared=None) -> DataFrame:
    """The ``k`` nearest rows of each query: ``query_id, chunk_id, distance, rank``.

    ``queries`` (``query_id, embedding``) are taken in blocks of bounded size, each in one pass over the rows
    where they lie: no vector is shuffled. A task keeps each query's nearest so far, and a batch of rows spares
    the queries for which all of it is too far. Tasks send on ``k`` rows a query. ``spared``, an accumulator,
    counts pairs of query and batch that were spared.
    """
    blocks = -(-queries.count() // BLOCK_QUERIES)
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {embeddings.schema['chunk_id'].dataType.simpleString()}, distance double"
    spark, rows, found = embeddings.sparkSession, embeddings.select("chunk_id", "embedding"), None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "embedding").collect()
        if own:
            ids, held = np.array([r.query_id for r in own]), np.array([r.embedding for r in own], np.float64)
            part = rows.mapInPandas(_searched(ids, held, k, spared), kind)
            # Of many blocks each is done before the next one's queries come to the driver.
            part = part if blocks == 1 else written(part)
            found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], kind + ", rank int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
