"""Hybrid retrieval: candidates of both indexes joined, fused by reciprocal rank, and laid out in pages."""

from __future__ import annotations

import base64
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..model import Tuning
from .catalog import LOCALE
from .textindex import bm25_scan
from .vector import knn

MODES = ("vector-only", "fts-only", "hybrid-no-path", "hybrid")


def ranked(hits: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Ranks from 1 of a list that a top-k has made small."""
    return hits.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def candidate_union(lists: list[DataFrame], key: str = "chunk_id") -> DataFrame:
    """The ids of all candidate lists, each once."""
    return reduce(DataFrame.unionByName, [x.select(key) for x in lists]).distinct()


def fuse(vec: DataFrame, fts: DataFrame, fetch: int, tuning: Tuning) -> DataFrame:
    """The full outer join of both candidate lists and their reciprocal-rank score."""
    missing = F.lit(fetch + 1)
    joined = vec.join(fts, "chunk_id", "full")
    rrf = 1 / (tuning.rrf_k + F.coalesce("v_rank", missing)) + 1 / (tuning.rrf_k + F.coalesce("f_rank", missing))
    return joined.withColumn("rrf", rrf)


def final_score(mode: str, tuning: Tuning) -> Column:
    """Null where the mode yields no score."""
    return {
        "vector-only": -F.col("distance"),
        "fts-only": F.col("bm25"),
        "hybrid-no-path": F.col("rrf"),
        "hybrid": F.col("rrf") + tuning.path_weight * F.col("path_score"),
    }[mode]


def search(
    chunks: DataFrame,
    embeddings: DataFrame,
    query: str,
    vector: list[float],
    top_k: int = 10,
    mode: str = "hybrid",
    tuning: Tuning | None = None,
    scope: Column | None = None,
    stemmed: bool = False,
    text: DataFrame | None = None,
    by_id: bool = False,
) -> DataFrame:
    """The best ``top_k`` chunks, with ``distance`` (the negated score), ranks and diagnostics.

    ``text`` has the keyword hits (``chunk_id, bm25``) of a stored index; without it the chunks are
    scanned. With ``by_id`` the candidates come to the driver, at most twice ``top_k`` times the over-fetch, and their
    ids reach the scan of the chunks, whose files or buckets can then be passed over. Ids are fused first; paths and text join last, on a list of a few times ``top_k`` rows. Vectors
    whose chunk is gone are dropped there, though they held a place among the candidates.
    """
    tuning = tuning or Tuning()
    fetch = top_k * tuning.over_fetch
    near = embeddings if scope is None else embeddings.join(chunks.where(scope).select("chunk_id"), "chunk_id", "left_semi")
    vec = ranked(knn(near, vector, fetch), [F.col("distance"), F.col("chunk_id")], "v_rank")
    if text is None:
        text = bm25_scan(chunks, query, "chunk_id", tuning.fts_path_weight, tuning.fts_content_weight, scope, stemmed)
    fts = ranked(text.orderBy(F.desc("bm25"), "chunk_id").limit(fetch), [F.desc("bm25"), F.col("chunk_id")], "f_rank")
    candidates = fuse(vec, fts, fetch, tuning)
    if by_id:
        held = candidates.collect()
        candidates = chunks.sparkSession.createDataFrame(held, candidates.schema)
        chunks = chunks.where(F.col("chunk_id").isin([r.chunk_id for r in held]))
    candidates = F.broadcast(candidates)  # at most 2 * fetch rows
    hydrated = chunks.join(candidates, "chunk_id").withColumn("path_score", X.path_relevance(query, F.col("file_path")))
    scored = hydrated.withColumn("score", final_score(mode, tuning)).where("score IS NOT NULL")
    far = F.lit(1 << 30)
    return (
        scored.withColumn("out_distance", -F.col("score"))
        .orderBy("out_distance", F.coalesce("v_rank", far), F.coalesce("f_rank", far))
        .limit(top_k)
        .withColumn(
            "diagnostics",
            F.struct("v_rank", "f_rank", F.col("distance").alias("v_distance"), "bm25", "rrf", "path_score", F.lit(fetch + 1).alias("missing_rank")),
        )
        .drop("distance")
        .withColumnRenamed("out_distance", "distance")
    )


def payload_order(order: str = "best_first") -> list[Column]:
    """``reference`` puts the largest distance, the lowest score, first; ``best_first`` the smallest. Paths and ids are in locale order."""
    first = F.desc("distance") if order == "reference" else F.asc("distance")
    text = lambda c: F.collate(F.col(c).cast("string"), LOCALE)
    return [first, text("file_path"), F.col("start_line"), F.col("end_line"), text("chunk_id")]


def diverse(results: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first result of each file in order, then the others in order; ``position`` from 1."""
    within = Window.partitionBy(*keys, "data_source_id", "file_path").orderBy(*order)
    nth = results.withColumn("_again", (F.row_number().over(within) > 1).cast("int"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_again", *order)
    return nth.withColumn("position", F.row_number().over(across)).withColumn("repeat", F.col("_again") == 1).drop("_again")


def files_ranked(results: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per file, ranked anew."""
    return diverse(results, keys, order).where("NOT repeat").withColumnRenamed("position", "file_rank").drop("repeat")


def page_size(asked: float | None, default: int = 5, most: int = 25) -> int:
    """T08"""
    if asked is None or not math.isfinite(asked):
        return default
    return max(1, min(most, math.floor(asked)))


def fetch_size(top_k: int, offset: int, size: int) -> int:
    """T09"""
    return max(top_k, offset + size + max(size, 5))


def payload(results: DataFrame, sources: DataFrame, offset: int = 0, size: int = 5, order: str = "best_first") -> DataFrame:
    """One page as rows, and whether more follow."""
    laid = diverse(results, [], payload_order(order))
    page = laid.where((F.col("position") > offset) & (F.col("position") <= offset + size + 1))
    more = page.agg((F.max("position") > offset + size).alias("has_more"))
    names = sources.select(F.col("id").cast("string").alias("data_source_id"), F.concat_ws("/", "owner", "repo").alias("name"))
    named = page.withColumn("data_source_id", F.col("data_source_id").cast("string")).join(names, "data_source_id", "left")
    return named.where(F.col("position") <= offset + size).crossJoin(F.broadcast(more)).select(
        "position",
        "chunk_id",
        F.coalesce("name", F.lit("unknown")).alias("repository"),
        "file_path",
        "start_line",
        "end_line",
        F.round(-F.col("distance"), 6).alias("score"),
        X.result_type(F.col("file_path")).alias("type"),
        X.snippet(F.col("content")).alias("snippet"),
        "has_more",
    )


def encode_cursor(query: str, scope: str, offset: int) -> str:
    """R11"""
    raw = json.dumps({"query": query, "scopeKey": scope, "offset": offset}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> dict | None:
    """None for a cursor that cannot be read: the search then starts at its first page."""
    try:
        found = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return found if {"query", "scopeKey", "offset"} <= found.keys() else None
    except (ValueError, TypeError, AttributeError):
        return None
