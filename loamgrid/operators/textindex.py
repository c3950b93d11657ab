"""Full-text search: BM25 over path and content, with statistics of all rows.

``bm25_scan`` answers a few queries in one pass without an index: term counts are native array
expressions, so only one row of statistics and the top rows move. ``build_index`` stores postings
and lengths once, and ``bm25_lookup`` answers any number of queries from them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.postings import postings as postings_of
from ..functions.stemmer import stem, stems

K1, B = 1.2, 0.75
TOKEN = r"[a-z0-9\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column, stemmed: bool = False) -> Column:
    """Runs of ASCII letters and digits and of non-ASCII characters, ASCII in lower case."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TOKEN), F.lit(0))
    return stems(found) if stemmed else found


def query_phrases(query: str, stemmed: bool = False) -> list[list[str]]:
    """Words of two characters or more without punctuation; an underscore splits a word into a
    phrase. Operators of a query language are ordinary words here."""
    words = [re.sub(r"[^0-9A-Za-z_]", "", w) for w in query.split()]
    phrases = [[t for t in w.lower().split("_") if t] for w in words if len(w) >= 2]
    return [[stem(t) for t in p] if stemmed else p for p in phrases if p]


def occurrences(found: Column, phrase: list[str]) -> Column:
    """How often the phrase occurs in an array of tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(found, lambda t: t == phrase[0]))
    starts = F.sequence(F.lit(1), F.greatest(F.size(found) - len(phrase) + 1, F.lit(1)))
    match = lambda i: F.slice(found, i, len(phrase)) == F.array(*[F.lit(t) for t in phrase])
    return F.size(F.filter(starts, match))


def idf(rows: Column, holding: Column) -> Column:
    raw = F.log((rows - holding + 0.5) / (holding + 0.5))
    return F.when(raw > 0, raw).otherwise(1e-6)


def bm25_scan(
    chunks: DataFrame, query: str, key: str = "chunk_id", path_weight: float = 5.0, content_weight: float = 1.0, scope: Column | None = None, stemmed: bool = False
) -> DataFrame:
    """``key`` and ``bm25`` of rows that hold every phrase of the query, in any column.

    Row counts, document frequencies and the mean length are those of all rows; ``scope`` only
    filters the result.
    """
    phrases = query_phrases(query, stemmed)
    if not phrases:
        return chunks.select(key, F.lit(0.0).alias("bm25")).where(F.lit(False))
    # Exploding one struct keeps the tokens from being worked out again for each filter on their counts.
    found = F.explode(F.array(F.struct(tokens(F.col("file_path"), stemmed).alias("p"), tokens(F.col("content"), stemmed).alias("c"))))
    both = chunks.select(key, (scope if scope is not None else F.lit(True)).alias("_in"), found.alias("t")).select(key, "_in", "t.p", "t.c")
    f = {f"f{i}": path_weight * occurrences(F.col("p"), ph) + content_weight * occurrences(F.col("c"), ph) for i, ph in enumerate(phrases)}
    counted = both.select(key, "_in", (F.size("p") + F.size("c")).alias("d"), *[v.alias(k) for k, v in f.items()])
    stats = counted.agg(F.count("*").alias("rows"), F.avg("d").alias("mean"), *[F.sum((F.col(k) > 0).cast("long")).alias(f"n_{k}") for k in f])
    hits = counted.where(F.col("_in"))
    for k in f:
        hits = hits.where(F.col(k) > 0)
    norm = K1 * (1 - B + B * F.col("d") / F.col("mean"))
    score = sum((idf(F.col("rows"), F.col(f"n_{k}")) * F.col(k) * (K1 + 1) / (F.col(k) + norm) for k in f), F.lit(0.0))
    return hits.crossJoin(F.broadcast(stats)).select(key, score.alias("bm25"))


def build_index(chunks: DataFrame, key: str = "chunk_id", stemmed: bool = True, carried: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths (``key, d``) of all rows, with the columns ``carried``.

    A posting is ``term, key, path_tf, content_tf, d, path_at, content_at``: the last two are the term's
    places in path and content, ascending from 0. All of a row's postings are made where the row is,
    so nothing is shuffled; sorted by term before they are written, they are read by pages of their term.
    """
    own = [key, *(carried or [])]
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in own)
    made = chunks.select(*own, F.col("file_path").cast("string").alias("_path"), F.col("content").cast("string").alias("_content")).mapInArrow(
        postings_of(stemmed), f"term string, {kinds}, path_tf long, content_tf long, d int, path_at array<int>, content_at array<int>"
    )
    number = lambda c: F.regexp_count(F.coalesce(F.col(c), F.lit("")), F.lit("[A-Z" + TOKEN[1:]))
    return made, chunks.select(*own, (number("file_path") + number("content")).alias("d"))


def _phrase_count(parts: Column, column: str) -> Column:
    """How often words lie at their places of a phrase: starts that all words' places, each less its own, share."""
    starts = lambda x: F.transform(x[column], lambda at: at - x["place"])
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.size(F.aggregate(rest, starts(F.get(parts, F.lit(0))), lambda held, x: F.array_intersect(held, starts(x))))


def bm25_lookup(
    postings: DataFrame,
    lengths: DataFrame,
    queries: dict[int, str],
    k: int,
    key: str = "chunk_id",
    path_weight: float = 5.0,
    content_weight: float = 1.0,
    stemmed: bool = True,
    stats: DataFrame | None = None,
    scope: Column | None = None,
) -> DataFrame:
    """The ``k`` best rows of each query, words and phrases alike: ``query_id, key, bm25, rank``.

    Reads the postings of the queries' terms alone; no text is read. A phrase of several words holds
    where the places of its words, each less its place in the phrase, meet. ``stats`` (``rows, mean``)
    saves the look at all ``lengths``; ``scope`` filters the result and leaves the statistics as they are.
    """
    spark = postings.sparkSession
    asked = {q: query_phrases(text, stemmed) for q, text in queries.items()}
    pairs = [(q, i, j, t) for q, phrases in asked.items() for i, p in enumerate(phrases) for j, t in enumerate(p)]
    wanted = F.broadcast(spark.createDataFrame(pairs, "query_id long, phrase int, place int, term string"))  # the queries' own words
    sizes = F.broadcast(spark.createDataFrame([(q, len(p)) for q, p in asked.items() if p], "query_id long, phrases int"))
    lengths_of = F.broadcast(wanted.groupBy("query_id", "phrase").agg(F.count("*").alias("words")))
    stats = F.broadcast(lengths.agg(F.count("*").alias("rows"), F.avg("d").alias("mean")) if stats is None else stats)
    found = postings.where(F.col("term").isin(sorted({t for *_, t in pairs}))).withColumn("_in", F.lit(True) if scope is None else scope).join(wanted, "term")
    own = ["query_id", "phrase", key, "d", "_in"]
    if all(len(p) == 1 for phrases in asked.values() for p in phrases):
        held = found.select(*own, "path_tf", "content_tf")
    else:
        parts = F.collect_list(F.struct("place", "path_at", "content_at")).alias("parts")
        whole = found.groupBy(*own).agg(parts).join(lengths_of, ["query_id", "phrase"]).where(F.size("parts") == F.col("words"))
        held = whole.select(*own, _phrase_count(F.col("parts"), "path_at").alias("path_tf"), _phrase_count(F.col("parts"), "content_at").alias("content_tf"))
    counted = held.withColumn("f", path_weight * F.col("path_tf") + content_weight * F.col("content_tf")).where("f > 0")
    df = F.broadcast(counted.groupBy("query_id", "phrase").agg(F.count("*").alias("n")))  # a row for each phrase asked
    norm = K1 * (1 - B + B * F.col("d") / F.col("mean"))
    part = idf(F.col("rows"), F.col("n")) * F.col("f") * (K1 + 1) / (F.col("f") + norm)
    scored = (
        counted.where("_in")
        .join(df, ["query_id", "phrase"])
        .crossJoin(stats)
        .groupBy("query_id", key)
        .agg(F.sum(part).alias("bm25"), F.count("*").alias("held"))
        .join(sizes, "query_id")
        .where("held = phrases")
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", key, "bm25", "rank")


def bm25_hits(postings: DataFrame, lengths: DataFrame, query: str, k: int, path_weight: float = 5.0, content_weight: float = 1.0, stemmed: bool = True, stats: DataFrame | None = None, scope: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """``key, bm25`` of the ``k`` best rows of one query; none for a query without words."""
    if not query_phrases(query, stemmed):
        return postings.select(key, F.lit(0.0).alias("bm25")).where(F.lit(False))
    return bm25_lookup(postings, lengths, {0: query}, k, key, path_weight, content_weight, stemmed, stats, scope).select(key, "bm25")
