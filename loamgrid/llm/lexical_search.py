"""Ranked lexical search over a length-stratified index.

A document's score for a term depends on its text only through the term's count ``tf`` and the length
normaliser ``m``, an integer. So documents of equal ``m`` form a stratum, and within a stratum a term's
postings are grouped by ``tf``: every document of such a group gets the same impact, which is computed
once.

Plan
1. One pass over the texts counts each document's terms (``term_counts``); the table is stored, and the
   number of documents and of terms are one aggregate over its counts.
2. Rows move once, to their stratum. A stratum with many postings is cut into lanes by counted rows,
   so no task holds a hot stratum. Each task lays what it gets as blocks: one row per block, with its
   document ids, its terms and their postings by falling ``tf``. That table is the index.
3. A search takes the items in bounded blocks. A term's document frequency is a sum over the index.
   Then every task bounds each pair of stratum and item by the impacts of the largest ``tf`` of each
   term, visits its strata by falling bounds, and opens the postings of a stratum only for items
   whose bound still reaches their weakest place. A task sends on its best documents of each item,
   and a window ranks those.

Scores are sums of integers below 2^53, so they are exact in doubles; an item with more terms than
that allows is summed in two halves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shingles import row_slices, utf8, word_hashes
from .tables import scratch, stored

#: Postings of one block of the index, and its documents; a longer document is a block by itself.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 18, 4096
#: Postings of a lane of a stratum.
LANE_POSTINGS = 1 << 18
#: Terms of the items that are searched in one pass over the index.
ITEM_TERMS = 1 << 16
#: Sums of fewer terms than this are exact in doubles: weights stay below 2^15 and impacts below 2^20.
EXACT_TERMS = 1 << 18
#: Postings added up in one step.
STEP = 1 << 21
#: Stands for a null id, so that it is the last of equal scores.
NO_ID = (1 << 63) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
COUNTS = "doc_id long, lane int, n long, term array<long>, tf array<int>"
INDEX = "m long, doc array<long>, term array<long>, df array<int>, runs array<int>, run_tf array<int>, run_docs array<int>, place array<int>"
HITS = "item long, doc_id long, score long"


def _list(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column end to end, and where each row's start (one entry more)."""
    edges = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]], edges - edges[0]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its length, end to end."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def counted_terms(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct terms in ascending order, their counts, and where each row's start."""
    terms, which = np.unique(words.view(np.int64), return_inverse=True)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    pairs, times = np.unique(row * max(1, len(terms)) + which, return_counts=True)
    row, which = np.divmod(pairs, max(1, len(terms)))
    return terms[which], times, np.searchsorted(row, np.arange(len(rows)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:
        data, edges = utf8(batch.column(1))
        for lo, hi in row_slices(edges):
            words, at = word_hashes(_LOWER[data[edges[lo] : edges[hi]]], edges[lo : hi + 1] - edges[lo])
            terms, times, starts = counted_terms(words, at)
            lane = (seen + np.arange(hi - lo)) & 0x7FFFFFFF
            seen += hi - lo
            columns = [batch.column(0).slice(lo, hi - lo), pa.array(lane, pa.int32()), pa.array(np.diff(at), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, _list(terms, starts, pa.int64()), _list(times, starts, pa.int32())], ["doc_id", "lane", "n", "term", "tf"])


def term_counts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, lane, n, term, tf`` of each row: its number of terms, and its distinct terms with their counts.

    A term is a run of ASCII letters and digits and of other than ASCII characters, A-Z in lower
    case, named by a 64-bit hash. ``lane`` numbers the rows of a task.
    """
    given = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(_counts, COUNTS)


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of consecutive rows of one stratum."""
    for batch in batches:
        if not batch.num_rows:
            continue
        m = batch.column(0).to_numpy()
        doc = batch.column(1).fill_null(NO_ID).to_numpy()
        term, edges = _flat(batch.column(2))
        tf, _ = _flat(batch.column(3))
        cuts, size = [0], 0
        for i, n in enumerate(np.diff(edges).tolist()):
            if i and (m[i] != m[i - 1] or size + n > BLOCK_POSTINGS or i - cuts[-1] == BLOCK_DOCS):
                cuts.append(i)
                size = 0
            size += n
        cuts = np.array([*cuts, len(m)])
        row = np.repeat(np.arange(len(m)), np.diff(edges))
        block = np.searchsorted(cuts, row, "right") - 1
        order = np.lexsort((row, -tf, term, block))
        block, term, tf, row = block[order], term[order], tf[order], row[order]
        new_term = np.ones(len(term), bool)
        new_term[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        new_run = new_term.copy()
        new_run[1:] |= tf[1:] != tf[:-1]
        at_term, at_run = np.flatnonzero(new_term), np.flatnonzero(new_run)
        blocks = np.arange(len(cuts))
        term_edges, run_edges = np.searchsorted(block[at_term], blocks), np.searchsorted(block[at_run], blocks)
        runs = np.diff(np.append(np.searchsorted(at_run, at_term), len(at_run)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(m[cuts[:-1]], pa.int64()),
                _list(doc, cuts, pa.int64()),
                _list(term[at_term], term_edges, pa.int64()),
                _list(np.diff(np.append(at_term, len(term))), term_edges, pa.int32()),
                _list(runs, term_edges, pa.int32()),
                _list(tf[at_run], run_edges, pa.int32()),
                _list(np.diff(np.append(at_run, len(term))), run_edges, pa.int32()),
                _list(row - cuts[block], np.searchsorted(block, blocks), pa.int32()),
            ],
            [c.split()[0] for c in INDEX.split(", ")],
        )


@dataclass
class LengthIndex:
    """The stored blocks, and the number of documents with a term and of all their terms."""

    blocks: DataFrame
    docs: int
    terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LengthIndex:
    """The index of every row of ``docs`` that has a term; null and empty texts have none.

    Rows that repeat are documents of their own; other columns are ignored, whatever their names.
    """
    counts = stored(term_counts(docs, id_col, text_col)).where("n > 0")
    all_docs, all_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not all_docs:
        return LengthIndex(docs.sparkSession.createDataFrame([], INDEX), 0, 0)
    leveled = counts.withColumn("m", F.expr(f"50 + (50 * n * {all_docs}L) div {all_terms}L"))
    lanes = F.ceil(F.sum(F.size("term")) / LANE_POSTINGS).cast("int").alias("lanes")
    # Stored, the lanes (a row for each stratum) have a known size, by which Spark picks the join.
    of_stratum = stored(leveled.groupBy("m").agg(lanes))
    dealt = leveled.join(of_stratum, "m").withColumn("lane", F.col("lane") % F.col("lanes"))
    rows = dealt.repartition("m", "lane").sortWithinPartitions("m", F.asc_nulls_last("doc_id")).select("m", "doc_id", "term", "tf")
    return LengthIndex(stored(rows.mapInArrow(_laid, INDEX)), all_docs, all_terms)


@dataclass
class Items:
    """A block of items: their terms in ascending order, and for each term the items that hold it."""

    ids: list[int]
    vocabulary: np.ndarray
    edges: np.ndarray
    item: np.ndarray
    most_terms: int

    @classmethod
    def of(cls, rows: list) -> Items:
        term = np.concatenate([np.array(r.term, np.int64) for r in rows])
        item = np.repeat(np.arange(len(rows)), [len(r.term) for r in rows])
        order = np.argsort(term, kind="stable")
        vocabulary, first = np.unique(term[order], return_index=True)
        return cls([r.uid for r in rows], vocabulary, np.append(first, len(term)), item[order], max(len(r.term) for r in rows))


def _matched(vocabulary: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the terms that the vocabulary holds, and their places there."""
    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    found = np.flatnonzero(vocabulary[at] == term)
    return found, at[found]


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            term, _ = _flat(batch.column(0))
            found, at = _matched(vocabulary, term)
            total += np.bincount(at, _flat(batch.column(1))[0][found], len(vocabulary)).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["at", "df"])

    return run


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


class Best:
    """The best documents of each item so far: highest scores, of equal scores the smallest ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.doc = np.zeros((items, k), np.int64), np.full((items, k), NO_ID, np.int64)

    def reached(self, bound: np.ndarray, least_id: int) -> np.ndarray:
        """Whether a document from ``least_id`` on with the score ``bound`` could take a place."""
        last, doc = self.score[:, -1], self.doc[:, -1]
        return (bound > last) | ((bound == last) & (bound > 0) & (least_id < doc))

    def add(self, items: np.ndarray, scores: np.ndarray, docs: np.ndarray) -> None:
        """``scores``: a row for each of ``items``, a column for each of ``docs``, which ascend."""
        if scores.shape[1] > self.k:
            floor = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
        else:
            floor = np.zeros(len(items), np.int64)
        row, at = np.nonzero((scores > 0) & (scores >= np.maximum(floor, self.score[items, -1])[:, None]))
        some = np.unique(row)
        if not len(some):
            return
        held = items[some]
        owner = np.concatenate([np.repeat(np.arange(len(some)), self.k), np.searchsorted(some, row)])
        score = np.concatenate([self.score[held].ravel(), scores[row, at]])
        doc = np.concatenate([self.doc[held].ravel(), docs[at]])
        order = np.lexsort((doc, -score, owner))
        first = np.searchsorted(owner[order], np.arange(len(some)))
        take = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.score[held], self.doc[held] = score[take].reshape(-1, self.k), doc[take].reshape(-1, self.k)


def _scores(pair_item: np.ndarray, pair_weight: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, value: np.ndarray, shape: tuple[int, int], exact: bool) -> np.ndarray:
    """Sums of weight times impact for each item and document, over pairs of an item and a range of postings."""
    out = np.zeros(shape[0] * shape[1], np.int64)
    done = np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < len(length):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + STEP, "right")) - 1)
        p = _ranges(start[lo:hi], length[lo:hi])
        cell = np.repeat(pair_item[lo:hi] * shape[1], length[lo:hi]) + place[p]
        add = np.repeat(pair_weight[lo:hi], length[lo:hi]) * value[p]
        for part, unit in ((add, 1),) if exact else ((add >> 24, 1 << 24), (add & 0xFFFFFF, 1)):
            out += np.bincount(cell, part, len(out)).astype(np.int64) * unit
        lo = hi
    return out.reshape(shape)


def _found(items: Items, weight: np.ndarray, k: int):
    exact = items.most_terms < EXACT_TERMS

    def visit(best: Best, m: int, docs: np.ndarray, bound: np.ndarray, matched: np.ndarray, at: np.ndarray, lists: tuple[np.ndarray, ...]) -> None:
        active = np.flatnonzero(best.reached(bound, int(docs[0])))
        if not len(active):
            return
        df, runs, run_tf, run_docs, place = lists
        value = np.repeat(impact(run_tf, m), run_docs)
        ends = np.cumsum(df)
        own = items.edges[at + 1] - items.edges[at]
        e = _ranges(items.edges[at], own)
        rank = np.full(len(items.ids), -1)
        rank[active] = np.arange(len(active))
        who = rank[items.item[e]]
        keep = who >= 0
        of = np.repeat(np.arange(len(at)), own)[keep]
        start, length = (ends - df)[matched[of]].astype(np.int64), df[matched[of]].astype(np.int64)
        best.add(active, _scores(who[keep], weight[at[of]], start, length, place, value, (len(active), len(docs)), exact), docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(0).to_numpy()
            flat = [_flat(c) for c in batch.columns[1:]]
            term, edges = flat[1]
            runs = flat[3][0]
            matched, at = _matched(items.vocabulary, term)
            block = np.searchsorted(edges, matched, "right") - 1
            first_run = np.cumsum(runs) - runs  # runs of a block follow one another, as do the blocks
            top = weight[at] * impact(flat[4][0][first_run[matched]], m[block])
            own = items.edges[at + 1] - items.edges[at]
            cell = np.repeat(block * len(items.ids), own) + items.item[_ranges(items.edges[at], own)]
            bounds = np.zeros((batch.num_rows, len(items.ids)), np.int64)
            np.add.at(bounds.reshape(-1), cell, np.repeat(top, own))
            starts = np.searchsorted(matched, edges)
            for b in np.argsort(-bounds.max(axis=1), kind="stable").tolist():
                lo, hi = starts[b], starts[b + 1]
                if lo == hi:
                    continue
                docs = flat[0][0][flat[0][1][b] : flat[0][1][b + 1]]
                lists = tuple(values[e[b] : e[b + 1]] for values, e in flat[2:])
                visit(best, int(m[b]), docs, bounds[b], matched[lo:hi] - edges[b], at[lo:hi], lists)
        item, place = np.nonzero(best.score)
        doc = best.doc[item, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(items.ids, np.int64)[item]), pa.array(doc, mask=doc == NO_ID), pa.array(best.score[item, place])], ["item", "doc_id", "score"]
        )

    return run


def search(index: LengthIndex, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0.

    Equal scores rank by ascending document id, null ids last. Each row of ``items`` is an item, also
    where ids repeat or are null; an item without text or without a known term has no rows. Ids of
    documents must be below 2^63 - 1. Other columns are ignored, whatever their names.
    """
    spark = items.sparkSession
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not index.docs:
        return empty
    asked = stored(term_counts(items, id_col, text_col).select("doc_id", "term").where("size(term) > 0").withColumn("uid", F.monotonically_increasing_id()))
    passes = math.ceil((asked.agg(F.sum(F.size("term"))).first()[0] or 0) / ITEM_TERMS)
    path = scratch(spark)
    for i in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("uid"), F.lit(passes)) == i).select("uid", "term").collect()
        if not rows:
            continue
        block = Items.of(rows)
        found = index.blocks.select("term", "df").mapInArrow(_frequencies(block.vocabulary), "at long, df long").groupBy("at").agg(F.sum("df").alias("df"))
        weight = np.zeros(len(block.vocabulary), np.int64)
        for r in found.collect():
            weight[r["at"]] = math.floor(1000 * math.log((2 * index.docs + 2) / (2 * r["df"] + 1)))
        index.blocks.mapInArrow(_found(block, weight, k), HITS).write.mode("append").parquet(path)
    if not passes:
        return empty
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    hits = spark.read.schema(HITS).parquet(path).withColumn("rank", rank).where(F.col("rank") <= k)
    return hits.join(asked.select(F.col("uid").alias("item"), F.col("doc_id").alias("item_id")), "item").select("item_id", "rank", "doc_id", "score")


def search_sql(items: str = "benchmark", docs: str = "documents", k: int = 50) -> str:
    """The same ranking in plain SQL, scoring every document that shares a term with an item."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM {docs}),
s AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(ws)) AS BIGINT) AS nt FROM d WHERE len(ws) > 0),
p AS (SELECT r, doc_id, t, n, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT i, item_id, t FROM (SELECT row_number() OVER () AS i, item_id, unnest({words}) AS t FROM {items})),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s WHERE t IN (SELECT t FROM q) GROUP BY t),
c AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN p USING (t), s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {k}"""
