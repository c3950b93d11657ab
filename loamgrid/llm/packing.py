"""Lexical retrieval packing: windows of documents that share rare words.

Documents are dealt into shards of bounded size, lexically close ones together: each goes to the
nearest of at most ``CELLS`` centres (fitted to a bounded sample's hashed BM25 vectors), and within
a cell by a MinHash of its id sequences, so that near copies and texts with common passages meet;
whatever is too large for a shard is dealt over several. (Or they are dealt in their given order.)
Each shard holds an inverted index of its documents' subword ids, weighted by BM25 with document
frequencies and the average length of the whole corpus. A window starts with a seed, the rest of a
cut document or the next unused one; the index ranks the unused documents by all of the seed's
terms, and they fill the window in turn. The one that does not fit is cut, and what remains of it
seeds the next window, so only a shard's last window is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .near_join import grouped_runs, tiled
from .shingles import U64, mixed, ngram_hashes
from .tables import forget, least_hashes, scratch, stored
from .tokens import vocabulary_path, word_tokenizer

WINDOW = 2048
END = 1
VOCABULARY = 1 << 16
#: Ids of a shard on average: its index and ids fit a task many times over.
SHARD_IDS = 2_000_000
#: Neighbours that a query ranks at a time; when they are used up, it ranks the next ones.
RANKED = 32
#: Terms in more than one of so many documents of a shard have a weight for each document: at most so many numbers a posting.
COMMON = 8
K1, B = 1.2, 0.75
SLICE = 256
#: Cells of lexically close documents, at most; documents that their centres are fitted to, at most; hashed terms; and
#: MinHash buckets of a cell.
CELLS, SAMPLE, HASHED, BUCKETS = 64, 2000, 1024, 4096


def _tokenized(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                ids, at = encode(part.column(1))
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(np.diff(at)), packed], ["id", "file", "row", "n", "ids"])

    return run


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, file: Column, row: Column) -> DataFrame:
    """``id``, ``n`` and ``ids`` (little-endian unsigned 16-bit) of each document, and its place."""
    given = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), file.alias("file"), row.cast("long").alias("row")
    )
    return given.mapInArrow(_tokenized(path), "id long, file string, row long, n long, ids binary")


def ordered_shards(tokens: DataFrame) -> DataFrame:
    """Adds ``cell`` and ``tile`` for shards that follow the order of files (by part number) and of rows in them.

    Running sums of ids are taken over each file, which one task wrote, without the ids themselves;
    tokens then look up where their file's shards start.
    """
    number = F.coalesce(F.regexp_extract("file", r"part-(\d+)", 1).try_cast("long"), F.lit(-1))
    sums = tokens.groupBy("file").agg(F.sum(F.col("n") + 1).alias("size"))
    files = Window.partitionBy(F.lit(0)).orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("file", F.coalesce(F.sum("size").over(files), F.lit(0)).alias("before"))
    inside = F.sum(F.col("n") + 1).over(Window.partitionBy("file").orderBy("row")) - F.col("n") - 1
    at = tokens.select("file", "row", "n").withColumn("inside", inside).join(before, "file")
    tile = F.floor((F.col("before") + F.col("inside")) / SHARD_IDS).alias("tile")
    starts = at.groupBy("file", tile).agg(F.min("row").alias("row"))
    cuts = starts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row", "tile"))).alias("cuts"))
    own = F.element_at(F.filter("cuts", lambda c: c["row"] <= F.col("row")), -1)["tile"]
    return tokens.join(stored(cuts), "file").select("id", "ids", number.alias("place"), "row", F.lit(0).alias("cell"), own.alias("tile"))


def hashed_vectors(docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> np.ndarray:
    """Unit rows of BM25 weights, each term added to or taken from one of ``HASHED`` places."""
    length = np.array([len(d) for d in docs])
    owner, term, count = distinct_counts(np.concatenate(docs), np.repeat(np.arange(len(docs)), length), len(docs))
    weight = bm25(idf, term, count, length[owner], mean_length)
    h = mixed(term.astype(U64) + U64(1))
    sign = np.where(h >> U64(63), 1.0, -1.0)
    x = np.bincount(owner * HASHED + (h & U64(HASHED - 1)).astype(np.int64), weight * sign, len(docs) * HASHED).reshape(len(docs), HASHED)
    return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1))[:, None]).astype(np.float32)


def cell_centres(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """At most ``cells`` centres of unit rows, by spherical k-means from spread-out seeds."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(cells, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        for c in np.unique(own):
            mean = x[own == c].sum(axis=0)
            centres[c] = mean / max(1e-9, float(np.linalg.norm(mean)))
    return centres


def _routed(centres: np.ndarray, idf: np.ndarray, mean_length: float):
    """Adds the nearest cell, and the bucket of the least hash of the id's runs of five."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), SLICE):
                part = pdf.iloc[lo : lo + SLICE]
                docs = [np.frombuffer(x, np.uint16) for x in part["ids"]]
                cell = (hashed_vectors(docs, idf, mean_length) @ centres.T).argmax(axis=1)
                at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
                grams, edge = ngram_hashes(mixed(np.concatenate(docs).astype(U64)), at, 5)
                least = np.zeros(len(docs), U64)
                some = np.flatnonzero(np.diff(edge))
                least[some] = np.minimum.reduceat(grams, edge[some]) if len(some) else 0
                # Least hashes are small numbers; hashed again they fill the buckets evenly.
                yield part.assign(cell=cell.astype(np.int32), bucket=(mixed(least) % U64(BUCKETS)).astype(np.int32))

    return run


def lexical_shards(tokens: DataFrame, shards: int, idf: np.ndarray, mean_length: float) -> DataFrame:
    """Adds ``cell`` and ``tile`` for shards of lexically close documents."""
    place = F.xxhash64("id", F.crc32("ids")).alias("place")
    rows = tokens.select("id", "ids", "n", place, F.lit(0).cast("long").alias("row"))
    if shards == 1:
        return rows.select("id", "ids", "place", "row", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("tile"))
    run = F.substring("ids", F.lit(1), F.lit(2 << 16))
    held = sorted(bytes(r.ids) for r in least_hashes(rows.select("place", run.alias("ids")), "place", SAMPLE).collect())
    centres = cell_centres(hashed_vectors([np.frombuffer(x, np.uint16) for x in held], idf, mean_length), min(CELLS, shards))
    routed = stored(rows.mapInPandas(_routed(centres, idf, mean_length), "id long, ids binary, n long, place long, row long, cell int, bucket int"))
    return tiled(routed, "cell", "bucket", 1 << 20, F.col("n") + 1, SHARD_IDS, F.col("place")).select("id", "ids", "place", "row", "cell", "tile")


def bm25(idf: np.ndarray, term: np.ndarray, count: np.ndarray, length: np.ndarray, mean_length: float) -> np.ndarray:
    tf = count.astype(np.float64)
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean_length, 1)))


def distinct_counts(ids: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, id and count of each distinct (owner, id)."""
    key, count = np.unique(owner.astype(np.int64) * VOCABULARY + ids, return_counts=True)
    return key // VOCABULARY, key % VOCABULARY, count


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(VOCABULARY, np.int64)
    for pdf in batches:
        for lo in range(0, len(pdf), SLICE):
            part = pdf.iloc[lo : lo + SLICE]
            flat = np.frombuffer(b"".join(part["ids"]), np.uint16)
            owner = np.repeat(np.arange(len(part)), part["n"].to_numpy())
            total += np.bincount(distinct_counts(flat, owner, len(part))[1], minlength=VOCABULARY)
    some = np.flatnonzero(total)
    yield pd.DataFrame({"term": some, "df": total[some]})


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """How many documents hold each id; at most a vocabulary's rows reach the driver."""
    out = np.zeros(VOCABULARY)
    for r in tokens.select("n", "ids").mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r["df"]
    return out


class Index:
    """BM25 weights of a shard's documents, by document and by term."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(docs)
        length = np.array([len(d) for d in docs])
        owner, term, count = distinct_counts(np.concatenate(docs), np.repeat(np.arange(self.n), length), self.n)
        weight = bm25(idf, term, count, length[owner], mean_length)
        self.by_doc = np.searchsorted(owner, np.arange(self.n + 1))
        self.doc_terms = term
        order = np.argsort(term, kind="stable")
        self.by_term = np.searchsorted(term[order], np.arange(VOCABULARY + 1))
        self.posting_docs, self.posting_weights = owner[order], weight[order]
        common = np.flatnonzero(np.diff(self.by_term) * COMMON > self.n)
        self.row = np.full(VOCABULARY, -1)
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.n))
        for row, t in zip(self.table, common, strict=True):
            own = slice(self.by_term[t], self.by_term[t + 1])
            row[self.posting_docs[own]] = self.posting_weights[own]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of all documents for the terms of ``doc``."""
        terms = self.doc_terms[self.by_doc[doc] : self.by_doc[doc + 1]]
        row = self.row[terms]
        rare = terms[row < 0]
        out = self.table[row[row >= 0]].sum(axis=0)
        spans = [slice(lo, hi) for lo, hi in zip(self.by_term[rare].tolist(), self.by_term[rare + 1].tolist(), strict=True)]
        if spans:
            docs = np.concatenate([self.posting_docs[s] for s in spans])
            out += np.bincount(docs, np.concatenate([self.posting_weights[s] for s in spans]), self.n)
        return out


def pack(lengths: np.ndarray, index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard, in the order they are laid."""
    n, unused, nxt = len(lengths), np.ones(len(lengths), bool), 0
    out: list[tuple[int, int, int, int, int]] = []
    seq, filled = 0, 0
    doc, start = -1, 0
    ranked: list[int] = []
    while True:
        if doc < 0:
            if filled == 0:
                while nxt < n and not unused[nxt]:
                    nxt += 1
                if nxt == n:
                    break
                doc = nxt
            else:
                while ranked and not unused[ranked[-1]]:
                    ranked.pop()
                if not ranked:
                    score = index.scores(seed)
                    score[~unused] = -1
                    k = min(RANKED, n)
                    best = np.flatnonzero(score >= max(0, np.partition(score, n - k)[n - k]))
                    ranked = best[np.lexsort((-best, score[best]))].tolist()
                    if not ranked:
                        break
                doc = ranked.pop()
            unused[doc] = False
            start = 0
        if filled == 0:
            seed, ranked = doc, []
        take = min(int(lengths[doc]) - start, window - filled)
        out.append((doc, start, take, seq, filled))
        start += take
        filled += take
        if start == lengths[doc]:
            doc = -1
        if filled == window:
            seq, filled = seq + 1, 0
    return out


def _packed(idf: np.ndarray, mean_length: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped_runs(batches, ["cell", "tile"]):
            group = group.sort_values(["place", "row", "id"], kind="stable", ignore_index=True)
            docs = [np.append(np.frombuffer(x, np.uint16), np.uint16(END)) for x in group["ids"]]
            lengths = np.array([len(d) for d in docs])
            pieces = pack(lengths, Index([d[:-1] for d in docs], idf, mean_length))
            of, start, length, seq, offset = np.array(pieces, np.int64).T
            yield pd.DataFrame(
                {
                    "id": group["id"].array[of],
                    "start": start,
                    "length": length,
                    "ids_crc32": [zlib.crc32(docs[d][s : s + k].astype("<u4").tobytes()) for d, s, k, _, _ in pieces],
                    "doc_tokens": lengths[of],
                    "sequence_id": (int(group["cell"].iloc[0]) << 56) + (int(group["tile"].iloc[0]) << 28) + seq,
                    "offset": offset,
                }
            )

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, in_order: bool = False) -> DataFrame:
    """Pieces of all documents, laid in sequences of at most ``WINDOW`` ids.

    With ``in_order`` the documents, read from files, are dealt to shards in the order of the files
    and of the rows in them, so that sequences follow it shard by shard, and neighbours are sought
    within a stretch of that order; otherwise lexically close documents share a shard.

    One row per piece: the document's id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``
    (with the end id), ``sequence_id``, ``offset``. A null or empty text is its end id alone. A
    text of any length is cut over as many sequences as it needs. Of neighbours with equal BM25 the
    first in the shard's order comes first. Rows with a null id and rows that repeat are packed
    like any other. Other columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    file, row = (F.col("_metadata.file_name"), F.col("_metadata.row_index")) if in_order else (F.lit(""), F.lit(0))
    path = scratch(docs.sparkSession)
    tokens = stored(tokenized(docs, id_col, text_col, vocabulary or vocabulary_path(), file, row), path)
    rows, ids = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(tokens)
    idf, mean_length = np.log1p((rows - df + 0.5) / (df + 0.5)), ids / max(rows, 1)
    shards = max(1, -(-(ids + rows) // SHARD_IDS))
    dealt = ordered_shards(tokens) if in_order else lexical_shards(tokens, shards, idf, mean_length)
    if not in_order and shards > 1:
        # Shards hold a copy of the ids, stored too, and no longer read these.
        forget(docs.sparkSession, path)
    return (
        dealt.repartition("cell", "tile")
        .sortWithinPartitions("cell", "tile")
        .mapInPandas(
            _packed(idf, mean_length),
            "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
        .withColumnRenamed("id", id_col)
    )
