"""Scores of whole texts: a unigram baseline over words, and the attention model of ``attention_lm``.

Texts are cut into subword ids once and stored with them. Words are counted over all training
documents and known by 64-bit hashes. The most frequent ones, at most ``FREQUENT``, go to every
task; all others are exact too: a document's remaining words are shuffled on their hash and joined
with the stored counts. The attention model gets its first weights on the driver from at most
``SAMPLE`` documents, with the id frequencies of all training documents. Then Spark tasks go over
every window of every training document: shards of about ``SHARD_ROWS`` documents, dealt by a hash,
are learned apart from the same weights, and the mean of their changes makes the next weights, in
``ROUNDS`` rounds that share out the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention_lm import END, VOCABULARY, Learner, Model, changed, train
from .quality import remainder
from .shingles import row_slices, utf8, word_hashes
from .tables import least_hashes, stored
from .tokens import vocabulary_path, word_tokenizer

#: Words whose counts every task holds (16 bytes each), at most.
FREQUENT = 200_000
#: Training documents that the first weights are fitted to, at most, and ids of one of them: a longer text gives a run of
#: so many. All windows of all training documents are learned afterwards.
SAMPLE, SAMPLE_IDS = 800, 1 << 16
#: Training documents of a shard, about, shards at most, and rounds in which the shards' changes are brought together.
SHARD_ROWS, MOST_SHARDS, ROUNDS = 4000, 10_000, 2
#: Texts that a shard learns from at a time.
LEARN_ROWS = 64
#: Weights in one row of a shard's change.
PART = 1 << 14
#: Bytes of text worked on at a time; a longer text is worked on alone.
SLICE = 1 << 20

#: All bytes but space, tab, line feed, vertical tab, form feed and carriage return.
TOKEN_BYTES = np.ones(256, bool)
TOKEN_BYTES[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, rows = utf8(column)
    found, at = word_hashes(_LOWER[data], rows, TOKEN_BYTES)
    return found.view(np.int64), at


def id_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of binary rows end to end, and where each row starts."""
    data, at = utf8(column)
    return data.view("<u2"), at // 2


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(path)
        for batch in batches:
            for lo, hi in row_slices(utf8(batch.column("text"))[1], SLICE):
                part = batch.slice(lo, hi - lo)
                ids, at = encode(part.column("text"))
                packed = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([*part.columns, packed], [*part.schema.names, "ids"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        seen += np.bincount(id_rows(batch.column("ids"))[0], minlength=VOCABULARY)[:VOCABULARY]
        parts = [words(batch.column("text").slice(lo, hi - lo))[0] for lo, hi in row_slices(utf8(batch.column("text"))[1], SLICE)]
        found, count = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(found), np.int32)), pa.array(found), pa.array(count)], ["kind", "key", "n"])
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), np.int32)), pa.array(some), pa.array(seen[some])], ["kind", "key", "n"])


def corpus_counts(texts: DataFrame) -> DataFrame:
    """``kind`` (0 word, 1 subword id), ``key`` and ``n`` over all of ``texts`` (``text, ids``)."""
    made = texts.select("text", "ids").mapInArrow(_counted, "kind int, key long, n long")
    return made.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray]:
    """The least power of two such that at most ``most`` words occur as often, and those words' counts."""
    level = F.floor(F.log2("n")).cast("int")
    levels = {r.level: r["size"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()}
    least, total = 62, 0
    for k in sorted(levels, reverse=True):
        total += levels[k]
        if total > most:
            break
        least = k
    rows = counts.where(F.col("n") >= (1 << least)).select("key", "n").toPandas()
    rows = rows.astype("int64").sort_values("key")
    return 1 << least, rows["key"].to_numpy(), rows["n"].to_numpy()


def sample_ids(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids of at most ``SAMPLE`` training texts, those of the least hashes, end to end and where each text starts."""
    run = F.substring("ids", F.lit(1), F.lit(2 * SAMPLE_IDS))
    rows = sorted(bytes(r.ids) for r in least_hashes(texts.select("spread", run.alias("ids")), "spread", SAMPLE).collect())
    at = np.concatenate([[0], np.cumsum([len(r) // 2 for r in rows])]).astype(np.int64)
    return np.frombuffer(b"".join(rows), "<u2"), at


def _learned(model: Model):
    """One shard's change, in rows of ``PART`` weights times the windows it comes from, as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, LEARN_ROWS):
                learner.learn(*id_rows(batch.column("ids").slice(lo, LEARN_ROWS)))
        if learner.windows:
            change = learner.change().astype("<f8") * learner.windows
            parts = [change[i : i + PART].tobytes() for i in range(0, len(change), PART)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([learner.windows] * len(parts), pa.int64()), pa.array(parts, pa.binary())], ["part", "n", "change"]
            )

    return run


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each ``part`` of the task."""
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for part, m, change in zip(pdf["part"], pdf["n"], pdf["change"], strict=True):
            n[part], total[part] = n.get(part, 0) + m, total.get(part, 0.0) + np.frombuffer(change)
    yield pd.DataFrame({"part": list(n), "n": list(n.values()), "change": [total[k].tobytes() for k in n]})


def learn_all(model: Model, texts: DataFrame, documents: int) -> tuple[Model, int]:
    """The model after every window of all training texts (``spread, ids``), and the number of windows.

    The driver gets one vector of weights a round, whatever the input's size.
    """
    shards = -(-documents // SHARD_ROWS)
    rounds, windows = min(ROUNDS, shards), 0
    for k in range(rounds):
        own = texts.where(F.pmod(F.shiftright("spread", 32), F.lit(rounds)) == k).select("spread", "ids")
        dealt = own.repartition(max(1, min(shards // rounds, MOST_SHARDS)), "spread").sortWithinPartitions("spread")
        made = dealt.mapInArrow(_learned(model), "part int, n long, change binary")
        sums = made.repartition("part").mapInPandas(_added, "part int, n long, change binary").toPandas().sort_values("part")
        if len(sums):
            windows += int(sums["n"].iloc[0])
            model = changed(model, np.concatenate([np.frombuffer(c) / n for c, n in zip(sums["change"], sums["n"], strict=True)]))
    return model, windows


_PARTS = "row long, id long, held_out boolean, n_tokens long, known long, logs double, rest array<long>, score double"


def _scored(model: Model, keys: np.ndarray, counts: np.ndarray, end_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in row_slices(utf8(batch.column("text"))[1], SLICE):
                part = batch.slice(lo, hi - lo)
                found, at = words(part.column("text"))
                place = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
                hit = keys[place] == found if len(keys) else np.zeros(len(found), bool)
                value = np.concatenate([[0.0], np.cumsum(np.where(hit, logs[place] if len(keys) else 0.0, 0.0))])
                hits = np.concatenate([[0], np.cumsum(hit)])
                columns = [
                    pa.array(row + np.arange(hi - lo)),
                    part.column("id"),
                    part.column("held_out"),
                    pa.array(np.diff(at) + 1),
                    pa.array(np.diff(hits[at]) + (end_count > 0)),
                    pa.array(np.diff(value[at]) + np.log10(end_count + 1.0)),
                    pa.ListArray.from_arrays(pa.array((at - hits[at]).astype(np.int32)), pa.array(found[~hit])),
                    pa.array(model.score(*id_rows(part.column("ids")))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "id", "held_out", "n_tokens", "known", "logs", "rest", "score"])
                row += hi - lo

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: its id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, both log10 probabilities.

    Everything is learned outside the fold crc32(id as text) mod 7 = 2. Null texts count as empty
    (one token, the end); a null id is not held out; rows that repeat are counted, learned and
    scored each, so ties need no rule. A text of any length is scored whole, window by window.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    held_out = F.coalesce(remainder(id_col, 7) == 2, F.lit(False)).alias("held_out")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    given = docs.select(F.col(id_col).cast("long").alias("id"), text, held_out, F.xxhash64(id_col, text).alias("spread"))
    tokens = stored(given.mapInArrow(_tokenised(vocabulary or vocabulary_path()), "id long, text string, held_out boolean, spread long, ids binary"))
    learned = tokens.where("NOT held_out")
    counts = stored(corpus_counts(learned))
    documents = learned.count()
    word_counts = counts.where("kind = 0").select("key", "n")
    total, distinct = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = total + documents, distinct + (documents > 0)
    subwords = np.zeros(VOCABULARY)
    for r in counts.where("kind = 1").select("key", "n").collect():
        subwords[r.key] = r.n
    subwords[END] = documents
    model, _ = learn_all(train(*sample_ids(learned), subwords), learned, documents)
    least, keys, often = frequent_words(word_counts)

    parts = stored(tokens.select("id", "text", "held_out", "ids").mapInArrow(_scored(model, keys, often, documents), _PARTS))
    rare = parts.select("row", F.explode("rest").alias("key"))
    joined = rare.join(word_counts.where(F.col("n") < least), "key")
    more = joined.groupBy("row").agg(F.count("*").alias("found"), F.sum(F.log10(F.col("n") + 1.0)).alias("more"))
    out = parts.drop("rest").join(more, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(total + kinds + 1))).alias("base_score"),
        "score",
    )
