"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

A text is its UTF-8 bytes, whole. Learned filters of ``WIDTH`` bytes slide over it; chunks of
``CHUNK`` positions overlap by ``WIDTH`` - 1 bytes, so every window lies in a chunk. Within a chunk
each filter's activation is max-pooled; over the chunks of a document its maximum and mean (how
much of the text shows the pattern) go through one logistic unit.

The network is fitted on the driver to a bounded sample of labelled documents; scoring runs where
the texts are, in slices of bounded size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import row_slices, utf8
from .tables import least_hashes, run_of

WIDTH, FILTERS, CHUNK = 6, 16, 64
#: Byte value of the padding after a text's end.
PAD = 256
#: Bytes convolved at a time.
SLAB = 1 << 17
#: Labelled documents of the training sample, at most, and characters of one of them; a longer text gives a run of so many.
SAMPLE, SAMPLE_CHARACTERS = 4000, 1 << 15
#: Chunks of one matrix of activations in training.
STEP_CHUNKS = 256
#: Passes over the sample, and steps at least, so that small samples are learned too.
EPOCHS, STEPS, BATCH, RATE = 14, 800, 64, 0.01
THRESHOLD = 0.7


@dataclass
class Network:
    filters: np.ndarray  # WIDTH, 257, FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    offset: float

    def chunk_maxima(self, data: np.ndarray, chunks: int) -> np.ndarray:
        """Max-pooled activations of ``chunks`` whole chunks; ``data`` has WIDTH - 1 values more."""
        n = chunks * CHUNK
        total = self.filters[0][data[:n]]
        for k in range(1, WIDTH):
            total += self.filters[k][data[k : k + n]]
        return np.maximum(total.reshape(chunks, CHUNK, -1).max(axis=1) + self.bias, 0)

    def scores(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One probability per row; rows are laid out in whole chunks, padded."""
        length = np.diff(rows)
        chunks = np.maximum(1, -(-length // CHUNK))
        starts = np.concatenate([[0], np.cumsum(chunks)])
        laid = np.full(starts[-1] * CHUNK + WIDTH - 1, PAD, np.int16)
        at = np.repeat(starts[:-1] * CHUNK - rows[:-1], length) + np.arange(rows[-1])
        laid[at] = data
        pooled = np.empty((starts[-1], self.filters.shape[2]), np.float32)
        step = SLAB // CHUNK
        for lo in range(0, starts[-1], step):
            hi = min(starts[-1], lo + step)
            pooled[lo:hi] = self.chunk_maxima(laid[lo * CHUNK : hi * CHUNK + WIDTH - 1], hi - lo)
        most = np.maximum.reduceat(pooled, starts[:-1], axis=0) if len(length) else pooled
        mean = np.add.reduceat(pooled, starts[:-1], axis=0) / chunks[:, None] if len(length) else pooled
        z = np.concatenate([most, mean], axis=1) @ self.weights + self.offset
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def train(texts: list[str], labels: list[int], seed: int = 5) -> Network:
    """Fits the network by Adam on the logistic loss; a step sees all chunks of each of its texts."""
    draw = np.random.default_rng(seed)
    net = Network(
        (draw.standard_normal((WIDTH, 257, FILTERS)) * 0.3).astype(np.float32), np.zeros(FILTERS, np.float32), (draw.standard_normal(2 * FILTERS) * 0.3).astype(np.float32), 0.0
    )
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.weights[:] = 0
        net.offset = 4.0 if not len(y) or y[0] else -4.0
        return net
    chunked = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        padded = np.full(max(1, -(-len(raw) // CHUNK)) * CHUNK + WIDTH - 1, PAD, np.int64)
        padded[: len(raw)] = raw
        chunked.append(np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - 1)[::CHUNK])
    params = [net.filters, net.bias, net.weights, np.array([np.log(y.mean() / (1 - y.mean()))], np.float32)]
    slow = [np.zeros_like(p) for p in params]
    fast = [np.zeros_like(p) for p in params]
    steps = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(chunked)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-4
        order = draw.permutation(len(chunked))
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            x = np.concatenate([chunked[i] for i in batch])
            counts = np.array([len(chunked[i]) for i in batch])
            first, own = np.cumsum(counts) - counts, np.repeat(np.arange(len(batch)), counts)
            where, pooled = np.empty((len(x), FILTERS), np.int64), np.empty((len(x), FILTERS), np.float32)
            for a in range(0, len(x), STEP_CHUNKS):
                part = x[a : a + STEP_CHUNKS]
                acts = params[0][0][part[:, :CHUNK]]
                for k in range(1, WIDTH):
                    acts += params[0][k][part[:, k : k + CHUNK]]
                where[a : a + STEP_CHUNKS] = best = acts.argmax(axis=1)
                pooled[a : a + STEP_CHUNKS] = np.maximum(np.take_along_axis(acts, best[:, None], 1)[:, 0] + params[1], 0)
            most = np.maximum.reduceat(pooled, first, axis=0)
            mean = np.add.reduceat(pooled, first, axis=0) / counts[:, None]
            features = np.concatenate([most, mean], axis=1)
            p = 1 / (1 + np.exp(-(features @ params[2] + params[3][0])))
            dz = (p - y[batch]) / len(batch)
            grad_features = dz[:, None] * params[2][None, :]
            top = (pooled == most[own]) & (pooled > 0)
            grad = (grad_features[:, FILTERS:] / counts[:, None])[own] * (pooled > 0) + grad_features[own, :FILTERS] * top
            grad_filters = np.zeros_like(params[0])
            rows = np.arange(len(x))[:, None]
            for k in range(WIDTH):
                flat = x[rows, where + k] * FILTERS + np.arange(FILTERS)[None, :]
                grad_filters[k] = np.bincount(flat.ravel(), grad.ravel(), 257 * FILTERS).reshape(257, FILTERS)
            grads = [grad_filters, grad.sum(axis=0), features.T @ dz, np.array([dz.sum()])]
            steps += 1
            for q, g, s, f in zip(params, grads, slow, fast, strict=True):
                s += 0.1 * (g - s)
                f += 0.01 * (g * g - f)
                q -= rate * (s / (1 - 0.9**steps)) / (np.sqrt(f / (1 - 0.99**steps)) + 1e-7)
    return Network(params[0], params[1], params[2], float(params[3][0]))


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, held_out: Column, sample: int) -> tuple[list[str], list[int]]:
    """At most ``sample`` labelled documents outside the held-out fold, those of the least hashes of the id.

    An id that repeats is one document, with its largest text. A text beyond ``SAMPLE_CHARACTERS``
    gives a run of so many, so the driver holds a bounded sample.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~held_out).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    chosen = least_hashes(known.withColumn("spread", F.xxhash64("id")), "spread", sample)
    text = run_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.xxhash64(id_col), SAMPLE_CHARACTERS)
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    rows = found.groupBy("id", "label").agg(F.max("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.id).encode()), r.id))
    return [r.text for r in rows], [int(r.label) for r in rows]


def _scored(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, rows = utf8(batch.column("text"))
            scores = np.empty(batch.num_rows)
            for lo, hi in row_slices(rows, 1 << 20):
                scores[lo:hi] = net.scores(data[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo])
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores)], [*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(_scored(net), "id long, score double").withColumnRenamed("id", id_col)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: its id, ``held_out``, ``score`` and ``predicted``.

    Labels are learned only outside the fold crc32(id as text) mod 4 = 2, from at most ``sample``
    documents; nothing but the text is an input of a score, and a text of any length is scored
    whole. Null texts are scored as empty ones; a null id is not held out; ids with several labels
    count by the largest; repeated rows are scored each, so equal texts have equal scores. Without
    labels every document scores high. Other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    net = train(*training_sample(docs, labels, id_col, text_col, label_col, remainder(id_col, 4) == 2, sample))
    return score_documents(docs, net, id_col, text_col).select(
        id_col, F.coalesce(remainder(id_col, 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` or more.

    Null texts count as empty ones; repeated rows stay or go together; without labels all rows
    stay. An empty table gives an empty one.
    """
    net = train(*training_sample(docs, labels, id_col, text_col, label_col, remainder(id_col, 4) == 2, SAMPLE))
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).field(batch.column(0).type.get_field_index(text_col))
            scored = next(_scored(net)(iter([pa.RecordBatch.from_arrays([text.fill_null("")], ["text"])])))
            yield batch.filter(pc.greater_equal(scored.column("score"), threshold))

    kept = docs.select(row)
    return kept.mapInArrow(run, kept.schema).select("row.*")
