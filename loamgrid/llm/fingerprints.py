"""MinHash fingerprints of documents, and the near-duplicates they lead to.

A fingerprint is ``PERMUTATIONS`` MinHash values of the text's word n-grams, 16 bits each, as
hexadecimal digits; the likeness of two fingerprints is the share of equal values, an estimate of
the Jaccard similarity. The fingerprint itself, cut into bands, is joined in Spark, and pairs that meet
are verified on full n-gram sets (see ``near_join``).

``edited_fingerprints`` also fingerprints each text's edited form, whose last quarter is replaced
by the head of the next document. A row whose successor (id + 1) came in the same batch is done
there; only the others, and the rows that may be their successors, are moved, by ranges of the id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_join import grouped_runs, linked_sketches, named_links, text_key
from .shingles import Permutations, ngram_hashes, sequence_keys, utf8, word_hashes
from .tables import stored

PERMUTATIONS = 128
#: 21 bands of 6 rows meet a pair at Jaccard 0.8 with probability 0.998.
BANDS, ROWS = 21, 6
#: Texts worked on at a time.
SLICE = 512

_PASS = (
    "id long, done boolean, open boolean, head boolean, text string, n_chars long, edited_sha256 string, fp binary, efp binary, "
    "near_edited double, near_next double, k1 long, k2 long, n_bytes long, key long"
)


class Sketcher:
    """MinHash values of lower-cased texts."""

    def __init__(self, n: int = 5):
        self.n, self.perms = n, Permutations(PERMUTATIONS)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, at = word_hashes(*utf8(pa.array([t.lower() for t in texts], pa.string())))
        return self.perms.minima(*ngram_hashes(words, at, self.n)), words, at


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a & 0xFFFF) == (b & 0xFFFF)).mean(axis=1)


def fingerprint_bytes(minima: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in (minima & 0xFFFF).astype(">u2")]


def bands_of(fp: str) -> Column:
    """A 64-bit key for each band of a binary fingerprint; the band's number is part of it."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring(F.col(fp), b * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def _compared(sketch: Sketcher, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> dict:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other, _, _ = sketch(changed)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
        "fp": fingerprint_bytes(own),
        "efp": fingerprint_bytes(other),
        "near_edited": likeness(own, other),
        "near_next": likeness(own, after),
    }


def _first_pass(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = Sketcher(n)
        for pdf in batches:
            pdf = pdf.sort_values("id", kind="stable", ignore_index=True)
            ids, texts = pdf["id"].to_numpy(), pdf["text"].tolist()
            joined, apart = np.zeros(len(ids) + 1, bool), pdf["apart"].to_numpy()
            joined[1:-1] = (ids[1:] == ids[:-1] + 1) & ~apart[1:] & ~apart[:-1]
            for lo in range(0, len(ids), SLICE):
                hi = min(len(ids), lo + SLICE)
                minima, words, at = sketch(texts[lo : hi + 1])
                own, words, at = minima[: hi - lo], words[: at[hi - lo]], at[: hi - lo + 1]
                one, two = sequence_keys(words, at)
                none = np.diff(at) == 0
                closed = np.flatnonzero(joined[lo + 1 : hi + 1])
                head = ~joined[lo:hi]
                out = pd.DataFrame({"id": ids[lo:hi], "done": joined[lo + 1 : hi + 1], "open": ~joined[lo + 1 : hi + 1], "head": head})
                out["text"] = [t if o or h else None for t, o, h in zip(texts[lo:hi], out["open"], head, strict=True)]
                made = pd.DataFrame(
                    _compared(sketch, [texts[lo + i] for i in closed], [texts[lo + i + 1] for i in closed], minima[closed], minima[closed + 1]), index=closed
                )
                out = out.join(made.drop(columns="fp"))
                out["fp"] = fingerprint_bytes(own)
                out["n_chars"] = out["n_chars"].astype("Int64")
                for c in ("edited_sha256", "efp"):
                    out[c] = out[c].astype(object).where(out[c].notna(), None)
                out["k1"] = pd.arrays.IntegerArray(one.view(np.int64), none)
                out["k2"] = pd.arrays.IntegerArray(two.view(np.int64), none)
                out["n_bytes"] = [len(t.encode()) for t in texts[lo:hi]]
                out["key"] = pdf["key"].to_numpy()[lo:hi]
                yield out

    return run


def _dealt(cuts: np.ndarray, guards: dict[int, list[int]]):
    """Gives each row the range it lies in, and copies the first row of a range to the one before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pid = np.searchsorted(cuts, pdf["id"].to_numpy(), "right")
            yield pdf.assign(pid=pid, guard=False)
            more = pdf[pdf["head"] & pdf["id"].isin(guards.keys())]
            for to in sorted({p for i in more["id"] for p in guards[i]}):
                yield more[[to in guards[i] for i in more["id"]]].assign(pid=to, guard=True)

    return run


def _second_pass(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = Sketcher(n)
        for group in grouped_runs(batches, ["pid"]):
            group = group.sort_values(["guard", "id", "text"], kind="stable", ignore_index=True)
            heads = np.flatnonzero(group["head"].to_numpy())
            mine = np.flatnonzero((group["open"] & ~group["guard"]).to_numpy())
            place = np.searchsorted(heads, mine, "right")
            after = heads[np.minimum(place, len(heads) - 1)]
            texts = group["text"].tolist()
            for lo in range(0, len(mine), SLICE):
                i, j = mine[lo : lo + SLICE], after[lo : lo + SLICE]
                own, _, _ = sketch([texts[k] for k in i])
                following, _, _ = sketch([texts[k] for k in j])
                yield pd.DataFrame({"row": group["row"].to_numpy()[i]} | _compared(sketch, [texts[k] for k in i], [texts[k] for k in j], own, following))

    return run


def _moved(slow: DataFrame, n: int) -> DataFrame:
    """Rows whose successor came in another batch, brought together by ranges of the id.

    The driver gets the bounds and first ids of four ranges a shuffle partition.
    """
    parts = int(slow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    cuts = slow.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    firsts = slow.where("head").select("id").mapInPandas(
        lambda batches: (pd.DataFrame({"pid": np.searchsorted(cuts, b["id"].to_numpy(), "right"), "id": b["id"]}).groupby("pid", as_index=False).min() for b in batches), "pid long, id long"
    )
    least = sorted((r.pid, r.id) for r in firsts.groupBy("pid").agg(F.min("id").alias("id")).collect())
    guards: dict[int, list[int]] = {}
    known = np.array([p for p, _ in least])
    for pid in range(len(cuts) + 1):
        if least:
            k = int(np.searchsorted(known, pid, "right"))
            guards.setdefault(least[k % len(least)][1], []).append(pid)
    return (
        slow.select("row", "id", "text", "open", "head")
        .mapInPandas(_dealt(cuts, guards), "row long, id long, text string, open boolean, head boolean, pid long, guard boolean")
        .repartition("pid")
        .sortWithinPartitions("pid")
        .mapInPandas(_second_pass(n), "row long, n_chars long, edited_sha256 string, fp binary, efp binary, near_edited double, near_next double")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Fingerprints of each text and of its edited form, and the text's near-duplicate class.

    One row per document: its id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``, ``n_links`` and ``class_id`` (as in
    ``near_join``). Null texts count as empty; a text without words has the fingerprint of all
    ones; texts of any length are read whole. The next document is the one with the next larger id,
    and the first after the last; rows with a null id come first and lose no row. Where ids repeat,
    rows are ordered by id and text, and only those rows and their neighbours leave the first pass.
    Other columns are ignored; an empty table gives an empty result.
    """
    lowest = -(1 << 63)
    given = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("key", text_key(F.col("id"), F.lower("text")))
    repeated = stored(given.groupBy("id").count().where("count > 1").select("id"))
    if repeated.limit(1).count():
        marked = repeated.unionAll(repeated.select(F.col("id") - 1)).distinct().withColumn("apart", F.lit(True))
        given = given.join(marked, "id", "left").withColumn("apart", F.coalesce("apart", F.lit(False)))
    else:
        given = given.withColumn("apart", F.lit(False))
    first = stored(given.mapInPandas(_first_pass(n), _PASS).withColumn("row", F.monotonically_increasing_id()))
    cols = ["row", "n_chars", "edited_sha256", "fp", "efp", "near_edited", "near_next"]
    made = first.where("done").select(cols).unionAll(_moved(first.where("NOT done OR head"), n).select(cols))
    real = F.when(F.col("id") != lowest, F.col("id")).alias("id")
    sig = first.select("row", real, "key", "k1", "k2", bands_of("fp").alias("bands"), "n_bytes")
    lower = given.select("id", "text")
    links = stored(named_links(linked_sketches(sig, lower, "id", "text", n, threshold)).select("row", "id", "n_links", "class_id"))
    out = made.join(links, "row")
    return out.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("efp")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "n_links",
        "class_id",
    )
