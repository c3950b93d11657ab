"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each of its cells holds one bit per language, and
the AND of an n-gram's cells is the set of all languages that contain it. A text's n-grams are
counted per language by these bits, and each count is corrected for the false positives that the
filter's fill makes likely; the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import remainder
from .shingles import U64, mixed, row_slices, utf8
from .tables import run_of

#: Bytes of an n-gram, cells of the filter and hash functions.
GRAM, CELLS, HASHES = 4, 1 << 20, 3
#: Documents of each language that are learned, about 0.8 of it, characters of one of them, and how often an n-gram must be seen.
SAMPLE, SAMPLE_CHARACTERS, SEEN = 400, 1 << 16, 3
SLAB = 1 << 20
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(128) if not (65 <= i < 91 or 97 <= i < 123)]] = 32


def grams(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of bytes, as numbers, of each row: letters in lower case, all else one space."""
    made = np.maximum(0, np.diff(rows) - GRAM + 1)
    at = np.concatenate([[0], np.cumsum(made)])
    plain = np.concatenate([_FOLD[data], np.zeros(GRAM, np.uint8)]).astype(np.uint32)
    key = np.zeros(len(data), np.uint32)
    for k in range(GRAM):
        key |= plain[k : k + len(data)] << np.uint32(8 * k)
    first = np.repeat(rows[:-1] - at[:-1], made) + np.arange(at[-1])
    return key[first], at


def cells(keys: np.ndarray) -> list[np.ndarray]:
    """The cells of each n-gram, one array for each hash function."""
    h = mixed(keys.astype(U64))
    return [((h >> U64(20 * k)) & U64(CELLS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    """``tables`` has one plane of cells for each 64 languages."""

    names: list[str]
    tables: list[np.ndarray]
    chance: np.ndarray

    def votes(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Corrected counts of n-grams, one row a text and one column a language."""
        keys, at = grams(data, rows)
        one, two, three = cells(keys)
        total = np.diff(at)
        out = np.zeros((len(total), len(self.names)))
        for plane, table in enumerate(self.tables):
            mask = table[one] & table[two] & table[three]
            for i in range(64 * plane, min(64 * plane + 64, len(self.names))):
                bit = np.concatenate([[0], np.cumsum((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), dtype=np.int64)])
                hits = bit[at[1:]] - bit[at[:-1]]
                out[:, i] = np.maximum(0, hits - total * self.chance[i]) / (1 - self.chance[i])
        return out


def learn(texts: dict[str, list[str]]) -> Filters:
    """Fills the filter with every n-gram seen ``SEEN`` times or more in a language's texts."""
    names = sorted(texts)
    kind = next((k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(names) <= bits), np.uint64)
    tables = [np.zeros(CELLS, kind) for _ in range(0, len(names), 64)]
    fill = np.zeros(len(names))
    for i, name in enumerate(names):
        table, bit = tables[i // 64], kind(1 << i % 64)
        data, rows = utf8(edged(pa.array(texts[name], pa.string())))
        keys, count = np.unique(grams(data, rows)[0], return_counts=True)
        for c in cells(keys[count >= min(SEEN, count.max(initial=1))]):
            table[c] |= bit
        fill[i] = np.count_nonzero(table & bit) / CELLS
    return Filters(names, tables, fill**HASHES)


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> dict[str, list[str]]:
    """About 0.8 * ``sample`` texts a language outside the held-out fold (all, where there are fewer).

    Those of the least 63-bit hashes of id and text: each language's distinct hashes are counted, and
    the bound is the share of all hashes that is wanted, so it holds for any number of documents. Equal
    rows are one, in the count as in the sample. A text beyond ``SAMPLE_CHARACTERS`` gives a run of so many.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    spread = F.xxhash64(F.col(id_col), text)
    usable = docs.where(lang.isNotNull() & text.isNotNull() & F.coalesce(remainder(id_col, 5) != 0, F.lit(True))).select(
        lang.alias("lang"), spread.alias("spread"), run_of(text, spread, SAMPLE_CHARACTERS).alias("text")
    )
    counts = {r.lang: r["n"] for r in usable.select("lang", "spread").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    bounds = {k: sample_bound(sample, n) for k, n in counts.items()}
    bound = F.create_map(*[x for k, b in bounds.items() for x in (F.lit(k), F.lit(b))])
    held = usable.where(F.shiftrightunsigned("spread", 1) <= bound[F.col("lang")])
    rows = held.groupBy("lang", "spread").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(rows, key=lambda r: (r.lang, r.spread)):
        out[r.lang].append(r.text)
    return {k: v for k, v in out.items() if v}


def sample_bound(sample: int, documents: int) -> int:
    """The 63-bit hash at or below which about 0.8 * ``sample`` of ``documents`` hashes lie."""
    return min((1 << 63) - 1, (4 * sample << 63) // (5 * documents))


def edged(text: pa.Array) -> pa.Array:
    """Texts between spaces, so that their first and last letters make n-grams too."""
    return pc.binary_join_element_wise("  ", text, "  ", "")


def predictions(filters: Filters, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """For each text its language, that language's share of all corrected counts, and its share of
    the text's n-grams; nulls are unknown."""
    text = pc.fill_null(text, "")
    unlettered = pc.invert(pc.match_substring_regex(text, r"\pL")).to_numpy(zero_copy_only=False)
    data, rows = utf8(edged(text))
    votes = np.zeros((len(text), len(filters.names)))
    for lo, hi in row_slices(rows, SLAB):
        votes[lo:hi] = filters.votes(data[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo])
    if not filters.names:
        return [UNKNOWN] * len(text), np.zeros(len(text)), np.zeros(len(text))
    best, total = votes.argmax(axis=1), votes.sum(axis=1)
    score = np.where(unlettered | (total == 0), 0.0, votes.max(axis=1) / np.maximum(total, 1e-300))
    names = [UNKNOWN if u else filters.names[b] for u, b in zip(unlettered, best, strict=True)]
    cover = np.where(unlettered, 0.0, votes.max(axis=1) / np.maximum(1, np.diff(rows) - GRAM + 1))
    return names, score, cover


def _predicted(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, cover = predictions(filters, batch.column(1))
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(cover)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "coverage"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per document: its id, ``held_out``, ``lang_pred``, ``score`` and ``coverage``.

    Languages are learned outside the fold crc32(id as text) mod 5 = 0, from a sample of about
    ``sample`` texts each (see ``training_texts``); nothing but the text is an input of a
    prediction, and a text of any length is read whole. ``lang_pred`` is a learned language, or
    ``und`` (score 0) where the text is null or has no letter; of equal votes the first language in
    alphabetical order wins, with score 0 where no n-gram is known. A null id is not held out;
    repeated rows are predicted each; other columns are ignored, whatever their names. Without any
    language all are ``und``; an empty table gives an empty result.
    """
    filters = learn(training_texts(docs, id_col, text_col, lang_col, sample))
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (
        given.mapInArrow(_predicted(filters), "id long, lang_pred string, score double, coverage double")
        .withColumnRenamed("id", id_col)
        .select(id_col, F.coalesce(remainder(id_col, 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "coverage")
    )


def keep_known(docs: DataFrame, least: float = 0.2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known and holds ``least`` or more of the n-grams.

    Texts that are null, empty or without a letter go; repeated rows stay or go together. Learns as
    ``identify`` does. An empty table gives an empty one.
    """
    filters = learn(training_texts(docs, id_col, text_col, lang_col, SAMPLE))
    kept = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).field(batch.column(0).type.get_field_index(text_col))
            names, _, cover = predictions(filters, text)
            yield batch.filter(pa.array((np.array(names, object) != UNKNOWN) & (cover >= least)))

    return kept.mapInArrow(run, kept.schema).select("row.*")
