"""Spelling variants: words one edit apart, found by dense tiles of code-point matrices.

Plan
1. Every task counts the words of its texts (``word_counts``); counts are summed before and after one
   shuffle on the word.
2. If two words differ by one inserted, deleted or replaced code point, the longer one, of length M, has
   an edited place p with all before p and all after it in common. Its places are cut into halves,
   so both words agree on everything outside the half that holds p. Words are blocked by that: by M, the
   half, and what lies outside it; a word of length L is blocked for M = L and M = L + 1.
3. A block of more than ``TILE`` words is cut again: its half into two, and so on down to two places. Such
   a block holds at most the square of the alphabet's size, whatever the data, so no word, prefix or
   suffix can make a block grow with the corpus.
4. A task lays its blocks as matrices of code points, padded on the right for prefixes and on the
   left for suffixes, and compares all pairs of a block: they are near when the common prefix and the
   common suffix together reach the longer length minus one. A pair counts only in the block whose places
   hold the end of its common prefix, so each pair counts once. Tasks send on each word's number of
   near words and the best of them, not pairs.
5. Roots come from pointer doubling along the forms; counts at least double at each step, so chains are short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import row_slices, utf8
from .tables import stored

#: Words of a block that is not cut further, and places of one that cannot be.
TILE, NARROW = 256, 2
#: Code points of all pairs compared in one step.
STEP = 1 << 24
#: One in so many words of a document loses a code point, by its hash.
DROPPED = 97
#: The lead byte in UTF-8 of U+00C0 to U+00FF.
LEAD = 0xC3
#: Bytes of a word whose CRC is taken along with all others of a batch.
SHORT = 64
KEY = ["m", "lo", "hi", "outer"]
NEAR = "word string, n_near long, form_n long, form string"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crcs(seed: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``data``, each carried on from the CRC in ``seed``."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    state = seed[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for k in range(int(min(SHORT, length[0])) if len(length) else 0):
        n = int(np.searchsorted(-length, -k))
        state[:n] = _CRC[(state[:n] ^ data[start[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-length, -SHORT))):
        state[i] = zlib.crc32(data[start[i] + SHORT : start[i] + length[i]].tobytes(), int(state[i]))
    out = np.empty_like(state)
    out[order] = state
    return out


def runs_of(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all runs end to end, A-Z in lower case, each run's first byte there (one entry more), and its row."""
    inside = _LETTER[data]
    lead = np.flatnonzero(data == LEAD)
    inside[lead] = inside[lead + 1] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = rows[:-1][np.diff(rows) > 0]
    first[cut] |= inside[cut]
    at = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(inside)])
    return _LOWER[data[inside]], np.append(before[at], before[-1]), np.searchsorted(rows, at, "right") - 1


def _strings(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data))


def counted_words(ids: list[str], data: np.ndarray, rows: np.ndarray, least: int) -> pa.Table:
    """``word, n`` of the texts in ``data``, without words of fewer than ``least`` code points."""
    letters, edges, row = runs_of(data, rows)
    coded = _strings(letters, edges).dictionary_encode()
    which, words = coded.indices.to_numpy(), coded.dictionary
    if not len(words):
        return pa.table({"word": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})
    pairs, times = np.unique(row * len(words) + which, return_counts=True)
    row, which = np.divmod(pairs, len(words))
    held, at = utf8(words)
    points = at[1:] - at[:-1] - np.diff(np.concatenate([[0], np.cumsum(held == LEAD)])[at])
    seed = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = crcs(seed[row], held, at[which], np.diff(at)[which])
    cut = (h % DROPPED == 0) & (points[which] > least)
    whole = h % DROPPED != 0
    total = np.bincount(which[whole], times[whole], len(words)).astype(np.int64)
    some = np.flatnonzero((total > 0) & (points >= least))
    changed = [w[:k] + w[k + 1 :] for w, k in zip(words.take(pa.array(which[cut])).to_pylist(), (h[cut] % points[which[cut]]).tolist(), strict=True)]
    word = pa.chunked_array([words.take(pa.array(some)), pa.array(changed, pa.large_string())])
    return pa.table({"word": word, "n": pa.array(np.concatenate([total[some], times[cut]]), pa.int64())})


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """``word, n`` over all texts; a word is a run of letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case.

    Where ``DROPPED`` divides the CRC-32 of ``<id>:<word>``, the word lacks the code point at that CRC modulo its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            parts = [counted_words(ids[lo:hi], data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo], least) for lo, hi in row_slices(edges)]
            if parts:
                summed = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
                yield from pa.table({"word": summed["word"].cast(pa.string()), "n": summed["n_sum"]}).to_batches()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text.alias("text"))
    return given.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blocked(words: DataFrame, pieces: str) -> DataFrame:
    """A row for each word and each of its ``pieces``, structs of ``m``, ``lo`` and ``hi``: what the word has outside of it."""
    each = words.select("word", "n", F.explode(F.expr(pieces)).alias("x")).select("word", "n", "x.*")
    outer = F.expr("concat(substring(word, 1, lo), substring(word, char_length(word) - (m - hi) + 1, m - hi))")
    return each.withColumn("outer", outer)


def _halves(m: str) -> str:
    return f"named_struct('m', {m}, 'lo', 0, 'hi', {m} div 2), named_struct('m', {m}, 'lo', {m} div 2, 'hi', {m})"


def tiles(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, n`` with the blocks (``KEY``) in which they are to be compared."""
    now = stored(_blocked(words, f"array({_halves('char_length(word)')}, {_halves('(char_length(word) + 1)')})"))
    done = []
    while True:
        hot = stored(now.groupBy(*KEY).agg(F.count("*").alias("size")).where((F.col("size") > tile) & (F.col("hi") - F.col("lo") > NARROW)).drop("size"))
        if hot.isEmpty():
            break
        done.append(now.join(hot, KEY, "left_anti"))
        middle = "(lo + hi) div 2"
        finer = f"array(named_struct('m', m, 'lo', lo, 'hi', {middle}), named_struct('m', m, 'lo', {middle}, 'hi', hi))"
        now = stored(_blocked_again(now.join(hot, KEY, "left_semi"), finer))
    for part in done:
        now = now.unionByName(part)
    return now


def _blocked_again(rows: DataFrame, pieces: str) -> DataFrame:
    return _blocked(rows.drop("outer").withColumn("pieces", F.expr(pieces)).drop("m", "lo", "hi"), "pieces")


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices of the words' code points from the first on and from the last back, padded with 0, and their lengths."""
    data, edges = utf8(words)
    lead = data == LEAD
    codes = data[~lead].copy()
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    codes[after[~lead]] += 0x40
    starts = edges - np.concatenate([[0], np.cumsum(lead)])[edges]
    length = np.diff(starts)
    width = int(length.max(initial=0))
    step = np.arange(width)
    filled = step < length[:, None]
    padded = np.concatenate([codes, np.zeros(1, np.uint8)])
    ahead = np.where(filled, padded[np.minimum(starts[:-1, None] + step, len(codes))], 0)
    back = np.where(filled, padded[np.maximum(starts[1:, None] - 1 - step, 0)], 0)
    return ahead.astype(np.uint8), back.astype(np.uint8), length


def near_pairs(ahead: np.ndarray, back: np.ndarray, length: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether distinct words ``left`` and ``right`` differ by one edit, and the lengths of their common prefixes."""
    prefix = (ahead[left] != ahead[right]).argmax(axis=1)
    suffix = (back[left] != back[right]).argmax(axis=1)
    return prefix + suffix >= np.maximum(length[left], length[right]) - 1, prefix


def _pairs(starts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within each block, ``starts[i]`` to ``starts[i + 1]``, about ``STEP`` code points at a time."""
    most = max(1, STEP // max(1, width))
    ends = np.repeat(starts[1:], np.diff(starts))
    after = ends - np.arange(len(ends)) - 1
    done = np.concatenate([[0], np.cumsum(after)])
    lo = 0
    while lo < len(after):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + most, "right")) - 1)
        left = np.repeat(np.arange(lo, hi), after[lo:hi])
        yield left, left + 1 + np.arange(len(left)) - np.repeat(done[lo:hi] - done[lo], after[lo:hi])
        lo = hi


def compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """``NEAR`` of whole blocks, sorted by block and word."""
    new = np.ones(len(pdf), bool)
    for c in KEY:
        v = pdf[c].to_numpy()
        new[1:] &= v[1:] == v[:-1]
    new[1:] = ~new[1:]
    starts = np.append(np.flatnonzero(new), len(pdf))
    ahead, back, length = code_points(pa.array(pdf["word"], pa.string()))
    m, lo, hi, n = (pdf[c].to_numpy() for c in ("m", "lo", "hi", "n"))
    owners, others = [], []
    for left, right in _pairs(starts, ahead.shape[1]):
        near, prefix = near_pairs(ahead, back, length, left, right)
        near &= (np.maximum(length[left], length[right]) == m[left]) & (prefix >= lo[left]) & (prefix < hi[left])
        owners += [left[near], right[near]]
        others += [right[near], left[near]]
    if not owners:
        return pd.DataFrame({"word": [], "n_near": [], "form_n": [], "form": []})
    owner, other = np.concatenate(owners), np.concatenate(others)
    order = np.lexsort((other, -n[other], owner))
    owner, other = owner[order], other[order]
    some, first, times = np.unique(owner, return_index=True, return_counts=True)
    word = pdf["word"].to_numpy()
    return pd.DataFrame({"word": word[some], "n_near": times, "form_n": n[other[first]], "form": word[other[first]]})


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = None
    for pdf in batches:
        held = pdf if held is None or not len(held) else pd.concat([held, pdf], ignore_index=True)
        if not len(held):
            continue
        last = (held[KEY] == held[KEY].iloc[-1]).all(axis=1).to_numpy()
        whole = len(held) - int(np.argmin(last[::-1])) if not last.all() else 0
        if whole:
            yield compared(held.iloc[:whole].reset_index(drop=True))
            held = held.iloc[whole:].reset_index(drop=True)
    if held is not None and len(held):
        yield compared(held)


def roots_of(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word along ``word, form``, which has no cycles."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new.drop("moved")


def spelling_variants(docs: DataFrame, least_points: int = 5, least_n: int = 3, ratio: int = 2, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``least_points`` code points and ``least_n`` occurrences.

    ``form`` is the most frequent of a word's near words (of equal ones the first in code-point order) if it
    occurs ``ratio`` times as often, else null; ``root`` is where forms lead. ``ratio`` must be 2 or more.
    Null and empty texts have no words, a null id counts as an empty one, rows that repeat
    count again. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    words = stored(word_counts(docs, id_col, text_col, least_points).where(F.col("n") >= least_n))
    laid = tiles(words, tile).repartition(*KEY).sortWithinPartitions(*KEY, "word").select("word", "n", *KEY)
    parts = laid.mapInPandas(_compared, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form"))).alias("best")
    near = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    held = stored(words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("form_n") >= F.col("n") * ratio, F.lit(False))))
    roots = roots_of(held.where("has"))
    own = [F.when(F.col("has"), F.col(c)).alias(c) for c in ("form", "form_n")]
    return (
        held.join(roots, "word", "left")
        .select("word", own[0], F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), own[1])
    )


def variants_sql(table: str = "documents") -> str:
    """The same in plain SQL: near words share what is left when one place is struck out; CRC-32 from a table of bytes."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, b: xor(a // 256, codes[CAST(xor(a % 256, b) AS INTEGER) + 1])), 4294967295)"
    return f"""WITH RECURSIVE step AS (SELECT CAST(range AS BIGINT) AS b, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256) UNION ALL SELECT b, {bit}, k + 1 FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS codes FROM step WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-zÀ-ÿ]+')) AS run FROM {table}),
each AS (SELECT id, run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, list_transform(range(0, 2 * octet_length(encode(concat(id, ':', run))), 2), lambda i: CAST(concat('0x', substr(hex(encode(concat(id, ':', run))), i + 1, 2)) AS BIGINT)) AS bytes FROM each),
h AS (SELECT run, n, {crc} AS h FROM hashed, crc),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM h) WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
struck AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM struck),
pair AS (SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.rest, a.word, a.n FROM less a JOIN v b ON a.rest = b.word UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(less := -n, form := b)) AS x FROM pair GROUP BY 1),
f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -x.less >= 2 * v.n THEN x.form END AS form, CASE WHEN -x.less >= 2 * v.n THEN CAST(-x.less AS BIGINT) END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word JOIN f AS l ON l.word = c.at AND l.form IS NULL"""
