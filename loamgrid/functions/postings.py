"""Postings of whole batches of text, vectorised: the places of each term in each row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .stemmer import stem

#: Bytes of tokens, in lower case: ASCII letters and digits, and all of characters beyond ASCII.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text worked on at a time, or one row; stems kept from one batch to the next.
SLICE, MOST_STEMS = 4 << 20, 1_000_000

_stems: dict[str, str] = {}


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes end to end, and where each row starts (one entry more)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def _tokens(data: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All tokens in order, and the row and the place in it of each."""
    inside = _TOKEN[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = rows[:-1][np.diff(rows) > 0]
    first[cut] |= inside[cut]
    at = np.flatnonzero(first)
    before = np.concatenate([[0], np.cumsum(inside)])
    edges = np.append(before[at], before[-1]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(edges), pa.py_buffer(_LOWER[data[inside]]))
    row = np.searchsorted(rows, at, "right") - 1
    return words, row, np.arange(len(at)) - np.searchsorted(row, np.arange(len(rows)))[row]


def _stemmed(words: pa.Array) -> pa.Array:
    if len(_stems) > MOST_STEMS:
        _stems.clear()
    out = []
    for w in words.to_pylist():
        if (s := _stems.get(w)) is None:
            s = _stems[w] = stem(w)
        out.append(s)
    return pa.array(out, pa.large_string())


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    edges, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + SLICE, "right")) - 1)
        yield lo, hi
        lo = hi


def postings(stemmed: bool):
    """A function of Arrow batches: from the columns to carry, then path and content, to one row a term and row.

    Columns: the term, those carried, the term's number in path and content, the row's tokens in all, and
    the term's places in path and in content, ascending from 0.
    """

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_tokens(*_bytes(batch.column(i))) for i in (-1, -2)]  # content first
        coded = pa.chunked_array([f[0] for f in found]).combine_chunks().dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary
        if stemmed:
            again = _stemmed(words).dictionary_encode()
            code, words = again.indices.to_numpy()[code], again.dictionary
        row, at = (np.concatenate([f[i] for f in found]) for i in (1, 2))
        in_path = np.repeat([False, True], [len(f[0]) for f in found])
        order = np.lexsort((at, in_path, code, row))
        row, code, in_path, at = row[order], code[order], in_path[order], at[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
        first = np.flatnonzero(new)
        edges = np.append(first, len(row))
        path_before = np.concatenate([[0], np.cumsum(in_path)])
        path_tf = np.diff(path_before[edges])
        content_tf = np.diff(edges) - path_tf
        d = np.bincount(row, minlength=batch.num_rows)
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tf)]), pa.int32()), pa.array(at[keep], pa.int32())) for tf, keep in ((path_tf, in_path), (content_tf, ~in_path))]
        own = [c.take(pa.array(row[first])) for c in batch.columns[:-2]]
        names = ["term", *batch.schema.names[:-2], "path_tf", "content_tf", "d", "path_at", "content_at"]
        columns = [words.take(pa.array(code[first])).cast(pa.string()), *own, pa.array(path_tf, pa.int64()), pa.array(content_tf, pa.int64()), pa.array(d[row[first]], pa.int32()), *lists]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(_bytes(batch.column(-1))[1]) + np.diff(_bytes(batch.column(-2))[1])
            for lo, hi in _slices(sizes):
                made = part(batch.slice(lo, hi - lo))
                if made.num_rows:
                    yield made

    return run
