"""Subword ids of whole batches of text, with a cache of what has been encoded before.

The word tokenizer splits a text at white space and then into runs of letters, single digits and
runs of other characters. These units are found, lower-cased and told apart by 64-bit hashes in
numpy for a whole batch; only a unit that the cache does not hold is encoded. Between spaces, text
with any character but ASCII and the letters U+00C0 to U+00FF, or with an apostrophe (which may
start a contraction), is one unit that goes through the whole tokenizer.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .shingles import U64, mixed, span_hashes, utf8

#: The public vocabulary files; a parameter of every operator that uses them.
WORD_BPE = "word_bpe_49k.json"
#: A cache is emptied beyond so many units (16 bytes each, and their ids) or ids.
MOST_UNITS, MOST_IDS = 1_500_000, 6_000_000

_SPACE, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[[0x20, 0x0A]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b != 0x27]] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHOLE_SALT = U64(0x5851F42D4C957F2D)


def byte_characters() -> dict[int, str]:
    """The visible character that stands for each byte in a byte-level vocabulary."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


def vocabulary_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, and each unit's start, end and whether the whole tokenizer must see it."""
    n = len(data)
    kind, low = _KIND[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
    upper = lead[letter & (second <= 0x9E)] + 1
    low[upper] += 0x20
    first = np.zeros(n, bool)
    first[rows[:-1][rows[:-1] < n]] = True
    full = kind != _SPACE
    starts = full.copy()
    starts[1:] &= ~full[:-1] | first[1:]
    chunk = np.flatnonzero(starts)
    stops = full.copy()
    stops[:-1] &= ~full[1:] | first[1:]
    chunk_end = np.flatnonzero(stops) + 1
    odd = np.concatenate([[0], np.cumsum(kind == _WHOLE)])
    whole = odd[chunk_end] > odd[chunk]
    edge = np.zeros(n + 1, np.int8)
    edge[chunk[whole]] += 1
    edge[chunk_end[whole]] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    low[inside] = data[inside]
    change = full & ~inside
    change[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    starts |= change
    begin = np.flatnonzero(starts)
    of = np.searchsorted(chunk, begin, "right") - 1
    end = np.minimum(np.append(begin[1:], n), chunk_end[of])
    return low, begin, end, whole[of]


_held: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this process for a vocabulary, with what its cache holds by now."""
    if path not in _held:
        _held[path] = WordTokenizer(path)
    return _held[path]


class WordTokenizer:
    """Ids of texts by the word tokenizer in the file ``path``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.shown = byte_characters()
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(0, U64), np.zeros(0, np.int32)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def _learn(self, keys: np.ndarray, texts: list[bytes], whole: np.ndarray) -> None:
        """Adds new units; ``keys`` are in ascending order."""
        encode = self.tokenizer.model.tokenize
        made = [None if w else [t.id for t in encode(b.decode("latin-1").translate(self.shown))] for b, w in zip(texts, whole.tolist(), strict=True)]
        rest = np.flatnonzero(whole).tolist()
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i].decode() for i in rest], add_special_tokens=False), strict=True):
            made[i] = e.ids
        length = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter((i for ids in made for i in ids), np.uint16, int(length.sum()))
        known = len(self.start) - 1
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.place = np.insert(self.place, at, np.arange(known, known + len(keys), dtype=np.int32))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(length)])
        self.ids = np.concatenate([self.ids, flat])

    def __call__(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint16) end to end, and where each text's start (one entry more)."""
        data, rows = utf8(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(rows), np.int64)
        low, begin, end, whole = units(data, rows)
        hashes = span_hashes(low, begin, end)
        hashes[whole] = mixed(hashes[whole] ^ _WHOLE_SALT)
        if len(self.keys) > MOST_UNITS or len(self.ids) > MOST_IDS:
            self._clear()
        found, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != found) if len(self.keys) else np.arange(len(found))
        if len(new):
            raw, some = low.tobytes(), first[new]
            self._learn(found[new], [raw[s:e] for s, e in zip(begin[some].tolist(), end[some].tolist(), strict=True)], whole[some])
            at = np.searchsorted(self.keys, found)
        of = self.place[at][which]
        length = self.start[of + 1] - self.start[of]
        edge = np.concatenate([[0], np.cumsum(length)])
        ids = self.ids[np.repeat(self.start[of] - edge[:-1], length) + np.arange(edge[-1])]
        return ids, edge[np.searchsorted(begin, rows)]
