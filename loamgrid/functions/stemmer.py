"""Porter's stemming algorithm (1980), as an Arrow function over arrays of tokens."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _shape(word: str) -> str:
    """The word as a string of v and c; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


# The published suffix rules of steps 2 to 4.
STEP_2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate "
    "alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
)
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(":")) for x in text.split()), key=lambda r: -len(r[0]))


_TWO, _THREE = _rules(STEP_2), _rules(STEP_3)
_FOUR = sorted(STEP_4.split(), key=lambda s: -len(s))


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case token; tokens outside 3 to 64 bytes or with other characters stay."""
    if len(word) < 3 or len(word.encode()) > 64 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((k for s, k in (("ed", 2), ("ing", 3)) if w.endswith(s) and _has_vowel(w[:-k])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_TWO, _THREE):
        found = next(((a, b) for a, b in rules if w.endswith(a)), None)
        if found and _measure(w[: -len(found[0])]) > 0:
            w = w[: -len(found[0])] + found[1]
    suffix = next((s for s in _FOUR if w.endswith(s)), None)
    if suffix and _measure(w[: -len(suffix)]) > 1 and (suffix != "ion" or w[: -len(suffix)].endswith(("s", "t"))):
        w = w[: -len(suffix)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem(t) for t in ts])
