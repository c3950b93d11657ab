"""Glob lists as one regular expression that Java and RE2 read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = r"[^\s\S]"


def _braces(glob: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", glob)
    if not m or "," not in m[1]:
        return [glob]
    return [x for part in m[1].split(",") for x in _braces(glob[: m.start()] + part + glob[m.end() :])]


def _segment(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "*":
            out += "[^/]+" if text.strip("*") == "" else "[^/]*"
            while i + 1 < len(text) and text[i + 1] == "*":
                i += 1
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in text[i + 2 :]:
            j = text.index("]", i + 2)
            body = text[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(glob: str) -> str:
    """A pattern for the whole path. ``**`` as a whole segment spans any number of segments, ``*`` and
    ``?`` stay within one, a leading dot needs no dot, ``#`` starts a comment. Negation and
    extended globs are refused."""
    if glob.startswith("#"):
        return NEVER
    if glob.startswith("!") or re.search(r"[?*+@!]\(", glob):
        raise ValueError(f"not supported: {glob}")
    alternatives = []
    for plain in _braces(glob):
        segments, out = plain.split("/"), ""
        for i, s in enumerate(segments):
            last = i == len(segments) - 1
            if s == "**":
                out += "(?:[^/]+/)*[^/]+" if last else "(?:[^/]+/)*"
            else:
                out += _segment(s) + ("" if last else "/")
        alternatives.append(out)
    return f"(?:{'|'.join(alternatives)})"


def globs_regex(globs: list[str]) -> str:
    return f"^(?:{'|'.join(glob_regex(g) for g in globs)})$" if globs else NEVER


def path_passes(path: Column, include: list[str], exclude: list[str]) -> Column:
    """No include list admits all paths; then no exclude may match."""
    wanted = path.rlike(globs_regex(include)) if include else F.lit(True)
    return wanted & ~path.rlike(globs_regex(exclude)) if exclude else wanted
