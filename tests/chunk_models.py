"""Plain models of the chunkers, one file at a time, to hold the expressions against."""

import math
import re
from bisect import bisect_right
from typing import NamedTuple

from loamgrid.operators.chunking import definition_spans


class Chunk(NamedTuple):
    content: str
    start: int
    end: int
    tokens: int


def count(text):
    return math.ceil(len(text.encode("utf-16-le", "surrogatepass")) / 8)


def by_tokens(text, limits, shift=0):
    lines = text.split("\n")
    counts = [count(x + "\n") for x in lines[:-1]] + [count(lines[-1])]
    sums = [0]
    for c in counts:
        sums.append(sums[-1] + c)
    out, start, n = [], 0, len(counts)
    while True:
        end = max(start + 1, bisect_right(sums, sums[start] + limits.max_tokens, start) - 1)
        out.append(Chunk("\n".join(lines[start:end]), shift + start + 1, shift + end, sums[end] - sums[start]))
        if end >= n:
            return out
        back = max(0, bisect_right(sums, sums[end] - limits.overlap_tokens, 0, end) - 1)
        start = back if back > start else end


def sections(lines, cuts, limit, limits, skip_blank):
    edges = [*([0] if not cuts or cuts[0] else []), *cuts, len(lines)]
    out = []
    for s, e in zip(edges, edges[1:], strict=False):
        text = "\n".join(lines[s:e])
        if not skip_blank or text.strip():
            out += [Chunk(text, s + 1, e, count(text))] if count(text) <= limit else by_tokens(text, limits, s)
    return out


def by_headings(text, limits):
    lines = text.split("\n")
    return sections(lines, [i for i, x in enumerate(lines) if x.startswith("#")], limits.max_tokens, limits, False)


def by_yaml_keys(text, limits):
    lines = text.split("\n")
    cuts = [i for i, x in enumerate(lines) if re.match(r"[A-Za-z_][\w-]*:(\s|$)", x, re.ASCII)]
    return sections(lines, cuts, limits.max_input_tokens, limits, True) if len(cuts) > 1 else []


def as_whole(text, path, limits):
    if count(text) <= limits.max_input_tokens:
        return [Chunk(text, 1, text.count("\n") + 1, count(text))]
    return (by_yaml_keys(text, limits) if re.search(r"\.ya?ml$", path, re.I) else []) or by_tokens(text, limits)


def by_definitions(text, path, limits):
    lines, out = text.split("\n"), []
    for lo, hi, head in definition_spans(text, path):
        body = "\n".join(lines[lo:hi])
        if count(head + body) <= limits.max_tokens:
            out.append(Chunk(head + body, lo + 1, hi, count(head + body)))
            continue
        for i, c in enumerate(by_tokens(body, limits, lo)):
            out.append(c if i or not head else Chunk(head + c.content, c.start, c.end, count(head + c.content)))
    return out or by_tokens(text, limits)


def pieces(c, most):
    """A queue: the slices of the first chunk that is too large, or their halves, take its place."""
    out, queue = [], [c]
    while queue:
        c = queue.pop(0)
        if c.tokens <= most or len(c.content) <= 1:
            out.append(c)
            continue
        width = min(len(c.content) - 1, max(1, math.floor(most * len(c.content) / c.tokens * 0.9)))
        line, large = c.start, []
        for i in range(0, len(c.content), width):
            text = c.content[i : i + width]
            feeds = text.count("\n")
            if count(text) > most and len(text) > 1:
                left, right = text[: len(text) // 2], text[len(text) // 2 :]
                middle = line + left.count("\n")
                large = [Chunk(right, middle, line + feeds, count(right)), Chunk(left, line, middle, count(left)), *large]
            else:
                out.append(Chunk(text, line, line + feeds, count(text)))
            line += feeds
        queue = large + queue
    return out


def cut(text, path, strategy, limits):
    if not text:
        return []
    made = {
        "headings": lambda: by_headings(text, limits),
        "whole": lambda: as_whole(text, path, limits),
        "yaml": lambda: by_yaml_keys(text, limits),
        "ast": lambda: by_definitions(text, path, limits),
        "tokens": lambda: by_tokens(text, limits),
    }[strategy]()
    return [p for c in made if c.content.strip() for p in pieces(c, limits.max_input_tokens)]
