"""Cutting files into line-addressed chunks.

Lines, windows of tokens, headings, YAML keys and the limit of an input are array expressions within a file's
row: no Python worker, no shuffle. Only where definitions of source code begin and end is found in Python, in Arrow
batches; what becomes of them is an expression again.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import model
from ..functions import scalars as X
from ..functions.arrays import let, running_sums, windows

#: Tokens of a text.
Counter = Callable[[Column], Column]
#: What the blanks of a text are made of.
_NOT_BLANK = r"[^\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_YAML_KEY = r"^[A-Za-z_][A-Za-z0-9_-]*:(\s|$)"


def _chunk(content: Column, start: Column, end: Column, tokens: Column) -> Column:
    return F.struct(content.alias("content"), start.cast("long").alias("start_line"), end.cast("long").alias("end_line"), tokens.cast("long").alias("token_count"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _part(lines: Column, lo: Column, hi: Column) -> Column:
    return F.array_join(F.slice(lines, lo + 1, hi - lo), "\n")


def _section(lo: Column, hi: Column, most: int | None, head: Column | None = None) -> Column:
    """Lines to be one chunk with ``head`` before them, if they have at most ``most`` tokens, else windows; always windows without ``most``."""
    top = F.lit("") if head is None else head
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.lit(-1 if most is None else most).cast("long").alias("most"), top.alias("head"))


def _between(cuts: Column, n: Column, most: int) -> Column:
    return let(cuts, lambda c: F.transform(c, lambda at, i: _section(at, F.coalesce(F.get(c, i + 1), n), most)))


def by_tokens(lines: Column) -> Column:
    """Windows of all lines."""
    return F.array(_section(F.lit(0), F.size(lines), None))


def by_headings(lines: Column, limits: model.ChunkLimits) -> Column:
    """Sections that start with a heading, and what comes before the first."""
    cuts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | F.get(lines, i).startswith("#"))
    return _between(cuts, F.size(lines), limits.max_tokens)


def by_yaml_keys(lines: Column, limits: model.ChunkLimits) -> Column:
    """A section for each top-level key that is not blank; empty unless the text has two keys or more."""

    def of(keys: Column) -> Column:
        cuts = F.when(F.size(keys) < 2, F.slice(keys, 1, 0)).when(F.get(keys, F.lit(0)) == 0, keys).otherwise(F.concat(F.array(F.lit(0)), keys))
        return F.filter(_between(cuts, F.size(lines), limits.max_input_tokens), lambda x: _part(lines, x["lo"], x["hi"]).rlike(_NOT_BLANK))

    return let(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(_YAML_KEY)), of)


def as_whole(text: Column, lines: Column, path: Column, limits: model.ChunkLimits, count: Counter) -> Column:
    """The file as one section; one that is too large by its YAML keys, else by windows."""
    keyed = F.when((count(text) > limits.max_input_tokens) & F.lower(path).rlike(r"\.ya?ml$"), by_yaml_keys(lines, limits))
    return let(keyed, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(_section(F.lit(0), F.size(lines), limits.max_input_tokens))))


def by_spans(lines: Column, spans: Column, limits: model.ChunkLimits) -> Column:
    """A section for each definition (``lo``, ``hi``, ``head``), headed by its container; windows of all lines if there are none."""
    return F.when(F.size(spans) > 0, F.transform(spans, lambda d: _section(d["lo"], d["hi"], limits.max_tokens, d["head"]))).otherwise(by_tokens(lines))


def chunked(lines: Column, sections: Column, limits: model.ChunkLimits, count: Counter) -> Column:
    """The chunks of all sections in order. Windows count their lines, each with its line feed but the last."""

    def of(x: Column) -> Column:
        headed = lambda body: F.when(x["head"] == "", body).otherwise(F.concat(x["head"], body))

        def split(part: Column) -> Column:
            counts = F.transform(part, lambda line, i: count(F.when(i < F.size(part) - 1, F.concat(line, F.lit("\n"))).otherwise(line)))

            def window(w: Column, i: Column) -> Column:
                plain = (i > 0) | (x["head"] == "")
                body = let(_part(part, w["lo"], w["hi"]), lambda c: F.when(plain, c).otherwise(F.concat(x["head"], c)))
                return let(body, lambda c: _chunk(c, x["lo"] + w["lo"] + 1, x["lo"] + w["hi"], F.when(plain, w["total"]).otherwise(count(c))))

            return F.transform(windows(counts, limits.max_tokens, limits.overlap_tokens), window)

        def whole(body: Column) -> Column:
            own = lambda t: F.when(t <= x["most"], F.array(_chunk(body, x["lo"] + 1, x["hi"], t))).otherwise(let(F.slice(lines, x["lo"] + 1, x["hi"] - x["lo"]), split))
            return let(F.when(x["most"] >= 0, count(body)).otherwise(F.lit(0).cast("long")), own)

        return let(headed(_part(lines, x["lo"], x["hi"])), whole)

    return F.flatten(F.transform(sections, of))


def limited(chunks: Column, most: int, count: Counter) -> Column:
    """Chunks of at most ``most`` tokens, cut by characters; lines follow from the line feeds before a piece.

    Of a chunk that is too large the slices that fit come first, in order, and then the halves of the
    others, from the last slice to the first and each right half before its left one. Halves fit: a slice
    is at most 0.9 of the limit by the chunk's own rate, and a character counts twice another one at most.
    """

    def feeds(text: Column) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))

    def piece(text: Column, before: Column) -> Column:
        return _chunk(text, before, before + feeds(text), count(text))

    def pieces(c: Column) -> Column:
        n = F.char_length(c["content"])
        width = F.least(n - 1, F.greatest(F.lit(1), F.floor(F.lit(most) * n / c["token_count"] * 0.9).cast("int")))

        def placed(texts: Column) -> Column:
            before = running_sums(F.transform(texts, feeds))
            def of_sums(sums: Column) -> Column:
                at = lambda i: c["start_line"] + F.when(i > 0, F.get(sums, i - 1)).otherwise(F.lit(0))
                return F.transform(texts, lambda t, i: piece(t, at(i)))

            return let(before, of_sums)

        def halves(x: Column) -> Column:
            text, half = x["content"], F.floor(F.char_length(x["content"]) / 2).cast("int")
            left = F.substring(text, F.lit(1), half)
            right = F.substring(text, half + 1, F.char_length(text))
            return F.array(piece(right, x["start_line"] + feeds(left)), piece(left, x["start_line"]))

        fits = lambda x: (x["token_count"] <= most) | (F.char_length(x["content"]) <= 1)
        slices = F.transform(F.sequence(F.lit(1), n, width), lambda i: F.substring(c["content"], i, width))
        return let(let(slices, placed), lambda ps: F.concat(F.filter(ps, fits), F.flatten(F.transform(F.reverse(F.filter(ps, lambda x: ~fits(x))), halves))))

    held = F.filter(chunks, lambda c: c["content"].rlike(_NOT_BLANK))
    small = lambda c: (c["token_count"] <= most) | (F.char_length(c["content"]) <= 1)
    return F.flatten(F.transform(held, lambda c: F.when(small(c), F.array(_chunk(c["content"], c["start_line"], c["end_line"], c["token_count"]))).otherwise(pieces(c))))


class Definition(NamedTuple):
    start: int  # lines from 0, end exclusive
    end: int
    kind: str  # function, class or decorated
    container: str | None


def python_definitions(text: str) -> list[Definition]:
    """Functions, methods and classes of Python source, decorators included."""
    found: list[Definition] = []

    def visit(node: ast.AST, container: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = container
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                named = isinstance(child, ast.ClassDef)
                kind = "decorated" if child.decorator_list else "class" if named else "function"
                found.append(Definition(first - 1, child.end_lineno or first, kind, container))
                inner = child.name if named else container
            visit(child, inner)

    visit(ast.parse(text), None)
    return found


#: Heads of definitions in languages with braces: what opens a class-like or a function-like body. A head is sought in at
#: most ``HEAD`` characters and ``HEAD_LINES`` lines before its brace, so the scan is linear in the text.
HEAD, HEAD_LINES = 400, 8
_BRACE_CLASS = re.compile(r"\s*(?:[\w@]+\s+){0,6}?(class|interface|enum|record|struct|impl)\b\s*(?:<[^>]*>)?\s*(.*)", re.S)
_BRACE_FUNCTION = re.compile(
    r"[ \t]*(?!(?:if|for|while|switch|catch|return|else|do|try|match|loop|with|using|lock)\b)(?:[\w@<>\[\],.*&:?]+[ \t]+){0,8}?"
    r"(?:function\s*\*?\s*\w*|func\s*(?P<receiver>\([^)]*\))?\s*\w+|fn\s+\w+|\w+)\s*(?:<[^>(){}]*>)?\([^{};]*\)[^{};=()]*",
)


def _brace_head(plain: str, lo: int, hi: int) -> tuple[int, str, str | None] | None:
    """Start, kind and name (a function's receiver) of the definition whose brace is at ``hi``, if it is one."""
    head = plain[lo:hi]
    starts = [0, *(m.end() for m in re.finditer("\n", head))][-HEAD_LINES:]
    for at in reversed(starts):
        part = head[at:]
        if not part.strip():
            continue
        m = _BRACE_CLASS.fullmatch(part)
        if m:
            return lo + at, "impl" if m[1] == "impl" else "class", re.split(r"\s+(?:extends|implements|where)\b|[:(<]", m[2])[0].strip()
        m = _BRACE_FUNCTION.fullmatch(part)
        if m:
            return lo + at, "function", (m["receiver"] or "").strip("() ") or None
    return None


def brace_definitions(text: str, language: str) -> list[Definition]:
    """Definitions in languages with braces, by their heads and matching braces, in one scan.

    Strings and comments are blanked first; text whose braces do not match gives none.
    """
    plain = re.sub(
        r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*(?:`|\Z)|//[^\n]*|/\*.*?(?:\*/|\Z)', lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S
    )
    feeds = [m.start() for m in re.finditer("\n", plain)]
    line = lambda p: bisect_left(feeds, p)
    out: list[Definition] = []
    open_: list[tuple[int, str, str | None, str | None]] = []
    holders: list[str] = []
    since = 0
    for m in re.finditer(r"[{};]", plain):
        if m[0] == "{":
            found = _brace_head(plain, max(since, m.start() - HEAD), m.start())
            start, kind, name = found or (0, "", None)
            holder = name if kind == "function" and language == "go" else holders[-1] if holders else None
            open_.append((start, kind, name, holder))
            if kind in ("class", "impl"):
                holders.append(name or "")
        elif m[0] == "}":
            if not open_:
                return []
            start, kind, name, holder = open_.pop()
            if kind in ("class", "impl"):
                holders.pop()
            if kind in ("class", "function"):
                body = start + len(plain[start : start + HEAD]) - len(plain[start : start + HEAD].lstrip())
                out.append(Definition(line(body), line(m.start()) + 1, kind, holder))
        since = m.end()
    return [] if open_ else sorted(out, key=lambda d: (d.start, d.end))


def chosen_definitions(found: list[Definition]) -> list[Definition]:
    """What lies in a decorated definition goes with it; of nested functions the outer one stays,
    and a class only if it holds no other definition."""

    spans = sorted(set(found), key=lambda d: (d.start, -d.end, d.kind == "class"))
    whole: list[Definition] = []
    reach: list[Definition] = []  # the definitions, not classes, that still enclose the next one
    for d in spans:
        while reach and reach[-1].end <= d.start:
            reach.pop()
        within = any(o.start <= d.start and d.end <= o.end and (o.start, o.end) != (d.start, d.end) for o in reach[-1:])
        if not within:
            whole.append(d)
            if d.kind != "class":
                reach.append(d)
    # Definitions nest: a class holds another one if the next in order ends within it.
    kept = []
    for i, d in enumerate(whole):
        after = whole[i + 1] if i + 1 < len(whole) else None
        holds = after is not None and after.end <= d.end and (after.start, after.end) != (d.start, d.end)
        if d.kind != "class" or not holds:
            kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end))


def definition_spans(text: str, path: str) -> list[tuple[int, int, str]]:
    """Lines (from 0, end exclusive) and container line of each definition; none where the source does not parse."""
    language = model.LANGUAGES.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    try:
        found = python_definitions(text) if language == "python" else brace_definitions(text, language or "") if language not in (None, "ruby") else []
    except (SyntaxError, ValueError, RecursionError, KeyError):
        return []
    mark = "#" if language in ("python", "ruby") else "//"
    return [(d.start, d.end, f"{mark} Class: {d.container}\n" if d.container else "") for d in chosen_definitions(found)]


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        made, errors = [], []
        for path, content in zip(pdf["file_path"], pdf["content"], strict=True):
            try:
                made.append([{"lo": lo, "hi": hi, "head": head} for lo, hi, head in definition_spans(content, path)])
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - the error is the row's result
                made.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield pdf.assign(spans=made, error=errors)


STRATEGIES = ("headings", "whole", "yaml", "ast", "tokens")


def chunk_files(files: DataFrame, limits: model.ChunkLimits | None = None, strategy: str | None = None, count: Counter = X.estimate_tokens) -> DataFrame:
    """One row per chunk of ``files`` (``data_source_id, file_path, content``), with a derived id.

    A null or empty file has no chunks, nor has a blank one. A file that cannot be cut gives one row
    whose ``error`` says why, and no other file is lost. Only files of source code pass a Python
    worker, which finds their definitions.
    """
    limits = limits or model.ChunkLimits()
    how = F.lit(strategy) if strategy else X.chunk_strategy(F.col("file_path"))
    given = files.select(F.col("data_source_id").cast("string").alias("data_source_id"), "file_path", "content", how.alias("how")).where("content != ''")
    kind = "array<struct<lo:int,hi:int,head:string>>"
    plain = given.select("*", F.lit(None).cast(kind).alias("spans"), F.lit(None).cast("string").alias("error"))
    code = lambda rows: rows.mapInPandas(_spans, f"data_source_id string, file_path string, content string, how string, spans {kind}, error string")
    if strategy is None:
        plain = plain.where("how != 'ast'").unionByName(code(given.where("how = 'ast'")))
    elif strategy == "ast":
        plain = code(given)
    text = F.col("content")

    def of(ls: Column) -> Column:
        made = {
            "tokens": lambda: by_tokens(ls),
            "headings": lambda: by_headings(ls, limits),
            "whole": lambda: as_whole(text, ls, F.col("file_path"), limits, count),
            "yaml": lambda: by_yaml_keys(ls, limits),
            "ast": lambda: by_spans(ls, F.col("spans"), limits),
        }
        if strategy:
            return chunked(ls, made[strategy](), limits, count)
        picked = F.when(F.col("how") == "tokens", made["tokens"]())
        for name in ("headings", "whole", "ast"):
            picked = picked.when(F.col("how") == name, made[name]())
        return chunked(ls, picked, limits, count)

    chunks = F.when(F.col("error").isNull(), limited(let(_lines(text), of), limits.max_input_tokens, count)).otherwise(F.array(_chunk(*[F.lit(None).cast(t) for t in ("string", "long", "long", "long")])))
    made = plain.select("data_source_id", "file_path", "error", F.posexplode(chunks).alias("at", "c"))
    ordinal = F.when(F.col("error").isNull(), F.col("at")).cast("long").alias("ordinal")
    rows = made.select("data_source_id", "file_path", ordinal, "c.content", "c.start_line", "c.end_line", "c.token_count", "error")
    key = F.sha2(F.concat_ws("|", "data_source_id", "file_path", "start_line", "end_line", "ordinal"), 256)
    return rows.select(key.alias("chunk_id"), "*")


def heading_sections(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """C02 without Python: one row per heading section, with its lines and estimated tokens.

    For files whose sections fit a chunk; larger ones need ``chunk_files``.
    """
    lines = files.select(*keys, F.posexplode(F.split(content, "\n")).alias("at", "line"))
    order = Window.partitionBy(*keys).orderBy("at")
    section = F.sum(F.when(F.col("line").startswith("#") & (F.col("at") > 0), 1).otherwise(0)).over(order)
    parts = lines.withColumn("section", section).groupBy(*keys, "section").agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts")
    )
    text = F.array_join(F.col("parts.line"), "\n")
    return parts.select(
        *keys,
        F.col("section").cast("long").alias("section"),
        (F.col("parts")[0]["at"] + 1).cast("long").alias("start_line"),
        (F.col("parts")[0]["at"] + F.size("parts")).cast("long").alias("end_line"),
        text.alias("content"),
        X.estimate_tokens(text).alias("token_count"),
    )

