"""Quality rules: a table of thresholds compiled into one projection, without user functions.

The measures are counts of a text, each an expression over the text, its words or its lines. A
``Rule`` bounds a count, or the ratio of two counts, from below or above. ``compiled`` turns the table
into one struct: each measure is evaluated once a row, the rules are integer comparisons of them, and
no row is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh_name

#: White space that ends a word.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages the corpus holds, English, German, French, Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be this from or by at not an "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es "
    "de la le et les des en un du une que est pour qui dans par plus pas au ce il sur "
    "el los las y del por con una su para al lo como más o pero sus"
).split()
#: Names of the measures, in the order of the result.
OF_WORDS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_repeat_words")
OF_LINES = ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within ``least`` and ``most``; with ``per``, so must ``measure / per`` in thousandths.

    A ratio with nothing below the line holds.
    """

    name: str
    measure: str
    per: str | None = None
    least: int | None = None
    most: int | None = None

    def checks(self, measures: Column) -> list[Column]:
        """The comparisons, of a struct of measures."""
        count = measures[self.measure] * (1000 if self.per else 1)
        unit = measures[self.per] if self.per else F.lit(1)
        low = [] if self.least is None else [count >= unit * self.least]
        return low + ([] if self.most is None else [count <= unit * self.most])

    def terms(self) -> list[str]:
        """The comparisons in SQL."""
        count, unit = (f"1000 * {self.measure}", f"{self.per} * ") if self.per else (self.measure, "")
        low = [] if self.least is None else [f"{count} >= {unit}{self.least}"]
        return low + ([] if self.most is None else [f"{count} <= {unit}{self.most}"])


#: The base, which the other rules only narrow.
BASE = (
    Rule("words", "n_words", least=50),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=500),
)
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", least=2000, most=15000),
    Rule("symbols_to_words", "n_symbols", "n_words", most=100),
    Rule("shouts_to_words", "n_shouts", "n_words", most=100),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("stop_word_ratio", "n_stop_words", "n_words", least=40),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=400),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=300),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column, width: int = 3) -> Column:
    """The number of words that lie in a window of ``width`` words found twice or more.

    Windows are sorted, not compared in pairs, so a text of n words costs n log n.
    """
    held = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
    windows = F.transform(held, lambda w, i: F.struct(F.concat_ws(" ", w, *(F.get(words, i + k) for k in range(1, width))).alias("g"), i.alias("i")))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        own = F.transform(at, lambda p, j: F.least(F.lit(width), F.coalesce(F.get(at, j + 1) - p, F.lit(width))))
        return F.aggregate(own, F.lit(0), lambda total, n: total + n)

    return let(let(F.array_sort(windows), places), covered)


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _of_words(text: Column, words: Column) -> Column:
    length = F.char_length(text)
    counts = (
        F.size(words),
        F.char_length(F.array_join(words, "")),
        length - F.char_length(_without(text, SYMBOLS)),
        F.floor((length - F.char_length(F.replace(text, F.lit("!!"), F.lit("")))) / 2),
        F.size(F.filter(words, lambda w: F.lower(w).isin(sorted(set(STOP_WORDS))))),
        repeated_words(words),
    )
    return F.struct(*(c.cast("long").alias(name) for name, c in zip(OF_WORDS, counts, strict=True)))


def _of_lines(lines: Column) -> Column:
    """Of the lines that hold a word."""
    counts = (
        F.size(lines),
        F.size(lines) - F.size(F.array_distinct(lines)),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*\x{2022}]"))),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*$"))),
    )
    return F.struct(*(c.cast("long").alias(name) for name, c in zip(OF_LINES, counts, strict=True)))


def measured(text: Column) -> Column:
    """A struct of all measures of ``text`` (null: empty)."""

    def both(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(
            F.struct(let(words_of(t), lambda w: _of_words(t, w)).alias("w"), let(lines, _of_lines).alias("l")),
            lambda m: F.struct(*(m["w"][k].alias(k) for k in OF_WORDS), *(m["l"][k].alias(k) for k in OF_LINES)),
        )

    return let(F.coalesce(text, F.lit("")), both)


def _all(terms: list[Column]) -> Column:
    return reduce(and_, terms, F.lit(True))


def compiled(text: Column, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct of the measures of ``text``, ``base_failed``, ``kept``, and ``failed``, the names of the rules broken."""

    def verdict(m: Column) -> Column:
        holds = [(r.name, _all(r.checks(m))) for r in (*base, *rules)]
        return F.struct(
            *(m[k].alias(k) for k in (*OF_WORDS, *OF_LINES)),
            (~_all([h for _, h in holds[: len(base)]])).alias("base_failed"),
            _all([h for _, h in holds]).alias("kept"),
            F.array_compact(F.array(*(F.when(~h, F.lit(name)) for name, h in holds))).alias("failed"),
        )

    return let(measured(text), verdict)


def apply_rules(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, text_col: str = "text", name: str = "rules") -> DataFrame:
    """``docs`` with one column more, the struct of ``compiled``, named ``name`` (lengthened if taken).

    A null or empty text has no words and fails the base. Rows are judged one by one, so repeated
    rows get equal verdicts, null ids are no matter, and other columns pass through whatever their
    names. An empty table gives an empty result. One task holds the words of one text at a time.
    """
    return docs.withColumn(fresh_name(docs, name), compiled(F.col(text_col), base, rules))


def quality_rules(docs: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id as ``doc_id``, every measure, ``base_failed``, ``kept``, and ``failed``, the rules broken joined by commas.

    Nulls, empty texts, repeated rows and empty tables are as in ``apply_rules``; other columns are ignored.
    """
    judged = apply_rules(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), base, rules).select("doc_id", "rules.*")
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.withColumn("failed", F.array_join("failed", ",")).select(*first, *(c for c in judged.columns if c not in first))


def rules_sql(table: str = "documents", base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES) -> str:
    """The same verdicts in plain SQL, with joins and groups in place of array functions."""
    holds = {r.name: " AND ".join(r.terms()) for r in (*base, *rules)}
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    symbols = " + ".join(f"(length(t) - length(replace(t, '{c}', '')))" for c in SYMBOLS)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
x AS (SELECT r, unnest(range(len(ws))) AS i, unnest(ws) AS a FROM w),
y AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM y WHERE c IS NOT NULL),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE times > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines,
  count(*) FILTER (WHERE regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]')) AS n_bullet_lines,
  count(*) FILTER (WHERE regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$')) AS n_ellipsis_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, CAST({symbols} AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_shouts,
  len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
  FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r))
SELECT *, NOT ({" AND ".join(holds[r.name] for r in base)}) AS base_failed, {" AND ".join(holds.values())} AS kept,
  concat_ws(',', {", ".join(f"CASE WHEN NOT ({t}) THEN '{n}' END" for n, t in holds.items())}) AS failed FROM m"""
