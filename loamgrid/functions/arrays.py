"""Iterated functions over arrays, as Column expressions.

Each works within one row, so nothing is shuffled. A loop is an aggregate over a few numbers: prefix sums and
chains double their reach in each round, searches halve their range, so a row of n elements costs n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_POWERS = f"array({', '.join(str(1 << k) for k in range(31))})"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def powers(n: Column) -> Column:
    """1, 2, 4 and so on, as many as ``n`` has binary digits."""
    return F.slice(F.expr(_POWERS), F.lit(1), F.length(F.bin(n)))


def running_sums(xs: Column) -> Column:
    """The sum of each element and all before it."""
    added = lambda s, p: F.transform(s, lambda x, i: x + F.coalesce(F.get(s, i - p), F.lit(0).cast("long")))
    return F.aggregate(powers(F.size(xs)), F.transform(xs, lambda x: x.cast("long")), added)


def last_at_most(sums: Column, bound: Column, lo: Column, hi: Column, steps: Column) -> Column:
    """The last place from ``lo`` to ``hi`` whose element of the ascending ``sums`` is at most ``bound``; ``lo`` if none.

    ``steps`` are falling powers of two, the first at least as large as half the range.
    """
    return F.aggregate(steps, lo, lambda at, p: F.when((at + p <= hi) & (F.get(sums, at + p) <= bound), at + p).otherwise(at))


def chain(following: Column, n: Column) -> Column:
    """0, what follows it, and so on, up to ``n``, which stands for the end; places only grow.

    Round k knows the first 2^k places and, for every place, the one 2^k further on.
    """
    start = F.struct(following.alias("jump"), F.array(F.lit(0)).alias("seen"))

    def doubled(state: Column, _: Column) -> Column:
        further = F.filter(F.transform(state["seen"], lambda i: F.get(state["jump"], i)), lambda i: i < n)
        return F.struct(F.transform(state["jump"], lambda j: F.get(state["jump"], j)).alias("jump"), F.concat(state["seen"], further).alias("seen"))

    return F.aggregate(powers(n), start, doubled, lambda state: state["seen"])


def windows(counts: Column, limit: int, overlap: int) -> Column:
    """Windows over elements with these counts: structs of ``lo``, ``hi`` (exclusive) and ``total``.

    A window takes elements while they fit ``limit``, at least one; the next starts so far back that ``overlap``
    repeats, but always after this one's start. An empty array has one empty window.
    """

    def of_sums(sums: Column) -> Column:
        n = F.size(sums) - 1
        steps = F.reverse(powers(n))
        ends = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(i + 1, last_at_most(sums, F.get(sums, i) + limit, i, n, steps)))

        def following(e: Column, i: Column) -> Column:
            back = last_at_most(sums, F.get(sums, e) - overlap, F.lit(0), e - 1, steps)
            return F.when(e >= n, n).otherwise(let(back, lambda b: F.when(b > i, b).otherwise(e)))

        def of_ends(es: Column) -> Column:
            starts = chain(F.concat(F.transform(es, following), F.array(n)), n)
            return F.transform(starts, lambda s: F.struct(s.alias("lo"), F.get(es, s).alias("hi"), (F.get(sums, F.get(es, s)) - F.get(sums, s)).alias("total")))

        return let(ends, of_ends)

    return let(F.concat(F.array(F.lit(0).cast("long")), running_sums(counts)), of_sums)
