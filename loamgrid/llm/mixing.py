"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. Block j (from 0) of a source of weight w is released at
slot floor(j / w) and due by slot ceil((j + 1) / w); earliest-deadline-first over the released
blocks meets every deadline, so at any slot each source is less than one block away from its share.
Weights are exact: floats are taken as the fractions they are, and j / w is worked out in whole
numbers, so the bound holds however long the mixture is. The driver goes through the blocks once
and holds three numbers for each; rows look up their block's. A block has ``BLOCK_ROWS`` rows, or
so many more that there are about ``MOST_BLOCKS`` of them: what the driver holds does not grow with
the corpus, and the deviation stays below one block.

When a source runs out, a new phase starts with the target weights of those left; every row is
placed exactly once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import count
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sharding import with_slots
from .tables import stored

#: Blocks of a source in one row of the schedule, at most.
QUANTUM = 1000
#: A due slot beyond all others, where a weight is so small that its own does not fit a long.
NEVER = 1 << 60
BLOCK_ROWS, MOST_BLOCKS = 16, 1 << 20


def exact_weights(weights: list[float]) -> list[int]:
    """Whole numbers in the very proportions of ``weights``."""
    parts = [Fraction(w) for w in weights]
    common = lcm(*(p.denominator for p in parts))
    whole = [int(p * common) for p in parts]
    shared = gcd(*whole)
    return [w // shared for w in whole]


def pfair(weights: list[int]) -> Iterator[tuple[int, int, int]]:
    """Source, release and due slot of the block in each slot from 0 on, without end; weights are whole."""
    total = sum(weights)
    done = [0] * len(weights)
    waiting = [(0, s) for s in range(len(weights))]
    ready: list[tuple[int, int, int]] = []
    for t in count():
        while waiting and waiting[0][0] <= t:
            release, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * total // weights[s]), s, release))
        due, s, release = heapq.heappop(ready)
        yield s, release, due
        done[s] += 1
        heapq.heappush(waiting, (done[s] * total // weights[s], s))


@dataclass
class Stretch:
    """A source's blocks ``first`` to ``last`` - 1, of one phase and one chunk of QUANTUM blocks.

    ``pattern``, ``release`` and ``due`` have the slots of each, counted from ``start``.
    """

    source: int
    phase: int
    first: int
    last: int
    start: int
    missing: int
    pattern: list[int]
    release: list[int]
    due: list[int]


def schedule(rows: list[int], weights: list[float], block_rows: int = BLOCK_ROWS) -> list[Stretch]:
    """All stretches, for sources with ``rows`` rows; weights need not sum to one."""
    blocks = [-(-n // block_rows) for n in rows]
    used, start, phase, missing = [0] * len(rows), 0, 0, 0
    out: list[Stretch] = []
    left = [s for s in range(len(rows)) if blocks[s] and weights[s] > 0]
    later = [s for s in range(len(rows)) if blocks[s] and not weights[s] > 0]
    while left or later:
        if not left:
            left, later, weights = later, [], [float(n) for n in rows]
        open_: dict[int, Stretch] = {}
        for t, (i, release, due) in enumerate(pfair(exact_weights([weights[s] for s in left]))):
            s = left[i]
            now = open_.get(s)
            if now is None or used[s] % QUANTUM == 0:
                now = open_[s] = Stretch(s, phase, used[s], used[s], start, missing, [], [], [])
                out.append(now)
            now.pattern.append(t)
            now.release.append(release)
            now.due.append(min(due, NEVER))
            now.last = used[s] = used[s] + 1
            if used[s] == blocks[s]:
                break
        missing += blocks[s] * block_rows - rows[s]
        left.remove(s)
        start += t + 1
        phase += 1
    return out


def tempered(counts: dict, power: float = 0.7) -> dict:
    """Weights that grow as the ``power`` of a source's rows."""
    return {k: float(n) ** power for k, n in counts.items()}


def mix_sources(
    docs: DataFrame, targets: dict[str, float] | None = None, block_rows: int | None = None, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """One row per document, ``row`` (all its columns) and its place in the mixture.

    Columns: ``row``, ``source``, ``block``, ``phase``, ``slot``, ``release``, ``due`` (slots) and
    ``position``, gapless from 0 over all rows. ``targets`` gives each source's weight; without
    it the weights are ``tempered``. Sources without a positive weight follow after all others in
    proportion to their size. Rows of a null source form a source of their own, whose weight is
    ``targets[None]``. Of blocks with equal deadlines the source first in alphabetical order, nulls
    before all, goes first. Order within a source is by a hash of the id, so it is the same for any
    partitioning; rows that repeat are placed one by one. Texts are never looked at, of whatever
    length. ``row`` keeps all columns, whatever their names. An empty table gives an empty result.

    ``block_rows`` is ``BLOCK_ROWS`` or, for more than ``MOST_BLOCKS`` such blocks, so many more.
    """
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source_col).cast("string").alias("s")).count().collect()}
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS))
    wanted = tempered(counts) if targets is None else targets
    names = sorted(counts, key=lambda x: (x is not None, x))
    plan = schedule([counts[x] for x in names], [float(wanted.get(x, 0)) for x in names], block_rows)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(p.source, p.first // QUANTUM, p.phase, p.first, p.last, p.start, p.missing, p.pattern, p.release, p.due) for p in plan],
        "shard int, chunk long, phase int, first long, last long, start long, missing long, pattern array<long>, release array<long>, due array<long>",
    )
    # Stored, so that its size is known and Spark broadcasts it while it is small.
    index = stored(spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, shard int"))
    held = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("source"), F.xxhash64(id_col).alias("spread"))
    ranked = with_slots(held.join(index, F.col("source").eqNullSafe(F.col("name"))).drop("name"), F.col("spread")).withColumnRenamed("slot", "rank")
    block = F.floor(F.col("rank") / block_rows)
    placed = ranked.withColumn("block", block).withColumn("chunk", F.floor(F.col("block") / QUANTUM))
    # Three numbers a block: bounded by MOST_BLOCKS and the number of sources.
    placed = placed.join(F.broadcast(table), ["shard", "chunk"]).where("block >= first AND block < last")
    k = (F.col("block") - F.col("first") + 1).cast("int")
    at = {c: (F.col("start") + F.element_at(c, k)).cast("long") for c in ("pattern", "release", "due")}
    return placed.withColumn("slot", at["pattern"]).select(
        "row",
        "source",
        F.col("block").cast("long").alias("block"),
        "phase",
        "slot",
        at["release"].alias("release"),
        at["due"].alias("due"),
        (F.col("slot") * block_rows + F.col("rank") % block_rows - F.col("missing")).cast("long").alias("position"),
    )


def mixed_documents(
    docs: DataFrame, targets: dict[str, float] | None = None, block_rows: int | None = None, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """``docs`` in the mixture's order: range-partitioned by position and sorted, columns unchanged.

    Handles nulls, ties, repeats, empty tables and clashing names as ``mix_sources`` does.
    """
    placed = mix_sources(docs, targets, block_rows, id_col, source_col).select("row", "position")
    return placed.repartitionByRange("position").sortWithinPartitions("position").select("row.*")
