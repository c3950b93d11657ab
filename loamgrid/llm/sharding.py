"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a two-part 64-bit key (hash of the text, hash of the id), so equal texts lie
side by side and even a group that holds a third of all rows can be cut at any of its rows. The
splitters that cut the order into shards of near-equal bytes are found by probing: a round counts,
across all partitions, the exact bytes below each candidate boundary (the cells of a histogram over
the next bits of the key, only inside the cells that still hold a splitter), and the next round
probes finer. Once every splitter is within tolerance, or its cell holds a single row, the rows are
exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import fresh_name, stored

#: Key bits that the first and each later round resolves. A round sends the driver at most
#: 2^FIRST_BITS rows, a later one shards * 2^NEXT_BITS rows, whatever the input's size.
FIRST_BITS, NEXT_BITS = 12, 8
#: Parts of a shard in which slots are counted side by side: so many at least, and one for so many rows.
LANES, LANE_ROWS = 64, 1 << 18

_MIN = -(1 << 63)


@dataclass
class Splitter:
    """Rows whose key (h, g) is not below this one lie at or above the splitter."""

    target: float
    h: int | None = None
    g: int = _MIN
    cell: tuple[str, int | None, int, int] | None = None
    below: int = 0


def _refined(cells: list[tuple[int, int, int]], splitter: Splitter, start: int, part: str, within: int | None, shift: int, tolerance: float) -> None:
    """Moves the splitter to the cell edge next to its target, or marks the cell to probe next."""
    below = start
    for prefix, size, n in cells:
        if below + size < splitter.target:
            below += size
            continue
        near = min((abs(below - splitter.target), prefix), (abs(below + size - splitter.target), prefix + 1))
        edge = near[1] << shift
        if part == "h":
            splitter.h, splitter.g = edge, _MIN
        else:
            splitter.h, splitter.g = within, edge
        splitter.below = below
        done = near[0] <= tolerance or n == 1 or (part == "g" and shift == 0)
        splitter.cell = None if done else (part, within if part == "g" else None, prefix, shift)
        return
    splitter.h, splitter.g, splitter.cell = 1 << 63, _MIN, None


def find_splitters(keys: DataFrame, shards: int, tolerance: float = 0.001) -> list[Splitter]:
    """Splitters of ``keys`` (long ``h``, ``g`` and ``size``) into ``shards`` parts of near-equal size.

    ``tolerance`` is a share of a part's size. A cell with a single row is not cut, so a part may
    be off by one row's size.
    """
    shift = 64 - FIRST_BITS
    found = keys.groupBy(F.shiftright("h", shift).alias("p")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    cells = sorted((r.p, r["size"], r.n) for r in found)
    total = sum(c[1] for c in cells)
    splitters = [Splitter(total * i / shards) for i in range(1, shards)]
    allowed = tolerance * total / shards
    for s in splitters:
        _refined(cells, s, 0, "h", None, shift, allowed)
    while todo := [s for s in splitters if s.cell]:
        part, at = todo[0].cell[0], todo[0].cell[3]
        now = [s for s in todo if (s.cell[0], s.cell[3]) == (part, at)]
        if part == "h" and at > 0:
            step = min(NEXT_BITS, at)
            parents = sorted({s.cell[2] for s in now})
            rows = keys.where(F.shiftright("h", at).isin(parents))
            shift, key = at - step, [F.shiftright("h", at).alias("parent"), F.shiftright("h", at - step).alias("p")]
        else:
            part = "g"
            step = FIRST_BITS if at == 0 and now[0].cell[0] == "h" else min(NEXT_BITS, at)
            top = now[0].cell[0] == "h"
            shift = 64 - step if top else at - step
            hs = sorted({s.cell[2] if top else s.cell[1] for s in now})
            rows = keys.where(F.col("h").isin(hs))
            if not top:
                rows = rows.where(F.concat_ws(":", "h", F.shiftright("g", at)).isin([f"{s.cell[1]}:{s.cell[2]}" for s in now]))
            key = [F.col("h").alias("within"), (F.lit(0) if top else F.shiftright("g", at)).alias("parent"), F.shiftright("g", shift).alias("p")]
        sums = rows.groupBy(*key).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        for s in now:
            if part == "h":
                own, within = [r for r in sums if r.parent == s.cell[2]], None
            else:
                within = s.cell[2] if s.cell[0] == "h" else s.cell[1]
                own = [r for r in sums if r.within == within and (s.cell[0] == "h" or r.parent == s.cell[2])]
            _refined(sorted((r.p, r["size"], r.n) for r in own), s, s.below, part, within, shift, allowed)
    return splitters


def shard_of(splitters: list[Splitter], h: Column, g: Column) -> Column:
    """The number of splitters at or below the key."""
    out = F.lit(0)
    for s in splitters:
        if s.h is None or s.h >= 1 << 63:
            continue
        over = h >= s.h if s.g == _MIN else (h > s.h) | ((h == s.h) & (g >= s.g) if s.g < 1 << 63 else F.lit(False))
        out = out + F.when(over, 1).otherwise(0)
    return out.cast("int")


def with_slots(rows: DataFrame, spread: Column) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each ``shard``.

    Each shard is counted in lanes by the hash ``spread``, as many as its rows demand, so no task
    sorts a whole shard; a lane starts where the lanes before it end.
    """
    lanes = F.greatest(F.lit(LANES), F.ceil(F.count("*") / LANE_ROWS)).cast("int").alias("_lanes")
    # Stored, the lanes (a row for each shard) have a known size, and Spark need not shuffle all rows on the shard to join them.
    laned = rows.join(stored(rows.groupBy("shard").agg(lanes)), "shard").withColumn("_lane", F.pmod(spread, F.col("_lanes")).cast("int"))
    counts = laned.groupBy("shard", "_lane").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_lane", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_lane").orderBy(spread))
    slotted = laned.withColumn("_row", inside).join(starts, ["shard", "_lane"])
    return slotted.withColumn("slot", (F.col("_start") + F.col("_row") - 1).cast("long")).drop("_lane", "_lanes", "_row", "_start")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its key (``h``, ``g``) and ``size``, the text's UTF-8 bytes and 16 more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns(
        {"h": F.xxhash64(text), "g": F.xxhash64(F.col(id_col), F.lit(1)), "size": (F.octet_length(text) + 16).cast("long")}
    )


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> DataFrame:
    """One row per document: its id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: the shards' sizes are near equal, each splitter within ``tolerance`` of a
    shard or one row of its target, so a very long text makes its shard larger by itself alone.
    Null texts count as empty (size 16, CRC 0), null ids are keys like any other, and rows that
    repeat, which tie on the key, get slots of their own. Other columns are ignored, whatever their
    names. An empty table gives an empty result.
    """
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"))
    slim = stored(keyed(docs.select(id_col, text_col), id_col, text_col).select(id_col, "size", crc.alias("text_crc32"), "h", "g"))
    splitters = find_splitters(slim, shards, tolerance)
    placed = with_slots(slim.withColumn("shard", shard_of(splitters, F.col("h"), F.col("g"))), F.xxhash64("g", "h"))
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001) -> str:
    """Writes ``docs`` with all their columns as one folder per shard under ``path``, by the same law and shards.

    Returns the name of the folders' column, ``shard`` unless ``docs`` has a column of that name.
    Rows move once, a shard as several files of about ``LANE_ROWS`` rows.
    """
    keys = stored(keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").select("h", "g", "size"))
    splitters, rows = find_splitters(keys, shards, tolerance), keys.count()
    name, lane = fresh_name(docs, "shard"), fresh_name(docs, "lane")
    h, g = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.xxhash64(F.col(id_col), F.lit(1))
    files = max(1, -(-rows // (shards * LANE_ROWS)))
    placed = docs.withColumns({name: shard_of(splitters, h, g), lane: F.pmod(F.xxhash64(g, h), F.lit(files))})
    placed.repartition(name, lane).drop(lane).write.partitionBy(name).parquet(path)
    return name
