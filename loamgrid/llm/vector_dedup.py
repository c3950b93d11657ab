"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors of a label form one class and are compared once, weighted by their number. The
principal axes come from the second moments of a bounded sample; they decide the order of work and
never the result. Each label's vectors are laid out in tiles along the ``TILING`` axes on which they
vary most. Two unit vectors with cosine t are at most sqrt(2 - 2t) apart on any axis, so tiles whose
boxes are further apart on one of these axes are never paired. Within a pair of tiles, products are
accumulated over the leading axes first; by Cauchy-Schwarz what remains is at most the product of
the suffix norms, and a pair of vectors whose bound falls below the threshold is left. Survivors
are decided by the cosine of the given vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import connected_components
from .near_join import _roots, grouped_runs, tiled
from .tables import least_hashes, stored

#: Vectors of a tile, and their bytes.
TILE, TILE_BYTES = 512, 16 << 20
#: Axes along which tiles are laid.
TILING = 3
#: Vectors that the axes are fitted to, at most, and leading components that are turned; others stay as they are.
SAMPLE, TURNED = 4096, 1024
#: Pairs of one gathered product.
GATHER = 1 << 16


def padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def turned(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Coordinates along ``axes`` of the leading components; vectors of another width stay as they are."""
    lead = len(axes)
    if x.shape[1] < lead or not lead:
        return x
    return np.concatenate([x[:, :lead] @ axes, x[:, lead:]], axis=1)


def principal_axes(classes: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Axes as columns, the one with most energy first, and the ``TILING`` of them that vary most.

    They are those of the sample's most common width, up to ``TURNED`` components.
    """
    rows = least_hashes(classes.select("v", F.xxhash64("rep").alias("spread")), "spread", SAMPLE).select("v").toPandas()["v"]
    if not len(rows):
        return np.zeros((0, 0)), [0]
    widths = rows.map(len)
    width = int(widths.mode().iloc[0])
    x = unit_rows(padded(rows[widths == width], width))[:, : min(width, TURNED)]
    _, axes = np.linalg.eigh(x.T @ x)
    axes = np.ascontiguousarray(axes[:, ::-1])
    spread = (x @ axes).var(axis=0)
    return axes, np.argsort(-spread, kind="stable")[:TILING].tolist()


def _laid(axes: np.ndarray, tiling: list[int], reach: float):
    """Adds coordinates ``p`` on the tiling axes and ``cell``, their places in steps of half the reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            width = pdf["v"].map(len).to_numpy()
            p = np.zeros((len(pdf), TILING))
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                at = turned(unit_rows(padded(pdf["v"].iloc[own], w)), axes)
                for k, axis in enumerate(a for a in tiling if a < w):
                    p[own, k] = at[:, axis]
            step = np.clip(np.floor((p + 1) * (2 / reach)), 0, (1 << 20) - 1).astype(np.int64)
            yield pdf.assign(p=list(p), cell=(step[:, 0] << 40) + (step[:, 1] << 20) + step[:, 2])

    return run


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows of ``x`` and ``y`` (given vectors) whose cosine is ``threshold`` or more."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    px, py = turned(x / nx[:, None], axes), turned(y / ny[:, None], axes)
    sx = np.sqrt(np.maximum(0, np.cumsum((px * px)[:, ::-1], axis=1)[:, ::-1]))
    sy = np.sqrt(np.maximum(0, np.cumsum((py * py)[:, ::-1], axis=1)[:, ::-1]))
    width, slack = x.shape[1], 1e-9
    steps = sorted({s for s in (8, 24) if s < width})
    i = j = None
    done, partial = 0, None
    for step in steps:
        if i is None:
            partial = (partial if partial is not None else 0) + px[:, done:step] @ py[:, done:step].T
            alive = partial + np.outer(sx[:, step], sy[:, step]) >= threshold - slack
            if alive.mean() < 0.2:
                i, j = np.nonzero(alive)
                partial = partial[i, j]
        else:
            more = np.empty(len(i))
            for k in range(0, len(i), GATHER):
                a, b = i[k : k + GATHER], j[k : k + GATHER]
                more[k : k + GATHER] = np.einsum("ij,ij->i", px[a, done:step], py[b, done:step])
            partial = partial + more
            alive = partial + sx[i, step] * sy[j, step] >= threshold - slack
            i, j, partial = i[alive], j[alive], partial[alive]
        done = step
    if i is None:
        i, j = np.nonzero(alive) if steps else np.nonzero(np.ones((len(x), len(y)), bool))
    keep = np.empty(len(i), bool)
    for k in range(0, len(i), GATHER):
        a, b = i[k : k + GATHER], j[k : k + GATHER]
        keep[k : k + GATHER] = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= threshold
    return i[keep], j[keep]


def _compare(axes: np.ndarray, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped_runs(batches, ["g", "lo", "hi"]):
            group = group.sort_values("rep", kind="stable").reset_index(drop=True)
            x = padded(group["v"], len(group["v"].iloc[0]))
            if group["lo"].iloc[0] == group["hi"].iloc[0]:
                left, right = linked_pairs(x, x, axes, threshold)
                off = left != right
                left, right = left[off], right[off]
            else:
                first = group["tile"].to_numpy() == group["lo"].iloc[0]
                one, two = np.flatnonzero(first), np.flatnonzero(~first)
                if not len(one) or not len(two):
                    continue
                a, b = linked_pairs(x[one], x[two], axes, threshold)
                left, right = np.concatenate([one[a], two[b]]), np.concatenate([two[b], one[a]])
            if len(left):
                root = _roots(len(group), left, right)
                links = np.bincount(left, weights=group["copies"].to_numpy()[right], minlength=len(group)).astype(np.int64)
                ids, some = group["rep"].to_numpy(), links > 0
                yield pd.DataFrame({"rep": ids[some], "links": links[some], "root": ids[root[some]]})

    return run


def cosine_links(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: its id, ``n_links``, ``component_id`` and ``kept``.

    Two vectors are linked when their labels are equal and not null, their lengths are equal and
    their cosine, in double precision, is ``threshold`` or more; equal vectors always are. Vectors
    that are null, empty or zero, or that hold a null or a non-finite component, and rows with a
    null label link with nothing; they are their own component. Rows with a null id count as links
    but name no component and are never kept; an id that repeats is one row for each repeat. Of
    vectors that tie, the smallest id names the component. Vectors of any width are compared whole.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    v, kind = F.col("v"), vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    own = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), own.alias("v"))
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))
    rows = stored(given.withColumn("usable", usable))
    classes = stored(rows.where("usable").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    axes, tiling = principal_axes(classes.where("rep IS NOT NULL"))

    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    named = classes.where("rep IS NOT NULL").withColumn("g", F.xxhash64("label", F.size("v")))
    element = "float" if single else "double"
    places = named.select("g", "rep", "copies", "v").mapInPandas(
        _laid(axes, tiling, reach), f"g long, rep long, copies long, v array<{element}>, p array<double>, cell long"
    )
    laid = stored(tiled(stored(places), "g", "cell", TILE, F.size("v") * (4 if single else 8), TILE_BYTES, F.xxhash64("rep")).drop("cell"))
    box = [f(F.col("p")[k]).alias(f"{name}{k}") for k in range(TILING) for name, f in (("low", F.min), ("high", F.max))]
    ranges = stored(laid.groupBy("g", "tile").agg(*box))
    cells = F.sequence(F.floor(F.col("low0") / reach), F.floor((F.col("high0") + reach) / reach))
    a = ranges.withColumn("cell", F.explode(cells)).alias("a")
    b = ranges.withColumn("cell", F.floor(F.col("low0") / reach)).alias("b")
    later = (F.col("b.low0") > F.col("a.low0")) | ((F.col("b.low0") == F.col("a.low0")) & (F.col("b.tile") >= F.col("a.tile")))
    for k in range(TILING):
        later = later & (F.col(f"b.low{k}") <= F.col(f"a.high{k}") + reach) & (F.col(f"a.low{k}") <= F.col(f"b.high{k}") + reach)
    lo, hi = F.least("a.tile", "b.tile").alias("lo"), F.greatest("a.tile", "b.tile").alias("hi")
    pairs = stored(a.join(b, ["g", "cell"]).where(later).select("g", lo, hi))
    sides = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("lo", "hi"))))
    found = stored(
        laid.select("g", "tile", "rep", "copies", "v")
        .join(sides, ["g", "tile"])
        .repartition("g", "lo", "hi")
        .sortWithinPartitions("g", "lo", "hi")
        .mapInPandas(_compare(axes, threshold), "rep long, links long, root long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    about = stored(
        classes.join(links, "rep", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    linked = rows.where("usable").join(about, ["label", "v"]).select("id", "n", F.coalesce("c", "id").alias("c"))
    alone = rows.where("NOT usable").select("id", F.lit(0).alias("n"), F.col("id").alias("c"))
    return linked.unionAll(alone).select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_links"),
        F.col("c").alias("component_id"),
        F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept"),
    )
