"""N-gram Jaccard join: MinHash banding proposes, full n-gram sets decide.

Plan
1. One pass over the texts hashes words, n-grams, MinHash values and band keys, and numbers the
   rows. Rows with the same word sequence form one class, found by a pre-aggregated group; the rest
   works on one representative a class, weighted by its number of copies.
2. Representatives are shuffled on their band keys. A bucket is linked as a star to its smallest
   member (a minimum, combined before the shuffle), so a bucket of m members gives m - 1 edges.
3. Connected components of these edges are the only sets in which links can lie. A component that
   fits a tile is verified whole, on full n-gram sets, by blocked matrix products.
4. A larger component never ships its texts more than once. Each member is compared with the
   component's first member and keeps only the n-grams in which the two differ, which is little for
   near copies and loses nothing: with R the first one's set, |A & B| = |R| - |R-A| - |R-B| +
   |(R-A) & (R-B)| + |(A-R) & (B-R)|. Members are laid in tiles by the size of their sets; sets at
   Jaccard t differ in size by a factor of 1 / t at most, so tiles further apart are never paired.
   Each pair of tiles is one group, verified on the differences.

A group sends on only each member's link count and a spanning forest of its links. With 32 bands of
8 rows a pair at Jaccard 0.8 shares a bucket with probability 0.997, at 0.85 0.99996; pairs that
meet only through others of their component are verified too.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .shingles import Permutations, band_keys, distinct_sets, mixed, ngram_hashes, row_slices, sequence_keys, utf8, word_hashes
from .tables import fresh_name, setting, stored, temporary

#: Members of a component that is verified whole, or of the part of one that meets its first member; and bytes of text.
WHOLE_ROWS, WHOLE_BYTES = 256, 16 << 20
#: Members of a tile of a larger component, and bytes of their differences.
TILE_ROWS, TILE_BYTES = 512, 16 << 20
#: Sizes of sets in one bin grow by this factor.
BIN = 1.02
#: Distinct n-grams in one matrix product.
COLUMNS = 4096


def band_shape(threshold: float, recall: float, rows: int = 8) -> int:
    """The fewest bands of ``rows`` rows that reach ``recall`` for a pair at ``threshold``."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))


def _sketch(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perms = Permutations(bands * rows)
        for batch in batches:
            data, edges = utf8(batch.column(1))
            for lo, hi in row_slices(edges):
                words, at = word_hashes(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo])
                one, two = sequence_keys(words, at)
                keys = band_keys(perms.minima(*ngram_hashes(words, at, n)), bands, rows)
                none = np.diff(at) == 0
                offsets = pa.array(np.arange(0, (len(keys) + 1) * bands, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(one.view(np.int64), mask=none),
                        pa.array(two.view(np.int64), mask=none),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64))),
                        batch.column(2).slice(lo, hi - lo),
                        batch.column(3).slice(lo, hi - lo),
                    ],
                    ["id", "k1", "k2", "bands", "n_bytes", "key"],
                )

    return run


def text_key(id_: Column, text: Column) -> Column:
    """Tells rows apart that differ in id or text, letter case aside; null ids count as one."""
    return F.xxhash64(id_, text)


def sketches(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """``id, k1, k2, bands, n_bytes, key, row`` of each row; ``k1`` and ``k2`` are null where the text has no word."""
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    made = given.withColumn("key", text_key(F.col("id"), F.col("text"))).mapInArrow(
        _sketch(n, bands, rows), "id long, k1 long, k2 long, bands array<long>, n_bytes long, key long"
    )
    return made.withColumn("row", F.monotonically_increasing_id())


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n`` vertices by the edges given."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        old = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(old, label):
            break
    return label


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share, by blocked products of their incidence."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[common] = np.arange(len(common))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), np.float32)
    for lo in range(0, len(common), COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((m, min(COLUMNS, len(common) - lo)), np.float32)
        block[owner[i:j], column[i:j] - lo] = 1
        out += block @ block.T
    return out.astype(np.int64)


def _links(pdf: pd.DataFrame, linked: np.ndarray) -> pd.DataFrame:
    """Each member's weighted number of links and the root of its links, for members that have some."""
    left, right = np.nonzero(linked)
    root = _roots(len(pdf), left, right)
    links = linked @ pdf["copies"].to_numpy()
    some, ids = linked.any(axis=1), pdf["id"].to_numpy()
    return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]})


def _sets(texts: pd.Series, n: int) -> list[np.ndarray]:
    words, at = word_hashes(*utf8(pa.array(texts, pa.string())))
    return distinct_sets(*ngram_hashes(words, at, n))


def _jaccard(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return shared / np.maximum(1, sizes[:, None] + sizes[None, :] - shared)


def _verify_whole(n: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped_runs(batches, ["component"]):
            pdf = group.sort_values("id", kind="stable").reset_index(drop=True)
            sets = _sets(pdf["text"], n)
            linked = _jaccard(shared_counts(sets), np.array([len(s) for s in sets])) >= threshold
            np.fill_diagonal(linked, False)
            out = _links(pdf, linked)
            if len(out):
                yield out

    return run


_DIFFERENCE = "component long, id long, copies long, size long, first_size long, missing long, difference array<long>, bin int"


def _differences(n: int):
    """What each member has beyond the component's first one, and what it misses (by other hashes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped_runs(batches, ["component", "part"]):
            first = _sets(group["text"][group["first"]].iloc[:1], n)[0]
            own = group[~group["first"]].reset_index(drop=True)
            if not len(own):
                continue
            sets = _sets(own["text"], n)
            more = [np.setdiff1d(s, first, assume_unique=True) for s in sets]
            less = [np.setdiff1d(first, s, assume_unique=True) for s in sets]
            size = np.array([len(s) for s in sets])
            yield pd.DataFrame(
                {
                    "component": own["component"],
                    "id": own["id"],
                    "copies": own["copies"],
                    "size": size,
                    "first_size": len(first),
                    "missing": [len(x) for x in less],
                    "difference": [np.concatenate([a, mixed(b)]).view(np.int64) for a, b in zip(more, less, strict=True)],
                    "bin": np.floor(np.log(size) / np.log(BIN)).astype(np.int32),
                }
            )

    return run


def _verify_differences(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped_runs(batches, ["component", "lo", "hi"]):
            pdf = group.sort_values("id", kind="stable").reset_index(drop=True)
            missing = pdf["missing"].to_numpy()
            shared = shared_counts([np.asarray(d, np.int64) for d in pdf["difference"]])
            shared += pdf["first_size"].iloc[0] - missing[:, None] - missing[None, :]
            linked = _jaccard(shared, pdf["size"].to_numpy()) >= threshold
            np.fill_diagonal(linked, False)
            if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
                side = pdf["tile"].to_numpy()
                linked &= side[:, None] != side[None, :]
            out = _links(pdf, linked)
            if len(out):
                yield out

    return run


def grouped_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys, whole; the input is partitioned and sorted by the keys."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.ones(len(pdf), bool)
        new[1:] = (pdf[keys].to_numpy()[1:] != pdf[keys].to_numpy()[:-1]).any(axis=1)
        if held:
            new[0] = tuple(held[-1][keys].iloc[-1]) != tuple(pdf[keys].iloc[0])
        starts = np.flatnonzero(new)
        head = pdf.iloc[: starts[0]] if len(starts) else pdf
        if len(head):
            held.append(head)
        for i, s in enumerate(starts):
            if held:
                yield pd.concat(held, ignore_index=True)
            e = starts[i + 1] if i + 1 < len(starts) else len(pdf)
            held = [pdf.iloc[s:e]]
    if held:
        yield pd.concat(held, ignore_index=True)


def tiled(rows: DataFrame, group: str, cell: str, most: int, size: Column, most_size: int, spread: Column) -> DataFrame:
    """Adds ``tile``, numbered within each ``group`` in the order of its cells.

    A tile has about ``most`` rows and ``most_size`` of ``size`` at most. Cells are counted, not
    sorted; one that is larger than a tile is dealt over several by ``spread``.
    """
    cells = rows.groupBy(group, cell).agg(F.greatest(F.count("*") / most, F.sum(size) / most_size).alias("_load"))
    before = F.coalesce(F.sum("_load").over(Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cells = stored(cells.select(group, cell, F.floor(before).alias("_start"), F.ceil("_load").alias("_parts")))
    dealt = rows.join(cells, [group, cell])
    return dealt.withColumn("tile", (F.col("_start") + F.pmod(spread, F.col("_parts"))).cast("long")).drop("_start", "_parts")


_LINKS = "id long, links long, root long"


def verified_links(members: DataFrame, n: int, threshold: float) -> DataFrame:
    """``id, links, root`` of links within candidate components.

    ``members`` has ``id, component, copies, text`` (lower case) and ``n_bytes``; a component is
    named by one of its members.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_bytes").alias("bytes"))
    parts = F.greatest(F.ceil(F.col("m") / WHOLE_ROWS), F.ceil(F.col("bytes") / WHOLE_BYTES), F.lit(1)).cast("int")
    sizes = stored(sizes.select("component", parts.alias("parts")))
    whole = members.join(sizes.where("parts = 1"), "component").select("component", "id", "copies", "text")
    found = whole.repartition("component").sortWithinPartitions("component").mapInPandas(_verify_whole(n, threshold), _LINKS)
    if sizes.where("parts > 1").limit(1).count() == 0:
        return found

    large = members.join(sizes.where("parts > 1"), "component").select("component", "id", "copies", "text", "parts")
    own = large.select("component", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(False).alias("first"), "id", "copies", "text")
    first = large.where("id = component").select(
        "component", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("first"), "id", "copies", "text"
    )
    dealt = own.unionAll(first).repartition("component", "part").sortWithinPartitions("component", "part")
    differences = stored(dealt.mapInPandas(_differences(n), _DIFFERENCE))
    laid = stored(tiled(differences, "component", "bin", TILE_ROWS, 8 * F.size("difference") + 64, TILE_BYTES, F.xxhash64("id")).drop("bin"))
    ranges = stored(laid.groupBy("component", "tile").agg(F.min("size").alias("low"), F.max("size").alias("high")))
    a, b = ranges.alias("a"), ranges.alias("b")
    near = (F.col("b.tile") >= F.col("a.tile")) & (F.col("b.low") * threshold <= F.col("a.high")) & (F.col("a.low") * threshold <= F.col("b.high"))
    pairs = stored(a.join(b, "component").where(near).select("component", F.col("a.tile").alias("lo"), F.col("b.tile").alias("hi")))
    sides = pairs.withColumn("tile", F.explode(F.array_distinct(F.array("lo", "hi"))))
    keyed = laid.join(sides, ["component", "tile"]).repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi")
    return found.unionAll(keyed.mapInPandas(_verify_differences(threshold), _LINKS))


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.997,
    rows: int = 8,
) -> DataFrame:
    """Links between rows whose word ``n``-gram sets have a Jaccard similarity of ``threshold`` or more.

    One row per input row: ``id_col``; ``copy_id``, the smallest id with the same word sequence;
    ``n_copies``, rows of that class; ``n_links``, other rows linked directly, copies counted;
    ``class_id``, the smallest id reachable by links; ``kept``, whether it is that row's own id.

    Other columns are ignored, whatever their names. Null, empty or wordless texts link with
    nothing and are their own class. Texts of any length are compared whole. Rows with a null id
    count as links and copies but name no class and are never ``kept``; a class of such rows alone
    has a null name. Rows that repeat an id are rows of their own, equal or not. An empty table
    gives an empty result.
    """
    sig = stored(sketches(docs, id_col, text_col, n, band_shape(threshold, recall, rows), rows))
    return named_links(linked_sketches(sig, docs, id_col, text_col, n, threshold)).select(
        F.col("id").alias(id_col), "copy_id", "n_copies", "n_links", "class_id", "kept"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each class the smallest id stays.

    Null ids come after all others. Of rows with the same id and text one stays; rows that only
    share their id are told apart by their text. Rows without words (null texts too) all stay. An
    empty table gives an empty one.
    """
    sig = stored(sketches(docs, id_col, text_col, n, band_shape(threshold, 0.997, 8), 8))
    shared = stored(linked_sketches(sig, docs, id_col, text_col, n, threshold).where("links > 0").select("row", "id", "key", "component"))
    order = F.struct(F.col("id").isNull(), "id", "row")
    kept = stored(shared.groupBy("component").agg(F.min_by("key", order).alias("key")).select("key"))
    gone = stored(shared.select("key").distinct().join(kept, "key", "left_anti"))
    again = stored(shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key").join(kept, "key", "left_semi"))

    key = fresh_name(docs, "text_key")
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.withColumn(key, text_key(F.col(id_col).cast("long"), text))
    out = keyed.join(gone, F.col(key) == gone["key"], "left_anti")
    if again.limit(1).count():
        # Rows that repeat, id and text: only they are brought together.
        single, repeated = (out.join(again, F.col(key) == again["key"], how) for how in ("left_anti", "left_semi"))
        out = single.unionByName(repeated.dropDuplicates([key]))
    return out.drop(key)


def runtime_filters(spark: SparkSession) -> AbstractContextManager[None]:
    """Lets Spark filter the large side of a shuffled join by a Bloom filter of the small one.

    Spark itself bounds the filter's size and leaves it out where the small side is too large.
    """
    return setting(spark, "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")


def linked_sketches(sig: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """The join itself, from stored ``sig`` (as ``sketches`` gives) and the texts.

    One row per row of ``sig``: its ``row``, ``id`` and ``key``; ``rep``, the first row of its word
    sequence; ``copies``, rows of it; ``links``, other rows linked; ``component``, the smallest row
    reachable by links. Rows without words are alone.
    """
    with temporary() as held:
        classes = held(sig.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count("*").alias("copies")))
        with temporary() as brief:
            reps = brief(sig.join(classes, ["k1", "k2"]).where("row = rep").select("rep", "copies", "bands", "key", "n_bytes"))
            keys = reps.select("rep", F.explode("bands").alias("band"))
            buckets = brief(keys.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("band", "low"))
            with runtime_filters(sig.sparkSession):
                edges = brief(keys.join(buckets.where("low >= 0"), "band").where("rep != low").select(F.col("rep").alias("a"), F.col("low").alias("b")))
            near = connected_components(edges)
            named = held(near.join(reps.select(F.col("rep").alias("id"), "copies", "key", "n_bytes"), "id"))

        text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
        texts = docs.select(text_key(F.col(id_col).cast("long"), text).alias("key"), text.alias("text"))
        with temporary() as brief:
            with runtime_filters(sig.sparkSession):
                members = brief(texts.join(named.where("copies > 0"), "key").dropDuplicates(["id"]).drop("key"))
            found = held(verified_links(members, n, threshold))
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
        about = stored(
            classes.join(links.withColumnRenamed("id", "rep"), "rep", "left")
            .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
            .select("k1", "k2", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
        )
    return sig.select("row", "id", "key", "k1", "k2").join(about, ["k1", "k2"], "left").select(
        "row",
        "id",
        "key",
        F.coalesce("rep", "row").alias("rep"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("links"),
        F.coalesce("component", "row").alias("component"),
    )


def named_links(about: DataFrame) -> DataFrame:
    """``row, id, copy_id, n_copies, n_links, class_id, kept`` from ``linked_sketches``: classes named by their smallest id.

    Only rows with copies or links need a look at others; the rest name themselves.
    """
    about = stored(about)
    shared = about.where("links > 0")
    # Least ids of word sequences first: few rows are left for the least ids of components.
    reps = stored(shared.groupBy("rep").agg(F.min("id").alias("copy_id"), F.min("component").alias("component")))
    names = reps.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    named = reps.join(names, "component").select("rep", "copy_id", "class_id", F.lit(True).alias("named"))
    out = about.join(named, "rep", "left")
    own = lambda c: F.when(F.col("named"), F.col(c)).otherwise(F.col("id")).alias(c)
    kept = F.coalesce(F.when(F.col("named"), F.col("class_id")).otherwise(F.col("id")) == F.col("id"), F.lit(False))
    return out.select("row", "id", own("copy_id"), F.col("copies").alias("n_copies"), F.col("links").alias("n_links"), own("class_id"), kept.alias("kept"))
