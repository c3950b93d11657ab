"""Deterministic views of an index: statistics, trees, listings, READMEs and line ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import globs
from ..functions import scalars as X
from .filters import action_file, subtree, tool_binary, workflow_file
from .ranking import numbered

#: The order of names that readers expect: letters before case and accents, digits and punctuation before letters.
LOCALE = "UNICODE"


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """A01"""
    return chunks.groupBy("data_source_id").agg(F.count("*").alias("chunks"))


def file_stats(chunks: DataFrame) -> DataFrame:
    """A02, A06"""
    return chunks.groupBy("data_source_id", "file_path").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def source_stats(chunks: DataFrame, by: list[str]) -> DataFrame:
    """A03"""
    return chunks.groupBy(*by).agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def scan_source(chunks: DataFrame, source: str, condition: Column | None = None) -> DataFrame:
    """The rows of one source, with a condition that reaches the scan."""
    own = chunks.where(F.col("data_source_id") == source)
    return own if condition is None else own.where(condition)


def vector_totals(embeddings: DataFrame, by: list[str]) -> DataFrame:
    """Vectors, and how many widths they have, which is more than one only after an unfinished rebuild."""
    return embeddings.groupBy(*by).agg(F.count("*").alias("vectors"), F.countDistinct(F.size("embedding")).alias("widths"))


def profile(chunks: DataFrame, by: list[str], **counted: Column) -> DataFrame:
    """Sources, files and chunks of each key, and the chunks for which each of ``counted`` holds."""
    return chunks.groupBy(*by).agg(
        F.countDistinct("data_source_id").alias("sources"), F.countDistinct("data_source_id", "file_path").alias("files"), F.count("*").alias("chunks"),
        *[F.count_if(c).alias(name) for name, c in counted.items()],
    )


def first_chunks(chunks: DataFrame) -> DataFrame:
    """Each file's first chunk."""
    return chunks.groupBy("data_source_id", "file_path").agg(F.min_by("content", F.struct("start_line", "ordinal")).alias("content"))


def reassembled(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Each file's chunks in line order, joined by line feeds."""
    parts = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "content")))
    return chunks.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n").alias("content"))


def source_listing(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every source with its statistics, and whether it is only partly indexed."""
    stats = source_stats(chunks, ["data_source_id"]).withColumnRenamed("data_source_id", "id")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.join(stats, "id", "left").select(*sources.columns, zero("files"), zero("chunks"), zero("tokens"), (F.col("status") != "ready").alias("partial"))


def grouped_sources(sources: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """Sources numbered in a fixed order of types, unknown ones last, by name in locale order within a type.

    ``place`` is found by counted ranges, so no task sorts all sources.
    """
    known = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("type"))
    placed = sources.withColumn("group_order", F.when(known > 0, known).otherwise(len(order) + 1).cast("int"))
    return numbered(placed, [], [F.col("group_order"), F.collate(F.concat_ws("/", "owner", "repo"), LOCALE), F.col(key)], "place")


def workflows(chunks: DataFrame) -> DataFrame:
    """R16"""
    first = first_chunks(chunks.where(workflow_file(F.col("file_path"))))
    return first.select(
        "data_source_id", "file_path", F.coalesce(X.yaml_scalar(F.col("content"), "name"), X.basename(F.col("file_path"))).alias("name"), X.workflow_triggers(F.col("content")).alias("triggers")
    )


def actions(chunks: DataFrame) -> DataFrame:
    """R17"""
    first = first_chunks(chunks.where(action_file(F.col("file_path"))))
    text = F.col("content")
    return first.select(
        "data_source_id",
        "file_path",
        F.coalesce(X.yaml_scalar(text, "name"), X.dirname(F.col("file_path"))).alias("name"),
        X.yaml_scalar(text, "description").alias("description"),
        X.action_inputs(text).alias("inputs"),
    )


def readme(files: DataFrame, by: list[str], scope: str = "") -> DataFrame:
    """The README of a directory: README.md, README.mdx, any README.*, then any spelling."""
    inside = files.where(X.dirname(F.col("file_path")) == scope.strip("/"))
    name, low = X.basename(F.col("file_path")), F.lower(X.basename(F.col("file_path")))
    tier = (
        F.when(name == "README.md", 0).when(name == "README.mdx", 1).when(name.startswith("README."), 2)
        .when(low == "readme.md", 3).when(low == "readme.mdx", 4).when(low.startswith("readme.") | (low == "readme"), 5)
    )
    return inside.where(tier.isNotNull()).groupBy(*by).agg(F.min_by("file_path", F.struct(tier, name)).alias("file_path"))


def line_range(files: DataFrame, start: Column, end: Column, content: str = "content") -> DataFrame:
    """Lines ``start`` to ``end`` of each file, clamped to it."""
    lines = F.split(F.col(content), "\n", -1)
    n = F.size(lines)
    lo = F.greatest(F.lit(1), F.least(start, n))
    hi = F.greatest(lo, F.least(end, n))
    return files.withColumns({"lines": n, "first": lo, "last": hi, "part": F.array_join(F.slice(lines, lo, hi - lo + 1), "\n")})


def fetch_status(files: DataFrame, order: str, most_files: int = 10, most_each: int = 500_000, most_total: int = 2_000_000) -> DataFrame:
    """What a fetch of these files answers for each, in order: the first ``most_files`` within the
    caps are returned. ``part`` holds each file's (sliced) text."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    asked = files.orderBy(order).limit(most_files)
    size = F.length("part")
    fits = asked.withColumn("too_large", size > most_each).withColumn("total", F.sum(F.when(size > most_each, 0).otherwise(size)).over(w))
    return fits.withColumn("status", F.when(F.col("too_large"), "too large").when(F.col("total") > most_total, "over total").otherwise("ok")).drop("too_large")


ASKED = "position int, repository string, file_path string, start_line int, end_line int"


def get_files(files: DataFrame, asked: list[tuple], most_files: int = 10, most_each: int = 500_000, most_total: int = 2_000_000) -> DataFrame:
    """An answer to each file asked for, in order: ``position, repository, file_path, status, lines, first, last, fence, part``.

    ``files`` has ``repository`` (owner/repo), ``file_path`` and ``content``; ``asked`` are tuples of repository,
    path, and first and last line or None. ``status`` is binary, no repository, not found, too large (the
    whole file, also where a part is asked for), over total (the parts so far and the whole file)
    or ok. Sizes are UTF-16 units. Repositories are told apart without case.
    """
    if not asked:
        raise ValueError("ask for one file at least")
    if len(asked) > most_files:
        raise ValueError(f"{len(asked)} files asked for, {most_files} at most")
    spark = files.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i, *a) for i, a in enumerate(asked, 1)], ASKED))  # at most ``most_files`` rows
    own = files.select(F.lower("repository").alias("_repo"), F.col("file_path").alias("_path"), "content")
    repos = {r[0] for r in own.where(F.col("_repo").isin(sorted({a[0].lower() for a in asked}))).select("_repo").distinct().collect()}
    pairs = own.where(F.col("_path").isin(sorted({a[1] for a in asked})))
    found = wanted.join(pairs, (F.lower("repository") == F.col("_repo")) & (F.col("file_path") == F.col("_path")), "left")
    lines = F.split("content", "\n", -1)
    n, first = F.size(lines), F.greatest(F.lit(1), F.coalesce("start_line", F.lit(1)))
    last = F.least(n, F.coalesce("end_line", n))
    sliced = F.when(first <= last, F.array_join(F.slice(lines, F.least(first, n), F.greatest(last - first + 1, F.lit(0))), "\n")).otherwise("")
    known = F.lower("repository").isin(sorted(repos)) if repos else F.lit(False)
    first_status = (
        F.when(tool_binary(F.col("file_path")), "binary").when(~known, "no repository").when(F.col("content").isNull(), "not found").when(X.utf16_units(F.col("content")) > most_each, "too large")
    )
    held = found.select("position", "repository", "file_path", first_status.alias("_status"), n.alias("lines"), first.alias("first"), last.alias("last"), sliced.alias("part"), X.utf16_units(F.col("content")).alias("_raw"))
    sized = F.array_sort(F.collect_list(F.struct("position", "_status", "_raw", X.utf16_units(F.col("part")).alias("_own"))))

    def told(state: Column, x: Column) -> Column:
        status = F.coalesce(x["_status"], F.when(state["total"] + x["_raw"] > most_total, "over total").otherwise("ok"))
        total = state["total"] + F.when(status == "ok", x["_own"]).otherwise(0)
        return F.struct(total.alias("total"), F.concat(state["out"], F.array(F.struct(x["position"].alias("position"), status.alias("status")))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<struct<position:int,status:string>>").alias("out"))
    statuses = held.agg(F.aggregate(sized, start, told, lambda x: x["out"]).alias("out")).select(F.explode("out").alias("x")).select("x.*")
    shown = lambda c: F.when(F.col("status") == "ok", F.col(c)).alias(c)
    fence = F.when(F.col("status") == "ok", X.fence(F.col("file_path"))).alias("fence")
    return held.join(F.broadcast(statuses), "position").select("position", "repository", "file_path", "status", shown("lines"), shown("first"), shown("last"), fence, shown("part"))


def directory_counts(files: DataFrame, by: list[str]) -> DataFrame:
    """Files at or below each directory."""
    parts = F.split("file_path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    deep = files.where(F.size(parts) > 1).select(*by, F.explode(dirs).alias("dir"))
    return deep.groupBy(*by, "dir").agg(F.count("*").alias("files"))


def tree_rows(
    stats: DataFrame, by: list[str], root: str = "", include: list[str] | None = None, exclude: list[str] | None = None, max_depth: int = 5
) -> DataFrame:
    """The lines of each source's file tree, numbered in order.

    ``stats`` has ``file_path`` and ``tokens``. Directories come before files; a directory at the
    deepest level is followed by a line that says how many files it hides. Names are in locale
    order. No recursion: every path gives a row for each of its prefixes, an array of (is file,
    name) per segment orders them, and rows are numbered by counted ranges.
    """
    depth = min(max_depth, 10)
    rel = subtree(stats.withColumn("full_path", F.col("file_path")), root)
    rel = rel.where(globs.path_passes(F.col("file_path"), include or [], exclude or []))
    parts = F.split("file_path", "/")

    def key(names: Column, last_is_file: Column) -> Column:
        return F.transform(names, lambda x, i: F.struct((last_is_file & (i == F.size(names) - 1)).cast("int").alias("f"), F.collate(x, LOCALE).alias("n")))

    leaf = rel.where(F.size(parts) <= depth).select(
        *by,
        key(parts, F.lit(True)).alias("place"),
        (F.size(parts) - 1).alias("level"),
        F.concat(
            F.element_at(parts, -1),
            F.lit(" ["),
            F.concat_ws(
                ", ",
                X.display_extension(F.col("full_path")),
                F.when(F.col("tokens") > 0, F.concat(X.thousands(F.col("tokens")), F.lit(" tokens"))),
                X.flags(F.col("full_path")),
            ),
            F.lit("]"),
        ).alias("line"),
    )
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda i: F.slice(parts, 1, i))
    dirs = rel.where(F.size(parts) > 1).select(*by, F.explode(prefixes).alias("names")).groupBy(*by, "names").agg(F.count("*").alias("files"))
    plural = F.concat(F.col("files").cast("string"), F.when(F.col("files") == 1, " file").otherwise(" files"))
    name, own = F.element_at("names", -1), key(F.col("names"), F.lit(False))
    folder = dirs.select(*by, own.alias("place"), (F.size("names") - 1).alias("level"), F.concat(name, F.lit("/ [dir, "), plural, F.lit("]")).alias("line"))
    hidden = dirs.where(F.size("names") == depth).select(
        *by,
        F.concat(own, F.array(F.struct(F.lit(2).alias("f"), F.collate(F.lit(""), LOCALE).alias("n")))).alias("place"),
        F.size("names").alias("level"),
        F.concat(F.lit("["), plural, F.lit(" not shown — use path: '"), name, F.lit("/' or increase maxDepth]")).alias("line"),
    )
    rows = leaf.unionAll(folder).unionAll(hidden)
    lines = rows.select(*by, "place", F.concat(F.repeat(F.lit("  "), F.col("level")), "line").alias("line"))
    return numbered(lines, by, [F.col("place"), F.col("line")]).select(*by, F.col("row").cast("int").alias("row"), "line")


def page(rows: DataFrame, by: list[str], number: int = 1, size: int = 200) -> DataFrame:
    """One page of numbered rows; a page beyond the last shows the last."""
    size = min(size, 500)
    pages = rows.groupBy(*by).agg(F.ceil(F.max("row") / size).alias("pages"))
    joined = rows.join(pages, by) if by else rows.crossJoin(F.broadcast(pages))
    shown = F.least(F.greatest(F.lit(number), F.lit(1)), F.col("pages"))
    return joined.where((F.col("row") > (shown - 1) * size) & (F.col("row") <= shown * size))
