"""File, source and result filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import globs
from ..functions import scalars as X


def by_globs(files: DataFrame, include: list[str], exclude: list[str], path: str = "file_path") -> DataFrame:
    """files that the include globs admit and neither the given nor the default excludes match."""
    return files.where(globs.path_passes(F.col(path), include, [*exclude, *model.DEFAULT_EXCLUDES]))


def by_preset(files: DataFrame, kind: str, path: str = "file_path") -> DataFrame:
    """files that a repository type's preset admits."""
    return by_globs(files, model.PRESETS[kind], [], path)


def eligible(files: DataFrame, path: str = "file_path", size: str = "size") -> DataFrame:
    """files of at most a million bytes with no binary extension."""
    return files.where((F.col(size) <= model.MAX_FILE_BYTES) & ~X.extension(F.col(path)).isin(model.BINARY_EXTENSIONS))


def tool_binary(path: Column) -> Column:
    """F08"""
    return X.extension(path).isin(model.TOOL_BINARY_EXTENSIONS)


def workflow_file(path: Column) -> Column:
    """F09"""
    return path.contains(".github/workflows/") & (path.endswith(".yml") | path.endswith(".yaml"))


def action_file(path: Column) -> Column:
    """F10"""
    return path.rlike(r"(^|/)action\.ya?ml$")


def not_blank(content: Column) -> Column:
    """holds anything but Unicode white space."""
    return content.rlike(r"(?U)\S")


def subtree(files: DataFrame, root: str, path: str = "file_path") -> DataFrame:
    """files at or under ``root``, their paths relative to it."""
    p, top = F.col(path), root.rstrip("/")
    if not top:
        return files
    inside = files.where((p == top) | p.startswith(top + "/"))
    return inside.withColumn(path, F.when(p == top, X.basename(p)).otherwise(F.substring(p, len(top) + 2, 1 << 30)))


def searchable(sources: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """sources that are ready or hold chunks, and are not being deleted."""
    joined = sources.join(chunk_counts.select(F.col("data_source_id").alias("id"), "chunks"), "id", "left")
    return joined.where((F.col("status") != "deleting") & ((F.col("status") == "ready") | (F.coalesce("chunks", F.lit(0)) > 0)))


def in_repository(sources: DataFrame, repository: str, strict: bool = False) -> DataFrame:
    """sources named by ``owner/repo`` or, unless ``strict``, by the bare repository."""
    name = repository.strip().lower()
    full = F.lower(F.concat_ws("/", "owner", "repo")) == name
    return sources.where(full if strict else full | (F.lower("repo") == name))


def due(sources: DataFrame, now: Column, schedule: str = "daily") -> DataFrame:
    """sources of the schedule, not being deleted, never synced or for a daily one 24 hours ago."""
    waiting = F.col("last_synced_at").isNull()
    if schedule == "daily":
        waiting = waiting | (F.col("last_synced_at") <= now - F.expr("INTERVAL 24 HOURS"))
    else:
        waiting = F.lit(True)
    return sources.where((F.col("sync_schedule") == schedule) & (F.col("status") != "deleting") & waiting)


def known_sources(incoming: DataFrame, existing: DataFrame, known: bool = True) -> DataFrame:
    """Incoming sources that exist already (or do not): owner and repository in any case, branch exactly."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({"_o": F.lower("owner"), "_r": F.lower("repo")})

    keys = keyed(existing).select("_o", "_r", "branch").distinct()
    return keyed(incoming).join(keys, ["_o", "_r", "branch"], "left_semi" if known else "left_anti").drop("_o", "_r")


def index_gate(files: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """Files, bytes, estimated tokens, and whether the index is small enough to add unasked."""
    sums = files.groupBy(*by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    tokens = F.ceil(F.col("bytes") / 4).cast("long")
    return sums.withColumn("tokens", tokens).withColumns(
        {"small": (F.col("files") < 1000) & (F.col("bytes") < 10_000_000) & (F.col("tokens") < 500_000), "many_files": F.col("files") > model.MANY_FILES}
    )


def stale_index(meta: dict[str, str], fingerprint: str, width: int) -> bool:
    """the stored vectors come from another provider or width."""
    return meta.get("fingerprint") != fingerprint or int(meta.get("vectors", 0)) > 0 and int(meta.get("width", width)) != width


def patterns_changed(old: Column, new: Column) -> Column:
    """order matters."""
    return ~old.eqNullSafe(new)
