"""Readers of listings, archives, configuration and evaluation fixtures."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import scalars as X


def tree(spark: SparkSession, root: str) -> DataFrame:
    """Path, size and version of every file below ``root``; contents are not read."""
    at = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].split(":", 1)[-1].rstrip("/") + "/"
    return at.select(
        F.regexp_replace(F.substring_index(F.col("path"), base, -1), "^/+", "").alias("file_path"),
        F.col("length").alias("size"),
        F.sha2(F.concat_ws("|", "path", "length", "modificationTime"), 256).alias("sha"),
        F.lit("blob").alias("type"),
    )


def contents(spark: SparkSession, root: str) -> DataFrame:
    """Path and text of every file below ``root``."""
    at = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].split(":", 1)[-1].rstrip("/") + "/"
    return at.select(F.regexp_replace(F.substring_index(F.col("path"), base, -1), "^/+", "").alias("file_path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in pdf[["path", "content"]].itertuples(index=False):
            try:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r|*") as archive:
                    for member in archive:
                        if member.isfile():
                            text = archive.extractfile(member).read().decode("utf-8", "replace")
                            name = member.name.split("/", 1)[-1]
                            yield pd.DataFrame({"archive": [path], "file_path": [name], "content": [text], "size": [member.size], "error": [None]})
            except (tarfile.TarError, OSError, EOFError) as e:
                yield pd.DataFrame({"archive": [path], "file_path": [None], "content": [None], "size": [None], "error": [str(e)]})


def archives(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Files in tar archives, plain or compressed, without the first path component.

    ``wanted`` (``file_path``) keeps only the files listed. A broken archive is a row with its error.
    """
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(
        _members, "archive string, file_path string, content string, size long, error string"
    )
    return found if wanted is None else found.join(wanted.select("file_path"), "file_path", "left_semi")


def directory(files: DataFrame, path: str) -> DataFrame:
    """Entries of one directory, with their type."""
    top = path.strip("/")
    rel = files.where(F.col("file_path").startswith(top + "/") if top else F.lit(True))
    rest = F.substring(F.col("file_path"), len(top) + 2 if top else 1, 1 << 30)
    return rel.select(F.substring_index(rest, "/", 1).alias("name"), F.when(rest.contains("/"), "dir").otherwise("file").alias("type"), "size").groupBy("name", "type").agg(F.sum("size").alias("size"))


def config(spark: SparkSession, path: str) -> DataFrame:
    """Sources of a configuration file; broken files give none, a missing type is general."""
    schema = f"version long, dataSources array<struct<{', '.join(c.replace(' ', ': ', 1) for c in model.SOURCES.split(', '))}>>, _broken string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("multiLine", "true").json(path)
    return rows.where("_broken IS NULL").select(F.explode("dataSources").alias("s")).select("s.*").withColumn("type", F.coalesce("type", F.lit("general")))


def fixtures(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All documents of the files that match, each a JSON array or object."""
    return spark.read.schema(schema).option("multiLine", "true").json(glob)


def export(sources: DataFrame) -> DataFrame:
    """The shareable part of a configuration; excludes only where they differ from the defaults."""
    default = F.array(*[F.lit(x) for x in model.DEFAULT_EXCLUDES])
    own = F.when(F.array_sort("exclude_patterns") != F.array_sort(default), F.col("exclude_patterns"))
    return sources.select("owner", "repo", "branch", "type", "include_patterns", own.alias("exclude_patterns"), "sync_schedule")


def refs(lines: DataFrame, text: str = "ref") -> DataFrame:
    """``owner/repo@branch`` taken apart; the branch is ``main`` if not given."""
    pattern = r"^([^/\s]+)/([^@\s]+)(?:@(\S+))?$"
    part = lambda i: F.regexp_extract(F.trim(F.col(text)), pattern, i)
    return lines.select(text, part(1).alias("owner"), part(2).alias("repo"), F.when(part(3) == "", "main").otherwise(part(3)).alias("branch")).where("owner != ''")


def manifest(files: DataFrame) -> DataFrame:
    """A listing with a version for each file, from its content."""
    return files.select("data_source_id", "file_path", F.coalesce(F.col("size"), F.octet_length("content")).alias("size"), F.sha2("content", 256).alias("sha"), X.extension(F.col("file_path")).alias("ext"))
