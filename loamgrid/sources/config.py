"""Configuration and artefacts as JSON files, in any file system that Spark reaches."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model

VERSION = 1


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_json(spark: SparkSession, path: str) -> Any:
    """None for a file that is missing or no JSON."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    row = spark.read.text(path, wholetext=True).first()
    try:
        return json.loads(row.value) if row else None
    except ValueError:
        return None


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """One JSON document, indented; it takes the old one's place whole."""
    fs, p = _file(spark, path)
    fs.setWriteChecksum(False)  # people edit these files, which a checksum beside them would not survive
    fresh = p.suffix(".new")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, default=str).encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(fresh, p):
        raise OSError(f"{path} could not be written")


def _documents(df: DataFrame) -> list[dict]:
    return [json.loads(r.j) for r in df.select(F.to_json(F.struct(*(F.col(c) for c in df.columns))).alias("j")).collect()]


def write_rows(df: DataFrame, path: str) -> None:
    """A small report's rows as one JSON array."""
    write_json(df.sparkSession, path, _documents(df))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


_NAMES = [c.strip().split(" ", 1)[0] for c in model.SOURCES.split(", ")]


def load(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The sources (``model.SOURCES``) and default excludes of a configuration.

    A missing file gives the defaults: no source. So does a broken one, which is first copied beside
    itself with the ending ``.bak``. A source without a type is general.
    """
    found = read_json(spark, path)
    if not isinstance(found, dict) or not isinstance(found.get("dataSources"), list):
        fs, p = _file(spark, path)
        if fs.exists(p):
            util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
            util.copy(fs, p, fs, p.suffix(".bak"), False, True, spark.sparkContext._jsc.hadoopConfiguration())
        return spark.createDataFrame([], model.SOURCES), list(model.DEFAULT_EXCLUDES)
    rows = [json.dumps({n: s.get(_camel(n), "general" if n == "type" else None) for n in _NAMES}) for s in found["dataSources"]]
    sources = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", model.SOURCES).alias("s")).select("s.*")
    return sources.withColumn("type", F.coalesce("type", F.lit("general"))), found.get("defaultExcludePatterns") or list(model.DEFAULT_EXCLUDES)


def save(sources: DataFrame, path: str, excludes: list[str] | None = None) -> None:
    """A configuration as ``load`` reads it. It is one file that one reader holds, as sources are few."""
    rows = [{_camel(k): v for k, v in r.items()} for r in _documents(sources.select(*_NAMES).orderBy("id"))]
    write_json(sources.sparkSession, path, {"version": VERSION, "dataSources": rows, "defaultExcludePatterns": list(excludes or model.DEFAULT_EXCLUDES)})


SHARED = ["owner", "repo", "branch", "type", "description", "include_patterns", "exclude_patterns", "sync_schedule"]


def shareable(spark: SparkSession, path: str) -> DataFrame | None:
    """The sources of a shared configuration; None unless it has a whole-number version and an array of sources."""
    found = read_json(spark, path)
    valid = isinstance(found, dict) and type(found.get("version")) is int and isinstance(found.get("dataSources"), list)
    if not valid:
        return None
    kinds = ", ".join(c for c in model.SOURCES.split(", ") if c.split(" ", 1)[0] in SHARED or c.startswith("repo_url"))
    names = [c.split(" ", 1)[0] for c in kinds.split(", ")]
    rows = [(json.dumps({n: s.get(_camel(n)) for n in names}),) for s in found["dataSources"]]
    read = spark.createDataFrame(rows, "j string").select(F.from_json("j", kinds).alias("s")).select("s.*")
    return read.withColumn("type", F.coalesce("type", F.lit("general")))
