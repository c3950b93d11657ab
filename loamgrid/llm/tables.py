"""Reading the input tables and cutting lineage in storage that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark is local, as in tests, a fresh temporary folder is
    made and named there. A cluster must name one: its executors share no other folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Deletes what ``stored`` wrote to ``path``, once nothing reads it any more."""
    jsc = spark.sparkContext._jsc
    if jsc is None:
        return
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone when the interpreter ends
        return


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The SQL setting ``name`` has ``value`` for a while."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives ``stored`` for tables that nothing reads after the block; their files go with its end."""
    made: list[tuple[SparkSession, str]] = []

    def held(df: DataFrame) -> DataFrame:
        made.append((df.sparkSession, scratch(df.sparkSession)))
        return stored(df, made[-1][1])

    try:
        yield held
    finally:
        for spark, path in made:
            forget(spark, path)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The result has no lineage, so a lost executor costs a re-read and not a recomputation, and a
    join on it starts from a scan, which lets adaptive execution split hot keys. Shuffle files of the
    write go with its end; the table's own when the interpreter ends, or at ``forget`` with the ``path`` given.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    atexit.register(forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def least_hashes(rows: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least values of the hash in ``column``; exact at any size.

    Only hashes are sorted, a bounded number a task. Rows that tie at the bound share their hash.
    """
    bound = rows.select(column).orderBy(column).limit(most).agg(F.max(column)).first()[0]
    return rows.where(F.lit(False)) if bound is None else rows.where(F.col(column) <= bound).limit(most)


def run_of(text: Column, spread: Column, most: int) -> Column:
    """``text``, or of a longer one ``most`` characters from a place that the hash ``spread`` chooses."""
    length = F.char_length(text)
    start = F.pmod(spread, F.greatest(length - most, F.lit(1)).cast("long")).cast("int") + 1
    return F.when(length <= most, text).otherwise(F.substring(text, start, F.lit(most)))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
