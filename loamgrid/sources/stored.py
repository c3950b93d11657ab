"""Tables written once in storage that all executors share, and tables laid out for lookups by id."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session may do without, and gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone when the interpreter ends
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, without lineage, until the interpreter ends."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("parquet.writer.version", "PARQUET_2_0").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a bucket, by default, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 16


def saved_by_id(df: DataFrame, key: str, buckets: int | None = None, name: str | None = None) -> str:
    """Saves ``df`` as a table cut into ``buckets`` by a hash of ``key`` and sorted by it; returns its name.

    A lookup reads the buckets of its ids alone, and a join on ``key`` does not move the table.
    Buckets are as many as the rows demand, if not given. A table without a name of its own goes when
    the interpreter ends.
    """
    spark, own = df.sparkSession, name or f"by_id_{uuid.uuid4().hex}"
    buckets = buckets or max(LEAST_BUCKETS, -(-df.count() // BUCKET_ROWS))
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).saveAsTable(own)
    if name is None:
        atexit.register(_drop, spark, own)
    return own


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def by_ids(spark: SparkSession, name: str, key: str, ids: list) -> DataFrame:
    """The rows of the ids given, from their buckets alone."""
    return spark.table(name).where(F.col(key).isin(list(ids)))


def by_id_table(spark: SparkSession, name: str, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids`` (column ``key``), any number of them; only the ids are shuffled."""
    return spark.table(name).join(ids.select(key).distinct(), key, "left_semi")


def without_ids(spark: SparkSession, name: str, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is not in ``ids``."""
    return spark.table(name).join(ids.select(key).distinct(), key, "left_anti")


def ids_where(spark: SparkSession, name: str, key: str, condition: Column) -> DataFrame:
    """Ids alone of the rows of a source, a file or any other condition; no other column is read but the condition's."""
    return spark.table(name).where(condition).select(key)
