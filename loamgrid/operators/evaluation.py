"""Relevance metrics of ranked results against graded judgements, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEPTHS = (1, 3, 5, 10)
METRICS = ["recall_1", "recall_3", "recall_5", "recall_10", "mrr_10", "ndcg_10", "success_5"]


def judged(ranked: DataFrame, qrels: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Ranked items with their grade, 0 where unjudged."""
    return ranked.join(qrels.select(*keys, item, "grade"), [*keys, item], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def query_metrics(ranked: DataFrame, qrels: DataFrame, keys: list[str], modes: list[str], item: str) -> DataFrame:
    """Recall at 1, 3, 5 and 10, MRR and nDCG at 10 and success at 5, for each mode and query.

    ``ranked`` has ``rank`` from 1; queries that found nothing have zeros if ``ranked`` has a row
    of null item for them.
    """
    hits = judged(ranked, qrels, keys, item)
    hit = F.col("grade") > 0
    found = hits.groupBy(*modes, *keys).agg(
        *[F.sum(F.when(hit & (F.col("rank") <= n), 1).otherwise(0)).alias(f"h{n}") for n in DEPTHS],
        F.coalesce(1 / F.min(F.when(hit & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0)).alias("mrr_10"),
        F.sum(F.when(F.col("rank") <= 10, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.max(F.when(hit & (F.col("rank") <= 5), 1).otherwise(0)).alias("success_5"),
    )
    best = Window.partitionBy(*keys).orderBy(F.desc("grade"), item)
    ideal = (
        qrels.where("grade > 0").withColumn("place", F.row_number().over(best)).groupBy(*keys)
        .agg(F.sum(F.when(F.col("place") <= 10, gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias("ideal"), F.count("*").alias("relevant"))
    )
    joined = found.join(ideal, keys, "left")
    relevant = F.greatest(F.coalesce("relevant", F.lit(0)), F.lit(1))
    ndcg = F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)
    return joined.select(*modes, *keys, *[(F.col(f"h{n}") / relevant).alias(f"recall_{n}") for n in DEPTHS], "mrr_10", ndcg.alias("ndcg_10"), "success_5")


def chunk_hit(ranked: DataFrame, labels: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Whether a labelled chunk is among the first five; null for queries without labels."""
    any_label = labels.groupBy(*keys).agg(F.count("*").alias("labels"))
    hits = ranked.where("rank <= 5").join(labels.select(*keys, item, F.lit(1).alias("hit")), [*keys, item], "left")
    found = hits.groupBy(*keys).agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return found.join(any_label, keys, "left").select(*keys, F.when(F.col("labels") > 0, F.col("hit")).alias("chunk_hit_5"))


def diversity(ranked: DataFrame, keys: list[str], file: str, depths: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Files, repeats and the share of repeats among the first results."""
    out = []
    for n in depths:
        first = F.col("rank") <= n
        files, rows = F.countDistinct(F.when(first, F.col(file))), F.sum(first.cast("long"))
        out += [files.alias(f"files_{n}"), (rows - files).alias(f"repeats_{n}"), F.when(rows > 0, (rows - files) / rows).otherwise(0.0).alias(f"share_{n}")]
    return ranked.groupBy(*keys).agg(*out)


def means(metrics: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """Means over queries; nulls do not count."""
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in names or METRICS])


def grouped_means(metrics: DataFrame, values: DataFrame, by: str, names: list[str] | None = None) -> DataFrame:
    """Means for each listed value, 0 for those without queries."""
    names = names or METRICS
    found = means(metrics, [by], names)
    return values.join(found, by, "left").select(by, F.coalesce("queries", F.lit(0)).alias("queries"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in names])


def frequent(rows: DataFrame, what: str, n: int) -> DataFrame:
    """The ``n`` most frequent values."""
    return rows.where(F.col(what).isNotNull()).groupBy(what).agg(F.count("*").alias("times")).orderBy(F.desc("times"), what).limit(n)


def mode_gaps(metrics: DataFrame, keys: list[str], metric: str, mode: str = "mode", better: str = "hybrid-no-path", worse: str = "hybrid") -> DataFrame:
    """Queries that one mode answers better than another, and by how much."""
    a = metrics.where(F.col(mode) == better).select(*keys, F.col(metric).alias("better"))
    b = metrics.where(F.col(mode) == worse).select(*keys, F.col(metric).alias("worse"))
    return a.join(b, keys).withColumn("gap", F.col("better") - F.col("worse")).where("gap > 0")


def weakest(groups: DataFrame, metric: str, n: int, by: str) -> DataFrame:
    """E08, T10"""
    return groups.orderBy(metric, by).limit(n)


def rates(grades: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    """The share of rows for which each condition holds."""
    return grades.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c.cast("int")).alias(k) for k, c in conditions.items()])


def report_lines(table: DataFrame, by: str, names: list[str] | None = None) -> DataFrame:
    """Each row of a table of means as one line of padded columns with three decimals."""
    names = names or METRICS
    cells = [F.rpad(F.col(by).cast("string"), 24, " "), F.lpad(F.col("queries").cast("string"), 8, " ")]
    return table.select(by, F.concat(*cells, *[F.lpad(F.format_number(F.col(m), 3), 10, " ") for m in names]).alias("line"))


def secondary_hits(ranked: DataFrame, qrels: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Relevant items after the best one among the first five; null for queries with fewer than
    two relevant items, which means do not count."""
    many = qrels.where("grade > 0").groupBy(*keys).agg(F.count("*").alias("relevant"))
    hits = judged(ranked.where("rank <= 5"), qrels, keys, item).groupBy(*keys).agg(F.sum((F.col("grade") > 0).cast("long")).alias("hits"))
    found = F.when(F.col("relevant") >= 2, F.greatest(F.col("hits") - 1, F.lit(0)))
    return hits.join(many, keys, "left").select(*keys, found.cast("double").alias("secondary_hits"))
