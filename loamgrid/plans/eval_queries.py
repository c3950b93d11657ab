"""Queries of the relevance evaluation: vectors as queries, equal labels as judgements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluation as ev
from ..operators import vector
from ..sources import bridge
from ..sources.bridge import table
from .registry import Queries
from .search_queries import DISTANCE

query = Queries()
#: Every hundredth vector is a query against all; rows of its label are relevant, by a grade of 1 to 3.
EVAL_SQL = f"""q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 100 = 0),
near AS (SELECT q.vec_id AS query_id, e.vec_id AS item, {DISTANCE} AS dist FROM embeddings e, q WHERE e.vec_id <> q.vec_id),
r1 AS (SELECT 'exact' AS mode, query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY dist, item) AS rank FROM near QUALIFY rank <= 10),
r2 AS (SELECT 'late' AS mode, query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r1 WHERE rank > 2),
ranked AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2),
qrels AS (SELECT q.vec_id AS query_id, e.vec_id AS item, 1 + e.vec_id % 3 AS grade FROM embeddings e JOIN q ON e.label = q.label AND e.vec_id <> q.vec_id),
hits AS (SELECT r.*, coalesce(grade, 0) AS grade FROM ranked r LEFT JOIN qrels USING (query_id, item)),
per AS (SELECT mode, query_id, sum(CASE WHEN grade > 0 AND rank <= 1 THEN 1 ELSE 0 END) AS h1, sum(CASE WHEN grade > 0 AND rank <= 3 THEN 1 ELSE 0 END) AS h3, sum(CASE WHEN grade > 0 AND rank <= 5 THEN 1 ELSE 0 END) AS h5,
  sum(CASE WHEN grade > 0 AND rank <= 10 THEN 1 ELSE 0 END) AS h10, coalesce(1.0 / min(CASE WHEN grade > 0 THEN rank END), 0) AS mrr_10,
  sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg, max(CASE WHEN grade > 0 AND rank <= 5 THEN 1 ELSE 0 END) AS success_5 FROM hits GROUP BY 1, 2),
ideal AS (SELECT query_id, sum(CASE WHEN place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) ELSE 0 END) AS ideal, count(*) AS relevant
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, item) AS place FROM qrels) GROUP BY 1),
m AS (SELECT mode, query_id, h1 / greatest(coalesce(relevant, 0), 1) AS recall_1, h3 / greatest(coalesce(relevant, 0), 1) AS recall_3, h5 / greatest(coalesce(relevant, 0), 1) AS recall_5,
  h10 / greatest(coalesce(relevant, 0), 1) AS recall_10, mrr_10, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg_10, success_5 FROM per LEFT JOIN ideal USING (query_id))"""
ROUNDED = ", ".join(f"round({x}, 6) AS {x}" for x in ev.METRICS[:-1]) + ", success_5"
MEANS = ", ".join(f"round(avg({x}), 6) AS {x}" for x in ev.METRICS)


def ranked(spark, d):
    emb = bridge.embeddings(spark, d).select("chunk_id", "embedding")
    queries = emb.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    found = vector.knn_batch(emb, queries, 11).where("query_id <> chunk_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    first = found.select("query_id", F.col("chunk_id").alias("item"), rank.alias("rank")).where("rank <= 10")
    late = first.where("rank > 2").withColumn("rank", F.col("rank") - 2)
    return first.withColumn("mode", F.lit("exact")).unionByName(late.withColumn("mode", F.lit("late")))


def qrels(spark, d):
    emb = bridge.embeddings(spark, d).select("chunk_id", "data_source_id")
    queries = emb.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "data_source_id")
    return emb.join(queries, "data_source_id").where("chunk_id <> query_id").select("query_id", F.col("chunk_id").alias("item"), (1 + F.col("chunk_id") % 3).alias("grade"))


def metrics(spark, d):
    return ev.query_metrics(ranked(spark, d), qrels(spark, d), ["query_id"], ["mode"], "item")


def rounded(df, names=None):
    return df.withColumns({m: F.round(m, 6) for m in names or ev.METRICS})


@query(f"WITH {EVAL_SQL} SELECT mode, query_id, {ROUNDED} FROM m")
def e01_e04_query_metrics(spark, d):
    return rounded(metrics(spark, d), ev.METRICS[:-1])


@query(f"WITH {EVAL_SQL} SELECT mode, count(*) AS queries, {MEANS} FROM m GROUP BY 1")
def a12_e07_mode_means(spark, d):
    return rounded(ev.means(metrics(spark, d), ["mode"]))


@query(f"""WITH {EVAL_SQL}, v AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 99]) AS intent), x AS (SELECT m.*, (query_id // 100) % 10 AS intent FROM m WHERE mode = 'exact')
SELECT CAST(intent AS BIGINT) AS intent, coalesce(n, 0) AS queries, coalesce(a, 0) AS ndcg_10 FROM v LEFT JOIN (SELECT intent, count(*) AS n, round(avg(ndcg_10), 6) AS a FROM x GROUP BY 1) USING (intent)""")
def a14_grouped_means(spark, d):
    held = metrics(spark, d).where("mode = 'exact'").withColumn("intent", F.floor(F.col("query_id") / 100) % 10)
    values = spark.createDataFrame([(i,) for i in [*range(10), 99]], "intent long")
    return rounded(ev.grouped_means(held, values, "intent", ["ndcg_10"]), ["ndcg_10"])


@query("SELECT event_type, count(*) AS times FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def a15_frequent(spark, d):
    return ev.frequent(table(spark, d, "events"), "event_type", 3)


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 6) AS partial, round(avg(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 6) AS hallucinated FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def a16_a17_rates(spark, d):
    grades = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return rounded(ev.rates(grades, ["lang"], {"exact": good & ~toxic, "partial": good, "hallucinated": toxic}), ["exact", "partial", "hallucinated"])


@query(f"""WITH {EVAL_SQL}, f AS (SELECT mode, query_id, rank, item % 4 AS file FROM ranked)
SELECT mode, query_id, count(DISTINCT CASE WHEN rank <= 5 THEN file END) AS files_5, CAST(sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS BIGINT) - count(DISTINCT CASE WHEN rank <= 5 THEN file END) AS repeats_5,
round((sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) - count(DISTINCT CASE WHEN rank <= 5 THEN file END)) / sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END), 6) AS share_5 FROM f GROUP BY 1, 2""")
def e06_a10_diversity(spark, d):
    held = ranked(spark, d).withColumn("file", F.col("item") % 4)
    return rounded(ev.diversity(held, ["mode", "query_id"], "file", (5,)), ["share_5"])


@query(f"""WITH {EVAL_SQL}, lab AS (SELECT query_id, item FROM qrels WHERE grade = 3 AND query_id % 200 = 0)
SELECT r.query_id, CASE WHEN any_value(n) > 0 THEN CAST(max(CASE WHEN lab.item IS NULL THEN 0 ELSE 1 END) AS DOUBLE) END AS chunk_hit_5 FROM r1 r LEFT JOIN lab USING (query_id, item) LEFT JOIN (SELECT query_id, count(*) AS n FROM lab GROUP BY 1) USING (query_id) WHERE rank <= 5 GROUP BY 1""")
def e05_chunk_hit(spark, d):
    labels = qrels(spark, d).where("grade = 3 AND query_id % 200 = 0")
    return ev.chunk_hit(ranked(spark, d).where("mode = 'exact'"), labels, ["query_id"], "item").withColumn("chunk_hit_5", F.col("chunk_hit_5").cast("double"))


@query(f"WITH {EVAL_SQL} SELECT a.query_id, a.mode AS better, round(a.ndcg_10 - b.ndcg_10, 6) AS gap FROM m a JOIN m b USING (query_id) WHERE a.mode <> b.mode AND a.ndcg_10 > b.ndcg_10")
def j10_e08_mode_gaps(spark, d):
    held = metrics(spark, d)
    one = ev.mode_gaps(held, ["query_id"], "ndcg_10", better="exact", worse="late").withColumn("better", F.lit("exact"))
    two = ev.mode_gaps(held, ["query_id"], "ndcg_10", better="late", worse="exact").withColumn("better", F.lit("late"))
    return one.unionByName(two).select("query_id", "better", F.round("gap", 6).alias("gap"))


@query(f"WITH {EVAL_SQL} SELECT query_id, item, CAST(rank AS INTEGER) AS rank, grade FROM hits WHERE mode = 'exact'")
def j09_judged(spark, d):
    return ev.judged(ranked(spark, d).where("mode = 'exact'"), qrels(spark, d), ["query_id"], "item").select("query_id", "item", "rank", "grade")


@query(f"WITH {EVAL_SQL} SELECT (query_id // 100) % 10 AS intent, round(avg(ndcg_10), 6) AS ndcg_10 FROM m WHERE mode = 'exact' GROUP BY 1 ORDER BY avg(ndcg_10), 1 LIMIT 3")
def t10_weakest(spark, d):
    held = metrics(spark, d).where("mode = 'exact'").withColumn("intent", F.floor(F.col("query_id") / 100) % 10)
    return rounded(ev.weakest(ev.means(held, ["intent"], ["ndcg_10"]), "ndcg_10", 3, "intent"), ["ndcg_10"]).select("intent", "ndcg_10")


@query(f"""WITH {EVAL_SQL}, h AS (SELECT query_id, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS hits FROM hits WHERE mode = 'exact' AND rank <= 5 GROUP BY 1)
SELECT query_id, CASE WHEN relevant >= 2 THEN CAST(greatest(hits - 1, 0) AS DOUBLE) END AS secondary_hits FROM h LEFT JOIN ideal USING (query_id)""")
def a13_e06_secondary_hits(spark, d):
    return ev.secondary_hits(ranked(spark, d).where("mode = 'exact'"), qrels(spark, d), ["query_id"], "item")


@query(f"""WITH {EVAL_SQL} SELECT mode, concat(rpad(mode, 24, ' '), lpad(CAST(count(*) AS VARCHAR), 8, ' '), lpad(printf('%.3f', round(avg(mrr_10), 6)), 10, ' '), lpad(printf('%.3f', round(avg(ndcg_10), 6)), 10, ' ')) AS line FROM m GROUP BY 1""")
def e09_report(spark, d):
    return ev.report_lines(a12_e07_mode_means(spark, d), "mode", ["mrr_10", "ndcg_10"])
