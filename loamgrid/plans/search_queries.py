"""Queries over vectors, full text and their fusion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as X
from ..model import Tuning
from ..operators import retrieval, textindex, vector
from ..sources import bridge, stored
from ..sources.bridge import FILES_SQL, files, table
from .registry import Queries

query = Queries()
TEXT, K = "the and", 10
DISTANCE = "sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))))"
NEAR = f"SELECT e.vec_id AS chunk_id, e.label, {DISTANCE} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


def chunks(spark, d):
    return files(spark, d).select(
        F.col("doc_id").alias("chunk_id"), "data_source_id", "file_path", "content", F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), F.lit(0).alias("ordinal")
    )


@query(f"SELECT chunk_id, round(distance, 6) AS distance FROM ({NEAR}) ORDER BY distance, chunk_id LIMIT {K}")
def r01_knn(spark, d):
    return vector.knn(bridge.embeddings(spark, d), query_vector(spark, d), K).withColumn("distance", F.round("distance", 6))


@query(f"SELECT chunk_id, round(distance, 6) AS distance FROM ({NEAR}) WHERE label IN (1, 2) ORDER BY distance, chunk_id LIMIT {K}")
def r01_knn_scoped(spark, d):
    return vector.knn(bridge.embeddings(spark, d), query_vector(spark, d), K, F.col("data_source_id").isin(1, 2)).withColumn("distance", F.round("distance", 6))


@query(f"""SELECT query_id, chunk_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {DISTANCE} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DISTANCE}, e.vec_id) AS rank
FROM embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q) WHERE rank <= 5""")
def r01_knn_batch(spark, d):
    emb = bridge.embeddings(spark, d)
    queries = emb.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return vector.knn_batch(emb, queries, 5).withColumn("distance", F.round("distance", 6))


@query("""SELECT e.label, count(*) AS vectors FROM embeddings e WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = e.vec_id AND d.lang = 'en') GROUP BY 1""")
def j03_scoped_vectors(spark, d):
    wanted = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))
    return vector.scoped(bridge.embeddings(spark, d), wanted).groupBy(F.col("data_source_id").alias("label")).agg(F.count("*").alias("vectors"))


TOKENS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
BM25_SQL = f"""{FILES_SQL}, tok AS (SELECT doc_id AS chunk_id, data_source_id, file_path, {TOKENS.format("file_path")} AS p, {TOKENS.format("content")} AS c FROM b_files),
tf AS (SELECT chunk_id, data_source_id, len(p) + len(c) AS d, 5.0 * len(list_filter(p, lambda t: t = 'the')) + len(list_filter(c, lambda t: t = 'the')) AS f0,
  5.0 * len(list_filter(p, lambda t: t = 'and')) + len(list_filter(c, lambda t: t = 'and')) AS f1 FROM tok),
st AS (SELECT count(*) AS n, avg(d) AS mean, count(*) FILTER (WHERE f0 > 0) AS n0, count(*) FILTER (WHERE f1 > 0) AS n1 FROM tf),
bm AS (SELECT chunk_id, data_source_id,
  CASE WHEN ln((n - n0 + 0.5) / (n0 + 0.5)) > 0 THEN ln((n - n0 + 0.5) / (n0 + 0.5)) ELSE 1e-6 END * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * d / mean)) +
  CASE WHEN ln((n - n1 + 0.5) / (n1 + 0.5)) > 0 THEN ln((n - n1 + 0.5) / (n1 + 0.5)) ELSE 1e-6 END * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / mean)) AS bm25
  FROM tf, st WHERE f0 > 0 AND f1 > 0)"""


@query(f"WITH {BM25_SQL} SELECT chunk_id, round(bm25, 9) AS bm25 FROM bm")
def r02_bm25(spark, d):
    return textindex.bm25_scan(chunks(spark, d), TEXT).withColumn("bm25", F.round("bm25", 9))


@query(f"WITH {BM25_SQL} SELECT chunk_id, round(bm25, 9) AS bm25 FROM bm WHERE data_source_id IN ('src1', 'src2')")
def r02_bm25_scoped(spark, d):
    return textindex.bm25_scan(chunks(spark, d), TEXT, scope=F.col("data_source_id").isin("src1", "src2")).withColumn("bm25", F.round("bm25", 9))


@query(f"""WITH {FILES_SQL}, tok AS (SELECT doc_id AS chunk_id, unnest({TOKENS.format("content")}) AS term FROM b_files)
SELECT term, count(DISTINCT chunk_id) AS rows, count(*) AS times FROM tok GROUP BY 1""")
def r02_postings(spark, d):
    postings, _ = textindex.build_index(chunks(spark, d), stemmed=False)
    return postings.where("content_tf > 0").groupBy("term").agg(F.count("*").alias("rows"), F.sum("content_tf").alias("times"))


@query(f"""WITH {BM25_SQL} SELECT 1 AS query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM (SELECT chunk_id, row_number() OVER (ORDER BY bm25 DESC, chunk_id) AS rank FROM bm) WHERE rank <= 10
UNION ALL SELECT 2, chunk_id, CAST(rank AS INTEGER) FROM (
  SELECT chunk_id, row_number() OVER (ORDER BY f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * d / mean)) DESC, chunk_id) AS rank FROM tf, st WHERE f1 > 0) WHERE rank <= 10""")
def r02_bm25_index(spark, d):
    postings, lengths = textindex.build_index(chunks(spark, d), stemmed=False)
    return textindex.bm25_lookup(postings, lengths, {1: TEXT, 2: "and"}, 10, stemmed=False).select(F.col("query_id").cast("int").alias("query_id"), "chunk_id", "rank")


@query(f"""WITH {FILES_SQL} SELECT doc_id, (CASE WHEN contains(file_path, 'src') THEN 1 ELSE 0 END + CASE WHEN contains(file_path, 'app/') THEN 1 ELSE 0 END + CASE WHEN contains(file_path, '_1') THEN 1 ELSE 0 END) / 3.0 AS share FROM b_files""")
def r04_path_relevance(spark, d):
    return files(spark, d).select("doc_id", X.path_relevance("SRC app/ x _1", F.col("file_path")).alias("share"))


FUSED_SQL = f"""{BM25_SQL}, vec AS (SELECT chunk_id, distance, row_number() OVER (ORDER BY distance, chunk_id) AS v_rank FROM (SELECT chunk_id, distance FROM ({NEAR}) ORDER BY distance, chunk_id LIMIT 30)),
fts AS (SELECT chunk_id, bm25, row_number() OVER (ORDER BY bm25 DESC, chunk_id) AS f_rank FROM (SELECT chunk_id, bm25 FROM bm ORDER BY bm25 DESC, chunk_id LIMIT 30)),
fused AS (SELECT chunk_id, distance, bm25, v_rank, f_rank, 1 / CAST(60 + coalesce(v_rank, 31) AS DOUBLE) + 1 / CAST(60 + coalesce(f_rank, 31) AS DOUBLE) AS rrf FROM vec FULL JOIN fts USING (chunk_id)),
hyd AS (SELECT f.*, b.file_path, b.data_source_id, b.content, (CASE WHEN contains(file_path, 'the') THEN 1 ELSE 0 END + CASE WHEN contains(file_path, 'and') THEN 1 ELSE 0 END) / 2.0 AS path_score FROM fused f JOIN b_files b ON b.doc_id = f.chunk_id)"""


@query(f"WITH {FUSED_SQL} SELECT chunk_id, CAST(coalesce(v_rank, 0) AS INTEGER) AS v_rank, CAST(coalesce(f_rank, 0) AS INTEGER) AS f_rank, round(rrf, 9) AS rrf FROM fused")
def j01_r05_fused(spark, d):
    emb, rows = bridge.embeddings(spark, d), chunks(spark, d)
    vec = retrieval.ranked(vector.knn(emb, query_vector(spark, d), 30), [F.col("distance"), F.col("chunk_id")], "v_rank")
    fts = retrieval.ranked(textindex.bm25_scan(rows, TEXT).orderBy(F.desc("bm25"), "chunk_id").limit(30), [F.desc("bm25"), F.col("chunk_id")], "f_rank")
    return retrieval.fuse(vec, fts, 30, Tuning()).select("chunk_id", F.coalesce("v_rank", F.lit(0)).alias("v_rank"), F.coalesce("f_rank", F.lit(0)).alias("f_rank"), F.round("rrf", 9).alias("rrf"))


def found(spark, d, mode="hybrid", top_k=K):
    return retrieval.search(chunks(spark, d), bridge.embeddings(spark, d), TEXT, query_vector(spark, d), top_k, mode)


TOP = "ORDER BY score DESC, coalesce(v_rank, 1 << 30), coalesce(f_rank, 1 << 30) LIMIT 10"


@query(f"WITH {FUSED_SQL} SELECT chunk_id, data_source_id, file_path, round(score, 9) AS score FROM (SELECT *, rrf + 0.15 * path_score AS score FROM hyd) {TOP}")
def r07_hybrid(spark, d):
    return found(spark, d).select("chunk_id", "data_source_id", "file_path", F.round(-F.col("distance"), 9).alias("score"))


@query(f"""WITH {FUSED_SQL} SELECT * FROM (SELECT 'vector-only' AS mode, chunk_id, round(score, 9) AS score FROM (SELECT *, -distance AS score FROM hyd WHERE distance IS NOT NULL) {TOP})
UNION ALL SELECT * FROM (SELECT 'fts-only', chunk_id, round(score, 9) FROM (SELECT *, bm25 AS score FROM hyd WHERE bm25 IS NOT NULL) {TOP})
UNION ALL SELECT * FROM (SELECT 'hybrid-no-path', chunk_id, round(score, 9) FROM (SELECT *, rrf AS score FROM hyd) {TOP})""")
def r06_modes(spark, d):
    out = [found(spark, d, m).select(F.lit(m).alias("mode"), "chunk_id", F.round(-F.col("distance"), 9).alias("score")) for m in retrieval.MODES[:3]]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(f"""WITH {FUSED_SQL} SELECT chunk_id, CAST(coalesce(v_rank, 0) AS INTEGER) AS v_rank, CAST(coalesce(f_rank, 0) AS INTEGER) AS f_rank, round(distance, 6) AS v_distance, path_score, 31 AS missing_rank
FROM (SELECT *, rrf + 0.15 * path_score AS score FROM hyd) {TOP}""")
def r09_diagnostics(spark, d):
    x = found(spark, d).select("chunk_id", "diagnostics.*")
    return x.select("chunk_id", F.coalesce("v_rank", F.lit(0)).alias("v_rank"), F.coalesce("f_rank", F.lit(0)).alias("f_rank"), F.round("v_distance", 6).alias("v_distance"), "path_score", "missing_rank")


LAID_SQL = """laid AS (SELECT l_orderkey AS q, l_suppkey AS data_source_id, l_partkey % 5 AS file_path, l_linenumber AS start_line, l_extendedprice AS distance, CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS chunk_id FROM lineitem),
nth AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY q, data_source_id, file_path ORDER BY distance {0}, file_path, start_line, chunk_id) > 1 THEN 1 ELSE 0 END AS again FROM laid),
pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY again, distance {0}, file_path, start_line, chunk_id) AS INTEGER) AS position FROM nth)"""


def laid(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS q", "l_suppkey AS data_source_id", "l_partkey % 5 AS file_path", "l_linenumber AS start_line", "l_linenumber AS end_line", "l_extendedprice AS distance",
        "l_orderkey * 100 + l_linenumber AS chunk_id",
    )


@query(f"WITH {LAID_SQL.format('ASC')} SELECT q, chunk_id, position, again = 1 AS repeat FROM pos")
def w04_diverse(spark, d):
    return retrieval.diverse(laid(spark, d), ["q"], retrieval.payload_order()).select("q", "chunk_id", "position", "repeat")


@query(f"WITH {LAID_SQL.format('DESC')} SELECT q, chunk_id, position, again = 1 AS repeat FROM pos")
def t04_reference_order(spark, d):
    return retrieval.diverse(laid(spark, d), ["q"], retrieval.payload_order("reference")).select("q", "chunk_id", "position", "repeat")


@query(f"WITH {LAID_SQL.format('ASC')} SELECT q, data_source_id, file_path, position AS file_rank FROM pos WHERE again = 0")
def w05_files_ranked(spark, d):
    return retrieval.files_ranked(laid(spark, d), ["q"], retrieval.payload_order()).select("q", "data_source_id", "file_path", "file_rank")


@query(f"""WITH {FUSED_SQL}, r AS (SELECT *, rrf + 0.15 * path_score AS score FROM hyd), t AS (SELECT * FROM r {TOP}), o AS (SELECT *, row_number() OVER (ORDER BY -score, file_path, chunk_id) AS position FROM t)
SELECT CAST(position AS INTEGER) AS position, chunk_id, CASE WHEN data_source_id = 'src0' THEN 'unknown' ELSE concat('owner/', data_source_id) END AS repository, file_path, round(score, 6) AS score,
CASE WHEN file_path LIKE '.github/%' THEN 'workflow' WHEN file_path LIKE '%action.yml' THEN 'action' WHEN file_path LIKE '%.md' THEN 'documentation' WHEN file_path LIKE '%/package.json' THEN 'config' ELSE 'code' END AS type,
substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 320) AS snippet, (SELECT count(*) FROM t) > 8 AS has_more FROM o WHERE position > 3 AND position <= 8""")
def r10_j07_payload(spark, d):
    names = table(spark, d, "documents").select(F.col("source").alias("id"), F.lit("owner").alias("owner"), F.col("source").alias("repo")).where("id <> 'src0'").distinct()
    return retrieval.payload(found(spark, d), names, 3, 5).drop("start_line", "end_line")


@query("""SELECT l_orderkey AS q, CAST(rank AS INTEGER) AS rank, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS rank FROM lineitem)""")
def w01_ranks(spark, d):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), rank.alias("rank"), "l_linenumber")


_indexes: dict[tuple[str, str, bool], tuple] = {}


def index(spark, d, stemmed=True):
    """Postings and lengths of all files, built once for a session and folder of tables and then read from storage.

    Each file is sorted by term, so a lookup reads the pages of its terms, and a frequent term lies in all files.
    """
    key = (spark.sparkContext.applicationId, d, stemmed)
    if key not in _indexes:
        postings, lengths = textindex.build_index(chunks(spark, d), stemmed=stemmed, carried=["data_source_id"])
        laid = postings.sortWithinPartitions("term", "chunk_id")
        _indexes[key] = stored.written(laid), stored.written(lengths)
    return _indexes[key]


def bm25_sql(counts: list[str], scope: str = "TRUE") -> str:
    """``bm``: scores of rows in which each of ``counts``, expressions over a list of tokens ``x``, is above 0."""
    f = ", ".join(f"5.0 * {c.replace('{x}', 'p')} + {c.replace('{x}', 'c')} AS f{i}" for i, c in enumerate(counts))
    held = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(counts)))
    idf = "CASE WHEN ln((n - n{0} + 0.5) / (n{0} + 0.5)) > 0 THEN ln((n - n{0} + 0.5) / (n{0} + 0.5)) ELSE 1e-6 END"
    part = " + ".join(f"{idf.format(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / mean))" for i in range(len(counts)))
    return f"""tok AS (SELECT doc_id AS chunk_id, data_source_id, {TOKENS.format("file_path")} AS p, {TOKENS.format("content")} AS c FROM b_files),
tf AS (SELECT chunk_id, data_source_id, len(p) + len(c) AS d, {f} FROM tok), st AS (SELECT count(*) AS n, avg(d) AS mean, {held} FROM tf),
bm AS (SELECT chunk_id, data_source_id, {part} AS bm25 FROM tf, st WHERE {" AND ".join(f"f{i} > 0" for i in range(len(counts)))} AND {scope})"""


def among(*words: str) -> str:
    return f"len(list_filter({{x}}, lambda t: t IN ({', '.join(repr(w) for w in words)})))"


def in_turn(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len({{x}})), lambda i: {{x}}[i] = '{a}' AND {{x}}[i + 1] = '{b}'))"


#: The forms in the given texts that share a stem with the query's words.
ER, ON = among("er", "ere", "ered", "eres", "ering", "ers"), among("on", "oned", "ones", "oning", "ons")
PHRASES = {1: ("of_the", [in_turn("of", "the")]), 2: ("the_and of_the", [in_turn("the", "and"), in_turn("of", "the")]), 3: ("that_the to", [in_turn("that", "the"), among("to")])}


def _phrase_sql(number: int) -> str:
    return f"SELECT * FROM (WITH {bm25_sql(PHRASES[number][1])} SELECT {number} AS query_id, chunk_id, round(bm25, 9) AS bm25 FROM bm ORDER BY bm.bm25 DESC, chunk_id LIMIT 20)"


@query(f"WITH {FILES_SQL} " + " UNION ALL ".join(map(_phrase_sql, PHRASES)))
def r03_phrases_index(spark, d):
    hits = textindex.bm25_lookup(*index(spark, d, False), {k: text for k, (text, _) in PHRASES.items()}, 20, stemmed=False)
    return hits.select(F.col("query_id").cast("int").alias("query_id"), "chunk_id", F.round("bm25", 9).alias("bm25"))


@query(f"WITH {FILES_SQL}, {bm25_sql([ER, ON])} SELECT chunk_id, round(bm25, 9) AS bm25 FROM bm ORDER BY bm.bm25 DESC, chunk_id LIMIT 50")
def r02_stemmed_index(spark, d):
    return textindex.bm25_hits(*index(spark, d), "ering Oned", 50).select("chunk_id", F.round("bm25", 9).alias("bm25"))


SCOPE = ("src1", "src2", "src3")
STEMMED = "ering oned src"
def scoped_sql(fetch: int, k: int, weight: float) -> str:
    return f"""{FILES_SQL}, {bm25_sql([ER, ON, among("src", "srcs")], f"data_source_id IN {SCOPE}")},
vec AS (SELECT chunk_id, distance, row_number() OVER (ORDER BY distance, chunk_id) AS v_rank FROM (SELECT chunk_id, distance FROM ({NEAR}) JOIN b_files ON doc_id = chunk_id WHERE data_source_id IN {SCOPE} ORDER BY distance, chunk_id LIMIT {fetch})),
fts AS (SELECT chunk_id, bm25, row_number() OVER (ORDER BY bm25 DESC, chunk_id) AS f_rank FROM (SELECT chunk_id, bm25 FROM bm ORDER BY bm25 DESC, chunk_id LIMIT {fetch})),
fused AS (SELECT chunk_id, v_rank, f_rank, 1 / CAST({k} + coalesce(v_rank, {fetch} + 1) AS DOUBLE) + 1 / CAST({k} + coalesce(f_rank, {fetch} + 1) AS DOUBLE) AS rrf FROM vec FULL JOIN fts USING (chunk_id)),
hyd AS (SELECT f.*, b.file_path, b.data_source_id, rrf + {weight} * (CASE WHEN contains(file_path, 'src') THEN 1 / 3.0 ELSE 0 END) AS score FROM fused f JOIN b_files b ON b.doc_id = f.chunk_id)"""


def indexed(spark, d, top_k, tuning=None):
    """Hybrid search in a scope, stemmed, with keywords from the stored postings."""
    tuning, scope = tuning or Tuning(), F.col("data_source_id").isin(*SCOPE)
    hits = textindex.bm25_hits(*index(spark, d), STEMMED, top_k * tuning.over_fetch, tuning.fts_path_weight, tuning.fts_content_weight, True, None, scope)
    return retrieval.search(chunks(spark, d), bridge.embeddings(spark, d), STEMMED, query_vector(spark, d), top_k, "hybrid", tuning, scope, True, hits)


@query(f"""WITH {scoped_sql(30, 60, 0.15)} SELECT chunk_id, data_source_id, file_path, round(score, 9) AS score FROM hyd ORDER BY hyd.score DESC, coalesce(v_rank, 1 << 30), coalesce(f_rank, 1 << 30) LIMIT 10""")
def r07_stemmed_index(spark, d):
    return indexed(spark, d, 10).select("chunk_id", "data_source_id", "file_path", F.round(-F.col("distance"), 9).alias("score"))


@query(f"""WITH {scoped_sql(40, 10, 0.5)} SELECT chunk_id, round(score, 9) AS score FROM hyd ORDER BY hyd.score DESC, coalesce(v_rank, 1 << 30), coalesce(f_rank, 1 << 30) LIMIT 8""")
def r08_tuned_index(spark, d):
    return indexed(spark, d, 8, Tuning(rrf_k=10, over_fetch=5, path_weight=0.5)).select("chunk_id", F.round(-F.col("distance"), 9).alias("score"))


SCOPE_KEY = ",".join(SCOPE)


@query(f"""WITH {scoped_sql(60, 60, 0.15)}, t AS (SELECT * FROM hyd ORDER BY score DESC, coalesce(v_rank, 1 << 30), coalesce(f_rank, 1 << 30) LIMIT 20),
o AS (SELECT *, row_number() OVER (ORDER BY -score, file_path, chunk_id) AS position, (SELECT count(*) FROM t) AS n FROM t)
SELECT CAST(position AS INTEGER) AS position, chunk_id, CASE WHEN n > position - 1 - (position - 1) % 5 + 5 THEN
  rtrim(translate(base64(encode(concat('{{"query":"{STEMMED}","scopeKey":"{SCOPE_KEY}","offset":', CAST(position - 1 - (position - 1) % 5 + 5 AS VARCHAR), '}}'))), '+/', '-_'), '=') END AS next_cursor
FROM o WHERE position <= 10""")
def r11_r12_pages(spark, d):
    """The first two pages of a search, the second by the first one's cursor."""
    names, out, cursor = table(spark, d, "documents").selectExpr("source AS id", "'owner' AS owner", "source AS repo").distinct(), None, None
    hits = indexed(spark, d, 20)
    for _ in range(2):
        offset = retrieval.decode_cursor(cursor)["offset"] if cursor else 0
        page = retrieval.payload(hits, names, offset, 5)
        cursor = retrieval.encode_cursor(STEMMED, SCOPE_KEY, offset + 5)
        page = page.select("position", "chunk_id", F.when(F.col("has_more"), F.lit(cursor)).alias("next_cursor"))
        out = page if out is None else out.unionByName(page)
    return out
