"""Queries over change sets, manifests, runs, streams' batch forms and the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model


from ..functions import scalars as X
from ..operators import catalog, filters, retrieval, spans
from ..operators import incremental as inc
from ..sources import bridge, readers, stored
from ..sources.bridge import FILES_SQL, NEW_SQL, OLD_SQL, RUNS_SQL, files, table
from ..streaming import ingest
from .registry import Queries

query = Queries()
DELTA_SQL = f"""{FILES_SQL}, {OLD_SQL}, {NEW_SQL}, delta AS (SELECT coalesce(o.data_source_id, n.data_source_id) AS data_source_id, coalesce(o.file_path, n.file_path) AS file_path, o.sha AS old_sha, n.sha AS new_sha,
CASE WHEN o.sha IS NULL THEN 'added' WHEN n.sha IS NULL THEN 'deleted' WHEN o.sha <> n.sha THEN 'modified' ELSE 'unchanged' END AS change
FROM b_old o FULL JOIN b_new n ON o.data_source_id = n.data_source_id AND o.file_path = n.file_path)"""


def delta(spark, d):
    return inc.changes(bridge.old_manifest(spark, d), bridge.new_manifest(spark, d))


@query(f"WITH {DELTA_SQL} SELECT data_source_id, file_path, old_sha, new_sha, change FROM delta")
def d01_delta(spark, d):
    return delta(spark, d)


@query(f"""WITH {DELTA_SQL} SELECT data_source_id, CAST(sum(CASE WHEN change = 'added' THEN 1 ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN change = 'modified' THEN 1 ELSE 0 END) AS BIGINT) AS modified,
CAST(sum(CASE WHEN change = 'deleted' THEN 1 ELSE 0 END) AS BIGINT) AS deleted, CAST(sum(CASE WHEN change <> 'unchanged' THEN 1 ELSE 0 END) AS BIGINT) AS total FROM delta GROUP BY 1""")
def a20_change_counts(spark, d):
    return inc.change_counts(delta(spark, d), ["data_source_id"])


@query(f"WITH {DELTA_SQL} SELECT data_source_id, file_path, sha FROM b_new")
def d02_applied(spark, d):
    """Applying a delta to the old rows gives the new ones."""
    change = delta(spark, d)
    fresh = bridge.new_manifest(spark, d).join(change.where("change IN ('added', 'modified')").select("data_source_id", "file_path"), ["data_source_id", "file_path"], "left_semi")
    cols = ["data_source_id", "file_path", "sha"]
    return inc.applied(bridge.old_manifest(spark, d).select(cols), change, fresh.select(cols))


@query(f"WITH {FILES_SQL}, {OLD_SQL}, {NEW_SQL} SELECT file_path, sha FROM b_old o WHERE NOT EXISTS (SELECT 1 FROM b_new n WHERE n.data_source_id = o.data_source_id AND n.file_path = o.file_path)")
def j05_stale_files(spark, d):
    return inc.without(bridge.old_manifest(spark, d), bridge.new_manifest(spark, d), ["data_source_id", "file_path"]).select("file_path", "sha")


@query("""SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')""")
def k04_delete_vectors(spark, d):
    gone = table(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("chunk_id"))
    return inc.without(bridge.embeddings(spark, d), gone, ["chunk_id"]).select("chunk_id")


@query(f"""WITH {FILES_SQL}, {OLD_SQL}, {NEW_SQL} SELECT coalesce(o.data_source_id, n.data_source_id) AS run_id, coalesce(o.file_path, n.file_path) AS file_path, coalesce(n.sha, o.sha) AS sha, coalesce(n.size, o.size) AS size,
CASE WHEN o.sha IS NULL THEN 'pending' WHEN o.size % 2 = 0 THEN 'completed' ELSE 'failed' END AS status FROM b_old o FULL JOIN b_new n ON o.data_source_id = n.data_source_id AND o.file_path = n.file_path""")
def k05_upsert(spark, d):
    manifest = bridge.old_manifest(spark, d).withColumnRenamed("data_source_id", "run_id").withColumn("status", F.expr("CASE WHEN size % 2 = 0 THEN 'completed' ELSE 'failed' END"))
    return inc.upserted(manifest, bridge.new_manifest(spark, d).withColumnRenamed("data_source_id", "run_id"))


@query("SELECT concat(event_type, '/', CAST(user_id % 50 AS VARCHAR)) AS key, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def k06_last_wins(spark, d):
    return inc.last_wins(table(spark, d, "events").selectExpr("concat(event_type, '/', CAST(user_id % 50 AS STRING)) AS key", "value", "event_id AS seq"))


@query("""SELECT user_id AS id, arg_max(event_type, event_id) AS status, arg_max(CASE WHEN event_type = 'error' THEN props END, CASE WHEN event_type = 'error' THEN event_id END) AS error FROM events GROUP BY 1""")
def k07_folded(spark, d):
    events = table(spark, d, "events").selectExpr("user_id AS id", "event_id AS seq", "event_type AS status", "CASE WHEN event_type = 'error' THEN props END AS error")
    return inc.folded(events, ["id"], ["status", "error"])


@query(f"WITH {RUNS_SQL} SELECT data_source_id, seq, status FROM b_runs QUALIFY row_number() OVER (PARTITION BY data_source_id ORDER BY seq DESC) = 1")
def w02_latest_run(spark, d):
    return inc.latest(bridge.runs(spark, d), ["data_source_id"], ["seq"]).select("data_source_id", "seq", "status")


@query(f"WITH {RUNS_SQL} SELECT data_source_id, seq, status FROM b_runs WHERE status IN ('running', 'failed') QUALIFY row_number() OVER (PARTITION BY data_source_id ORDER BY started_at DESC, seq DESC) = 1")
def w03_reusable_run(spark, d):
    return inc.reusable_runs(bridge.runs(spark, d), ["data_source_id"]).select("data_source_id", "seq", "status")


@query(f"""WITH {RUNS_SQL} SELECT data_source_id, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END)::BIGINT AS completed, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)::BIGINT AS failed,
coalesce(sum(files), 0)::BIGINT AS chunks, coalesce(sum(seq), 0)::BIGINT AS tokens FROM b_runs GROUP BY 1""")
def a04_run_summary(spark, d):
    held = bridge.runs(spark, d).selectExpr("data_source_id", "status", "files AS chunk_count", "seq AS token_count")
    return inc.run_summary(held, ["data_source_id"])


@query(f"WITH {RUNS_SQL} SELECT sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) IS NULL AS no_completed, sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) IS NULL AS no_failed, coalesce(sum(files), 0)::BIGINT AS chunks, coalesce(sum(seq), 0)::BIGINT AS tokens FROM b_runs WHERE seq < 0")
def a04_empty_run(spark, d):
    held = bridge.runs(spark, d).where("seq < 0").selectExpr("data_source_id", "status", "files AS chunk_count", "seq AS token_count")
    return inc.run_summary(held, []).select(F.col("completed").isNull().alias("no_completed"), F.col("failed").isNull().alias("no_failed"), "chunks", "tokens")


@query(f"WITH {RUNS_SQL} SELECT seq, concat('f', CAST(seq AS VARCHAR)) AS file_path FROM b_runs WHERE status <> 'completed'")
def t06_pending(spark, d):
    return inc.pending(bridge.runs(spark, d).selectExpr("seq", "concat('f', CAST(seq AS STRING)) AS file_path", "status")).select("seq", "file_path")


@query("""SELECT c_custkey, sha256(concat('{"commit":"', c_name, '","include":["', c_mktsegment, '"],"exclude":["b","a"]}')) AS run_key FROM customer""")
def d05_run_key(spark, d):
    key = inc.run_key(F.col("c_name"), F.array("c_mktsegment"), F.array(F.lit("b"), F.lit("a")))
    return table(spark, d, "customer").select("c_custkey", key.alias("run_key"))


@query("""WITH RECURSIVE x AS (SELECT source, doc_id, CAST(ceil(n_chars / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents),
f(source, doc_id, stretch, place, n, t, k) AS (
  SELECT source, doc_id, r // 32, r, 1, tokens, 1 FROM x WHERE r % 32 = 0
  UNION ALL SELECT x.source, x.doc_id, f.stretch, x.r,
    CASE WHEN f.n + 1 > 16 OR f.t + x.tokens > 10000 THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n + 1 > 16 OR f.t + x.tokens > 10000 THEN x.tokens ELSE f.t + x.tokens END,
    CASE WHEN f.n + 1 > 16 OR f.t + x.tokens > 10000 THEN f.k + 1 ELSE f.k END
  FROM f JOIN x ON x.source = f.source AND x.r = f.place + 1 AND x.r // 32 = f.stretch),
m AS (SELECT source, stretch, max(k) AS k FROM f GROUP BY 1, 2),
b AS (SELECT source, stretch, coalesce(sum(k) OVER (PARTITION BY source ORDER BY stretch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM m)
SELECT f.source, f.doc_id, CAST(b.start + f.k AS BIGINT) AS batch FROM f JOIN b USING (source, stretch)""")
def d09_request_batches(spark, d):
    rows = table(spark, d, "documents").select("source", "doc_id", F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"))
    return inc.batches(rows, ["source"], "doc_id", first=32, most=16, most_tokens=10_000).select("source", "doc_id", "batch")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN NULL ELSE 'x,y' END AS excludes, CASE WHEN s_nationkey % 2 = 0 THEN 17 ELSE 2 END AS given FROM supplier""")
def k10_export(spark, d):
    default = F.array(*[F.lit(x) for x in reversed(model.DEFAULT_EXCLUDES)])
    held = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("string").alias("owner"), F.col("s_name").alias("repo"), F.lit("main").alias("branch"), F.lit("general").alias("type"), F.array().cast("array<string>").alias("include_patterns"),
        F.when(F.col("s_nationkey") % 2 == 0, default).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("exclude_patterns"), F.lit("daily").alias("sync_schedule"),
    )
    shared = readers.export(held).select("owner", F.array_join("exclude_patterns", ",").alias("excludes"))
    return shared.join(held.select("owner", F.size("exclude_patterns").alias("given")), "owner").select(F.col("owner").cast("long").alias("s_suppkey"), "excludes", "given")


@query("""SELECT c_custkey, regexp_extract(c_name, '^([^#]*)', 1) AS owner, c_mktsegment AS repo, CASE WHEN c_nationkey % 2 = 0 THEN 'main' ELSE concat('b', CAST(c_nationkey AS VARCHAR)) END AS branch FROM customer""")
def j12_refs(spark, d):
    ref = F.concat(F.regexp_extract("c_name", "^([^#]*)", 1), F.lit("/"), "c_mktsegment", F.when(F.col("c_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("@b"), F.col("c_nationkey").cast("string"))))
    held = table(spark, d, "customer").select("c_custkey", ref.alias("ref"))
    return held.join(readers.refs(held.select("ref").distinct()), "ref").select("c_custkey", "owner", "repo", "branch")


@query(f"WITH {FILES_SQL} SELECT data_source_id, file_path, size, sha256(content) AS sha, lower(regexp_extract(file_path, '\\.([^.]*)$', 1)) AS ext FROM b_files")
def s01_manifest(spark, d):
    return readers.manifest(files(spark, d))


@query(f"""WITH {FILES_SQL}, r AS (SELECT DISTINCT string_split(substr(file_path, 5), '/') AS p, size, doc_id FROM b_files WHERE file_path LIKE 'pkg/%')
SELECT p[1] AS name, CASE WHEN len(p) > 1 THEN 'dir' ELSE 'file' END AS type, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY 1, 2""")
def s06_directory(spark, d):
    return readers.directory(files(spark, d), "pkg")


@query(f"WITH {FILES_SQL} SELECT doc_id FROM b_files WHERE data_source_id = 'src3' AND size > 100")
def s12_scan_by_source(spark, d):
    return catalog.scan_source(files(spark, d), "src3", F.col("size") > 100).select("doc_id")


@query(f"WITH {FILES_SQL} SELECT doc_id, data_source_id, file_path, size FROM b_files WHERE doc_id IN (3, 17, 42, 999999)")
def s13_point_lookup(spark, d):
    name = stored.saved_by_id(files(spark, d), "doc_id")
    return stored.by_ids(spark, name, "doc_id", [3, 17, 42, 999999]).select("doc_id", "data_source_id", "file_path", "size")


@query(f"WITH {FILES_SQL} SELECT doc_id, file_path FROM b_files WHERE doc_id IN (SELECT o_orderkey * 7 FROM orders)")
def s13_j02_batch_lookup(spark, d):
    name = stored.saved_by_id(files(spark, d), "doc_id")
    asked = table(spark, d, "orders").select((F.col("o_orderkey") * 7).alias("doc_id"))
    return stored.by_id_table(spark, name, "doc_id", asked).select("doc_id", "file_path")


@query(f"WITH {FILES_SQL} SELECT doc_id, 'source' AS of FROM b_files WHERE data_source_id = 'src3' UNION ALL SELECT doc_id, 'file' FROM b_files WHERE data_source_id = 'src3' AND file_path LIKE 'docs/%'")
def s14_id_projections(spark, d):
    name = stored.saved_by_id(files(spark, d), "doc_id")
    own = F.col("data_source_id") == "src3"
    ids = [stored.ids_where(spark, name, "doc_id", c).withColumn("of", F.lit(of)) for of, c in (("source", own), ("file", own & F.col("file_path").startswith("docs/")))]
    return ids[0].unionAll(ids[1])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def k04_without_ids(spark, d):
    name = stored.saved_by_id(table(spark, d, "embeddings"), "vec_id")
    gone = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"))
    return stored.without_ids(spark, name, "vec_id", gone).select("vec_id", "label")


@query("""SELECT a.l_orderkey, count(*) AS inside FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_quantity <= b.l_quantity AND b.l_quantity + b.l_linenumber <= a.l_quantity + a.l_linenumber * 10 AND a.l_linenumber <> b.l_linenumber GROUP BY 1""")
def j11_containment(spark, d):
    spans = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("s"))
    a = spans.select("l_orderkey", F.col("l_linenumber").alias("i"), F.col("s").alias("start"), (F.col("s") + F.col("l_linenumber") * 10).alias("end"))
    b = spans.select("l_orderkey", F.col("l_linenumber").alias("j"), F.col("s").alias("s2"), (F.col("s") + F.col("l_linenumber")).alias("e2"))
    return a.join(b, "l_orderkey").where("start <= s2 AND e2 <= end AND i <> j").groupBy("l_orderkey").agg(F.count("*").alias("inside"))


HELD = "EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.e >= a.e AND (b.s < a.s OR (b.s = a.s AND (b.e > a.e OR b.n < a.n))))"


@query(f"""WITH s AS (SELECT l_suppkey AS k, row_number() OVER () AS n, l_quantity AS s, l_quantity + l_linenumber % 3 AS e FROM lineitem)
SELECT k, CAST(count(*) AS BIGINT) AS spans, CAST(sum(CASE WHEN {HELD} THEN 0 ELSE 1 END) AS BIGINT) AS outermost FROM s a GROUP BY 1""")
def j11_c07_outermost(spark, d):
    held = table(spark, d, "lineitem").selectExpr("l_suppkey AS k", "l_quantity AS s", "l_quantity + l_linenumber % 3 AS e")
    return spans.with_containment(held, ["k"], "s", "e").groupBy("k").agg(F.count("*").alias("spans"), F.count_if(~F.col("contained")).alias("outermost"))


@query(f"WITH {FILES_SQL}, {OLD_SQL}, {NEW_SQL} SELECT n.data_source_id, n.file_path, CASE WHEN o.sha IS NULL THEN 'added' ELSE 'modified' END AS change FROM b_new n LEFT JOIN b_old o USING (data_source_id, file_path) WHERE o.sha IS NULL OR o.sha <> n.sha")
def u02_fetch_set(spark, d):
    return inc.fetch_set(inc.changes(bridge.old_manifest(spark, d), bridge.new_manifest(spark, d)))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE label = 1 UNION SELECT doc_id FROM documents WHERE lang = 'en'")
def u01_candidates(spark, d):
    near = table(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("chunk_id"))
    return retrieval.candidate_union([near, table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"))])


@query("SELECT user_id AS data_source_id, count(*) AS seen, CAST(sum(CASE WHEN event_type NOT IN ('error', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS done FROM events GROUP BY 1")
def st4_progress(spark, d):
    return ingest.progress(bridge.runs(spark, d))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_windowed_counts(spark, d):
    out = ingest.windowed_counts(table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY 1, 2""")
def ext_sessions(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    fresh = F.when(gap <= 30 * 60 * 1_000_000, 0).otherwise(1)
    marked = table(spark, d, "events").withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w))
    return marked.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def ext_star_pricing(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    price = F.col("l_extendedprice")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_price"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n")
    )


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def ext_star_local_suppliers(spark, d):
    t = lambda name: table(spark, d, name)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    local = lines.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    named = local.join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT label, count(*) AS vectors, count(DISTINCT len(embedding)) AS widths FROM embeddings GROUP BY 1")
def a05_total_vectors(spark, d):
    return catalog.vector_totals(table(spark, d, "embeddings"), ["label"])


@query("""SELECT lang, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(ceil(sum(n_chars) / 4.0) AS BIGINT) AS tokens, CASE WHEN ceil(sum(n_chars) / 4.0) / 1e6 * 0.13 < 0.01 THEN '<$0.01' ELSE printf('$%.2f', ceil(sum(n_chars) / 4.0) / 1e6 * 0.13) END AS cost,
format('{:,}', CAST(ceil(sum(n_chars) / 4.0) AS BIGINT)) AS shown FROM documents GROUP BY 1""")
def a19_cost_estimate(spark, d):
    sums = filters.index_gate(table(spark, d, "documents"), ["lang"], "n_chars")
    return sums.select("lang", "bytes", "tokens", X.cost(F.col("tokens"), F.lit(0.13)).alias("cost"), X.thousands(F.col("tokens")).alias("shown"))


@query("""SELECT s_suppkey, s_nationkey % 3 <> 0 AS changed, s_nationkey % 3 = 2 AS custom FROM supplier""")
def f20_u05_patterns(spark, d):
    given = F.when(F.col("s_nationkey") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("s_nationkey") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("c")))
    held = table(spark, d, "supplier").withColumn("given", given)
    default = F.array(F.lit("a"), F.lit("b"))
    return held.select("s_suppkey", filters.patterns_changed(default, F.col("given")).alias("changed"), X.custom_patterns(F.col("given"), ["a", "b"]).alias("custom"))


@query("""SELECT n_nationkey, concat('docs/', n_name) AS scope, concat(n_name, '|x') AS patterns, concat('sync · ', n_name) AS message, CASE n_nationkey % 2 WHEN 0 THEN 3072 ELSE 1536 END AS width, 'a,b' AS scope_key FROM nation""")
def x15_x16_x22_x25_u04_texts(spark, d):
    name = F.col("n_name")
    which = F.when(F.col("n_nationkey") % 2 == 0, "text-embedding-3-large").otherwise("other")
    return table(spark, d, "nation").select(
        "n_nationkey",
        X.readme_scope(F.concat(F.lit("/docs/"), name, F.lit("//"))).alias("scope"),
        F.array_join(X.split_patterns(F.concat(F.lit(" "), name, F.lit(" ,, x"))), "|").alias("patterns"),
        X.stage_error(F.lit("sync"), F.lit(None).cast("string"), name).alias("message"),
        X.model_width(which).alias("width"),
        X.scope_key(F.array(F.lit("b"), F.lit("a"))).alias("scope_key"),
    )


@query(f"""WITH {FILES_SQL}, {OLD_SQL}, {NEW_SQL} SELECT data_source_id, file_path FROM b_new n WHERE NOT EXISTS (SELECT 1 FROM b_old o WHERE o.data_source_id = n.data_source_id AND o.file_path = n.file_path AND o.sha = n.sha AND o.size % 2 = 0)""")
def d03_d06_resumed(spark, d):
    manifest = bridge.old_manifest(spark, d).withColumn("status", F.expr("CASE WHEN size % 2 = 0 THEN 'completed' ELSE 'failed' END"))
    return inc.resumed(bridge.new_manifest(spark, d), manifest, ["data_source_id", "file_path"]).select("data_source_id", "file_path")


@query("""WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'deleting' WHEN 'purchase' THEN 'ready' ELSE 'syncing' END AS status FROM events),
b AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY user_id ORDER BY event_id), 'pending') AS before FROM e)
SELECT event_id, before, status, before = status OR (before = 'pending' AND status IN ('syncing', 'deleting')) OR (before = 'syncing' AND status IN ('ready', 'error', 'deleting')) OR (before IN ('ready', 'error') AND status IN ('syncing', 'deleting'))
OR (before = 'deleting' AND status = 'error') AS allowed FROM b""")
def d13_lifecycle(spark, d):
    status = "CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'deleting' WHEN 'purchase' THEN 'ready' ELSE 'syncing' END AS status"
    return inc.lifecycle(table(spark, d, "events").selectExpr("user_id", "event_id", status), ["user_id"], order="event_id").select("event_id", "before", "status", "allowed")


@query(f"""WITH {FILES_SQL}, {OLD_SQL}, {NEW_SQL} SELECT data_source_id, count(*) AS listed, count(DISTINCT file_path) AS files FROM (SELECT data_source_id, file_path FROM b_old UNION ALL SELECT data_source_id, file_path FROM b_new) GROUP BY 1""")
def u01_u02_unions(spark, d):
    cols = ["data_source_id", "file_path"]
    both = bridge.old_manifest(spark, d).select(cols).unionByName(bridge.new_manifest(spark, d).select(cols))
    return both.groupBy("data_source_id").agg(F.count("*").alias("listed"), F.countDistinct("file_path").alias("files"))
