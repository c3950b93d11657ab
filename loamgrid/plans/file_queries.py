"""Queries over files, sources and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import globs
from ..functions import scalars as X
from ..operators import catalog, chunking, filters, ranking, tokencount
from ..sources import bridge
from ..sources.bridge import FILES_SQL, RUNS_SQL, files, table
from .registry import Queries

query = Queries()
EXT = r"lower(regexp_extract(file_path, '\.([^.]*)$', 1))"
KEEP = "file_path NOT LIKE '%node_modules/%' AND file_path NOT LIKE '%.png'"


def sources(spark, sf_dir):
    """Customers as indexed sources."""
    return table(spark, sf_dir, "customer")


@query(f"WITH {FILES_SQL} SELECT data_source_id, file_path FROM b_files WHERE {KEEP}")
def f01_glob_filter(spark, d):
    return filters.by_globs(files(spark, d), [], []).select("data_source_id", "file_path")


@query(f"""WITH {FILES_SQL} SELECT 'documentation' AS preset, data_source_id, file_path FROM b_files WHERE {KEEP} AND {EXT} = 'md'
UNION ALL SELECT 'source-code', data_source_id, file_path FROM b_files WHERE {KEEP} AND {EXT} IN ('ts', 'py', 'go', 'js', 'md')
UNION ALL SELECT 'github-actions-library', data_source_id, file_path FROM b_files WHERE file_path LIKE '%/action.yml'
UNION ALL SELECT 'cicd-workflows', data_source_id, file_path FROM b_files WHERE file_path LIKE '.github/workflows/%'
UNION ALL SELECT 'openapi-specs', data_source_id, file_path FROM b_files WHERE {EXT} IN ('yml', 'json')""")
def f04_presets(spark, d):
    held = files(spark, d)
    admits = [F.when(globs.path_passes(F.col("file_path"), g, model.DEFAULT_EXCLUDES), F.lit(k)) for k, g in model.PRESETS.items() if g]
    return held.select(F.explode(F.array_compact(F.array(*admits))).alias("preset"), "data_source_id", "file_path")


@query(f"WITH {FILES_SQL} SELECT data_source_id, file_path, size FROM b_files WHERE size <= 1000000 AND {EXT} <> 'png'")
def f02_eligible(spark, d):
    return filters.eligible(files(spark, d)).select("data_source_id", "file_path", "size")


@query(f"""WITH {FILES_SQL} SELECT {EXT} AS ext, {EXT} = 'png' AS tool_binary, count(*) AS files FROM b_files GROUP BY 1""")
def f08_tool_binary(spark, d):
    p = F.col("file_path")
    return files(spark, d).groupBy(X.extension(p).alias("ext"), filters.tool_binary(p).alias("tool_binary")).agg(F.count("*").alias("files"))


@query(f"WITH {FILES_SQL} SELECT doc_id, file_path LIKE '.github/workflows/%.yml' AS workflow, file_path LIKE '%/action.yml' AS action FROM b_files")
def f09_f10_workflow_action(spark, d):
    p = F.col("file_path")
    return files(spark, d).select("doc_id", filters.workflow_file(p).alias("workflow"), filters.action_file(p).alias("action"))


@query(f"WITH {FILES_SQL} SELECT doc_id, substr(file_path, 5) AS file_path FROM b_files WHERE file_path LIKE 'pkg/%'")
def f12_subtree(spark, d):
    return filters.subtree(files(spark, d), "pkg/").select("doc_id", "file_path")


@query("""WITH s AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'ready' WHEN 'MACHINERY' THEN 'deleting' ELSE 'syncing' END AS status FROM customer),
n AS (SELECT o_custkey AS id, count(*) AS chunks FROM orders GROUP BY 1)
SELECT s.id, s.status, coalesce(n.chunks, 0) AS chunks FROM s LEFT JOIN n USING (id) WHERE status <> 'deleting' AND (status = 'ready' OR coalesce(chunks, 0) > 0)""")
def f05_searchable(spark, d):
    status = F.expr("CASE c_mktsegment WHEN 'BUILDING' THEN 'ready' WHEN 'MACHINERY' THEN 'deleting' ELSE 'syncing' END")
    held = sources(spark, d).select(F.col("c_custkey").alias("id"), status.alias("status"))
    counts = catalog.chunk_counts(table(spark, d, "orders").select(F.col("o_custkey").alias("data_source_id")))
    return filters.searchable(held, counts).select("id", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"""WITH {RUNS_SQL}, s AS (SELECT data_source_id, max(CASE WHEN status = 'completed' THEN started_at END) AS last_synced_at FROM b_runs GROUP BY 1)
SELECT data_source_id FROM s, (SELECT max(started_at) AS now FROM b_runs) WHERE last_synced_at IS NULL OR last_synced_at <= now - INTERVAL 24 HOURS""")
def f15_due_sources(spark, d):
    runs = bridge.runs(spark, d)
    last = runs.groupBy("data_source_id").agg(F.max(F.when(F.col("status") == "completed", F.col("started_at"))).alias("last_synced_at"))
    held = last.withColumns({"sync_schedule": F.lit("daily"), "status": F.lit("ready")})
    now = runs.agg(F.max("started_at").alias("now"))
    return filters.due(held.crossJoin(F.broadcast(now)), F.col("now")).select("data_source_id")


@query("""SELECT s_suppkey, s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND lower(c.c_mktsegment) = 'building')""")
def f16_duplicate_sources(spark, d):
    incoming = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit("BUILDING").alias("owner"), F.lit("r").alias("repo"), F.col("s_nationkey").alias("branch"))
    existing = sources(spark, d).select(F.lower("c_mktsegment").alias("owner"), F.lit("R").alias("repo"), F.col("c_nationkey").alias("branch"))
    return filters.known_sources(incoming, existing).select("s_suppkey", "s_name")


@query("""SELECT s_suppkey, s_name FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9950)""")
def j06_import_new(spark, d):
    incoming = table(spark, d, "supplier").select("s_suppkey", "s_name", F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.col("s_nationkey").alias("branch"))
    existing = sources(spark, d).where("c_acctbal > 9950").select(F.lit("O").alias("owner"), F.lit("r").alias("repo"), F.col("c_nationkey").alias("branch"))
    return filters.known_sources(incoming, existing, known=False).select("s_suppkey", "s_name")


@query(f"""WITH {FILES_SQL} SELECT data_source_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(ceil(sum(size) / 4.0) AS BIGINT) AS tokens,
count(*) < 1000 AND sum(size) < 10000000 AND ceil(sum(size) / 4.0) < 500000 AS small, count(*) > 10000 AS many_files FROM b_files GROUP BY 1""")
def f17_index_gate(spark, d):
    return filters.index_gate(files(spark, d), ["data_source_id"])


@query(r"SELECT doc_id, regexp_matches(text, '\S') AS not_blank, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def x01_f11_tokens(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", filters.not_blank(t).alias("not_blank"), X.estimate_tokens(t).alias("tokens"))


LANG = f"CASE {EXT} WHEN 'ts' THEN 'typescript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' END"


@query(f"""WITH {FILES_SQL}, l AS (SELECT doc_id, file_path, {LANG} AS language FROM b_files)
SELECT doc_id, language, CASE WHEN language = 'python' THEN '#' ELSE '//' END AS mark,
CASE {EXT} WHEN 'py' THEN 'py' ELSE {EXT} END AS short,
CASE {EXT} WHEN 'yml' THEN 'yaml' WHEN 'png' THEN '' ELSE {EXT} END AS fence FROM l""")
def x03_x04_x05_x10_language(spark, d):
    p = F.col("file_path")
    held = files(spark, d).select("doc_id", "file_path", X.language(p).alias("language"))
    mark = X.comment_prefix(F.coalesce("language", F.lit("")))
    return held.select("doc_id", "language", mark.alias("mark"), X.display_extension(p).alias("short"), X.fence(p).alias("fence"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN file_path LIKE 'pkg/test/%' THEN 'test' WHEN file_path LIKE '%.md' THEN 'docs' WHEN file_path LIKE '.github/%' THEN 'workflow'
WHEN file_path LIKE '%/action.yml' THEN 'action' WHEN file_path LIKE '%/package.json' THEN 'config' ELSE '' END AS flags FROM b_files""")
def x06_flags(spark, d):
    return files(spark, d).select("doc_id", F.array_join(X.flags(F.col("file_path")), ",").alias("flags"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN file_path LIKE '.github/%' THEN 'workflow' WHEN file_path LIKE '%action.yml' THEN 'action' WHEN file_path LIKE '%.md' THEN 'documentation'
WHEN file_path LIKE '%/package.json' THEN 'config' ELSE 'code' END AS type, substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 320) AS snippet FROM b_files""")
def x07_x08_result(spark, d):
    return files(spark, d).select("doc_id", X.result_type(F.col("file_path")).alias("type"), X.snippet(F.col("content")).alias("snippet"))


@query("SELECT doc_id, concat('Build ', source) AS name, concat('push,', lang) AS triggers, concat('Act ', source) AS action, concat('Runs ', lang) AS description, 'token:true,level:false' AS inputs FROM documents")
def x11_x12_x13_yaml(spark, d):
    w, a = F.col("workflow"), F.col("action")
    inputs = F.transform(X.action_inputs(a), lambda x: F.concat_ws(":", x["name"], x["required"].cast("string")))
    return bridge.workflow_files(spark, d).select(
        "doc_id",
        X.yaml_scalar(w, "name").alias("name"),
        F.array_join(X.workflow_triggers(w), ",").alias("triggers"),
        X.yaml_scalar(a, "name").alias("action"),
        X.yaml_scalar(a, "description").alias("description"),
        F.array_join(inputs, ",").alias("inputs"),
    )


URLS = r"CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^(https?)://[^/]+', '{1}://github.com') WHEN 2 THEN split_part(url, '?', 1) WHEN 3 THEN concat('  ', regexp_replace(url, '^https?://', '')) ELSE '  ' END"


@query(rf"""SELECT page_id, CASE WHEN trim(u) = '' THEN 'empty' WHEN regexp_matches(trim(u), '^https?://github\.com/[^/]+/[^/.]+?(\.git)?(/.*)?$') THEN NULL
WHEN regexp_matches(u, '^https?://[^/]+/[^/]+/[^/]+') AND NOT contains(u, 'github.com') THEN 'enterprise' ELSE 'invalid' END AS error FROM (SELECT page_id, {URLS.replace("{1}", "\\1")} AS u FROM pages)""")
def x14_url_errors(spark, d):
    u = F.expr(URLS.replace("{1}", "$1"))
    return table(spark, d, "pages").select("page_id", X.repo_url_error(u).alias("error"))


@query(r"SELECT page_id, regexp_extract(url, '^https?://([^/\s]+)/([^/.\s?#]+)', 1) AS host, regexp_extract(url, '^https?://([^/\s]+)/([^/.\s?#]+)', 2) AS first FROM pages")
def x14_url_parts(spark, d):
    pages = table(spark, d, "pages").withColumn("u", F.regexp_replace("url", "^(https?://)", "$1github.com/"))
    got = X.repo_of_url(F.col("u"))
    whole = F.regexp_extract("u", r"^https?://github\.com/([^/\s]+)/([^/.\s?#]+)", 1)
    return pages.select("page_id", F.when(got.isNotNull(), whole).otherwise("").alias("host"), F.coalesce(got["repo"], F.lit("")).alias("first"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN '$0.00' WHEN o_totalprice * 1000 / 1e6 * 0.02 < 0.01 THEN '<$0.01' ELSE printf('$%.2f', o_totalprice * 1000 / 1e6 * 0.02) END AS cost,
substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7) AS short FROM orders""")
def x17_x20_cost(spark, d):
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", X.cost(F.col("o_totalprice") * 1000, F.lit(0.02)).alias("cost"), X.short_sha(F.md5(F.col("o_orderkey").cast("string"))).alias("short"))


@query(r"SELECT p_partkey, format('{:,}', p_partkey * 1237) AS shown, CASE WHEN p_partkey * 1237 < 1000000 THEN concat(CAST(CAST(round(p_partkey * 1237 / 1000.0) AS BIGINT) AS VARCHAR), ' KB') ELSE printf('%.1f MB', p_partkey * 1237 / 1e6) END AS size FROM part")
def x18_x19_formats(spark, d):
    n = F.col("p_partkey") * 1237
    return table(spark, d, "part").select("p_partkey", X.thousands(n).alias("shown"), X.byte_size(n).alias("size"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(replace(lower(n_name), '_', ' '), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ') AS shown FROM nation")
def x21_humanized(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.humanized(F.regexp_replace(F.lower("n_name"), " ", "_")).alias("shown"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, concat(data_source_id, ':', file_path) AS file_key, regexp_extract(file_path, '[^/]*$') AS name, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir, {EXT} AS ext,
sha256(concat('{{"s":"', data_source_id, '","p":"', file_path, '"}}')) AS print FROM b_files""")
def x23_x24_x26_keys(spark, d):
    p, s = F.col("file_path"), F.col("data_source_id")
    return files(spark, d).select(
        "doc_id", X.file_key(s, p).alias("file_key"), X.basename(p).alias("name"), X.dirname(p).alias("dir"), X.extension(p).alias("ext"), X.fingerprint(s.alias("s"), p.alias("p")).alias("print")
    )


@query(f"""WITH {FILES_SQL} SELECT CASE WHEN file_path LIKE '%.md' THEN 'headings' WHEN file_path LIKE '.github/%' OR file_path LIKE '%/action.yml' THEN 'whole'
WHEN {EXT} IN ('ts', 'py', 'go', 'js') THEN 'ast' ELSE 'tokens' END AS strategy, count(*) AS files, CAST(sum(size) AS BIGINT) AS size FROM b_files GROUP BY 1""")
def c12_routes(spark, d):
    return files(spark, d).groupBy(X.chunk_strategy(F.col("file_path")).alias("strategy")).agg(F.count("*").alias("files"), F.sum("size").alias("size"))


C01 = """l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, len(lines) AS n, list_transform(lines, lambda x, i: CAST(ceil((length(x) + CASE WHEN i < len(lines) THEN 1 ELSE 0 END) / 4.0) AS BIGINT)) AS t FROM l),
s AS (SELECT doc_id, lines, n, list_prepend(CAST(0 AS BIGINT), list_transform(t, lambda x, i: CAST(list_sum(t[1:i]) AS BIGINT))) AS ps FROM p),
w AS (
  SELECT doc_id, n, ps, CAST(0 AS BIGINT) AS start_at, greatest(1, len(list_filter(ps, lambda x: x <= 512)) - 1) AS end_at FROM s
  UNION ALL
  SELECT doc_id, n, ps, next_at, greatest(next_at + 1, len(list_filter(ps, lambda x: x <= ps[next_at + 1] + 512)) - 1) FROM (
    SELECT doc_id, n, ps, CASE WHEN back > start_at THEN back ELSE end_at END AS next_at FROM (
      SELECT *, greatest(0, len(list_filter(ps[1:end_at], lambda x: x <= ps[end_at + 1] - 64)) - 1) AS back FROM w WHERE end_at < n))
)"""


@query(f"""WITH RECURSIVE {C01} SELECT doc_id, CAST(start_at + 1 AS BIGINT) AS start_line, CAST(end_at AS BIGINT) AS end_line, CAST(ps[end_at + 1] - ps[start_at + 1] AS BIGINT) AS token_count FROM w""")
def c01_token_split(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("data_source_id"), F.lit("a.txt").alias("file_path"), F.col("text").alias("content"))
    made = chunking.chunk_files(docs, strategy="tokens", limits=model.ChunkLimits(max_input_tokens=1 << 40))
    return made.select(F.col("data_source_id").cast("long").alias("doc_id"), "start_line", "end_line", "token_count")


MD_SQL = "md AS (SELECT conv_id, string_agg(concat('# ', role, ' ', CAST(turn AS VARCHAR), chr(10), text), chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1)"


def conversations_md(spark, d):
    line = F.concat(F.lit("# "), "role", F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), "text")
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("start_line"), F.col("turn").alias("end_line"), line.alias("content"))
    return catalog.reassembled(turns, ["conv_id"])


@query(f"""WITH {MD_SQL}, l AS (SELECT conv_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS ln FROM md),
s AS (SELECT *, sum(CASE WHEN line LIKE '#%' AND ln > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY ln) AS section FROM l)
SELECT conv_id, CAST(section AS BIGINT) AS section, CAST(min(ln) AS BIGINT) AS start_line, CAST(max(ln) AS BIGINT) AS end_line, string_agg(line, chr(10) ORDER BY ln) AS content,
CAST(ceil(length(string_agg(line, chr(10) ORDER BY ln)) / 4.0) AS BIGINT) AS token_count FROM s GROUP BY 1, 2""")
def c02_heading_sections(spark, d):
    return chunking.heading_sections(conversations_md(spark, d), ["conv_id"])


@query()
def c00_chunk_files(spark, d):
    """All strategies over all files (tested against an independent model)."""
    return chunking.chunk_files(files(spark, d)).drop("content")


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS ordinal, concat('turn_', turn, ':') AS head FROM conversations
QUALIFY count(*) OVER (PARTITION BY conv_id) > 1""")
def c04_yaml_keys(spark, d):
    line = F.concat(F.lit("turn_"), F.col("turn").cast("string"), F.lit(":\n  "), F.regexp_replace("text", "\n", "\n  "))
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("start_line"), F.col("turn").alias("end_line"), line.alias("content"))
    held = catalog.reassembled(turns, ["conv_id"]).select(F.col("conv_id").cast("string").alias("data_source_id"), F.lit("a.yml").alias("file_path"), "content")
    made = chunking.chunk_files(held, strategy="yaml", limits=model.ChunkLimits(max_tokens=1 << 30, max_input_tokens=1 << 30))
    return made.select(F.col("data_source_id").cast("long").alias("conv_id"), "ordinal", F.substring_index("content", "\n", 1).alias("head"))


@query("""WITH l AS (SELECT doc_id, length(text) AS n, string_split(text, chr(10)) AS lines FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, n, CAST(list_sum(list_transform(lines, lambda x, i: ceil((length(x) + CASE WHEN i < len(lines) THEN 1 ELSE 0 END) / 4.0))) AS BIGINT) AS tokens FROM l),
c AS (SELECT doc_id, n, tokens, CASE WHEN tokens <= 300 THEN n ELSE least(n - 1, greatest(1, CAST(floor(300 * (n / CAST(tokens AS DOUBLE)) * 0.9) AS BIGINT))) END AS step FROM k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS pieces, CAST(sum(CASE WHEN tokens <= 300 THEN tokens ELSE ceil(least(step, n - pos) / 4.0) END) AS BIGINT) AS tokens FROM (SELECT doc_id, n, tokens, step, unnest(range(0, n, step)) AS pos FROM c) GROUP BY 1""")
def c05_input_limit(spark, d):
    held = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("data_source_id"), F.lit("a.txt").alias("file_path"), F.col("text").alias("content"))
    made = chunking.chunk_files(held, strategy="tokens", limits=model.ChunkLimits(max_tokens=1 << 30, max_input_tokens=300))
    return made.groupBy(F.col("data_source_id").cast("long").alias("doc_id")).agg(F.count("*").alias("pieces"), F.sum("token_count").alias("tokens"))


@query()
def x02_token_counts(spark, d):
    """Tokens of every document by a public vocabulary (tests compare with its own encoder)."""
    return tokencount.token_counts(table(spark, d, "documents"), ["doc_id"], "text")


CHUNKS_SQL = f"{FILES_SQL}, ch AS (SELECT data_source_id, file_path, CAST(ceil(size / 4.0) AS BIGINT) AS token_count, doc_id, content FROM b_files)"


def file_chunks(spark, d):
    """Each file as one chunk."""
    return files(spark, d).select("doc_id", "data_source_id", "file_path", "content", F.lit(1).alias("start_line"), F.col("doc_id").alias("ordinal"), F.ceil(F.col("size") / 4).cast("long").alias("token_count"))


@query(f"WITH {CHUNKS_SQL} SELECT data_source_id, count(*) AS chunks FROM ch GROUP BY 1")
def a01_chunk_counts(spark, d):
    return catalog.chunk_counts(file_chunks(spark, d))


@query(f"WITH {CHUNKS_SQL} SELECT data_source_id, file_path, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM ch GROUP BY 1, 2")
def a02_file_stats(spark, d):
    return catalog.file_stats(file_chunks(spark, d))


@query(f"WITH {CHUNKS_SQL} SELECT data_source_id, count(DISTINCT file_path) AS files, count(*) AS chunks, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM ch GROUP BY 1")
def a03_source_stats(spark, d):
    return catalog.source_stats(file_chunks(spark, d), ["data_source_id"])


@query("SELECT conv_id AS data_source_id, arg_min(text, turn) AS content FROM conversations GROUP BY 1")
def a07_first_chunk(spark, d):
    turns = table(spark, d, "conversations").selectExpr("conv_id AS data_source_id", "'c' AS file_path", "text AS content", "turn AS start_line", "turn AS ordinal")
    return catalog.first_chunks(turns).drop("file_path")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1")
def a08_reassembled(spark, d):
    turns = table(spark, d, "conversations").selectExpr("conv_id", "turn AS start_line", "turn AS end_line", "text AS content")
    return catalog.reassembled(turns, ["conv_id"])


@query("""SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END AS group_order,
row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 3 END, icu_sort_key(concat('o/', c_name), 'en'), c_custkey) AS place FROM customer""")
def a09_grouped_sources(spark, d):
    held = sources(spark, d).select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), F.lit("o").alias("owner"), F.col("c_name").alias("repo"))
    return catalog.grouped_sources(held, ["BUILDING", "FURNITURE"]).select("id", "group_order", "place")


@query(f"""WITH {FILES_SQL}, x AS (SELECT data_source_id, string_split(file_path, '/') AS p FROM b_files),
e AS (SELECT data_source_id, array_to_string(p[1:i], '/') AS dir FROM (SELECT data_source_id, p, unnest(range(1, len(p))) AS i FROM x))
SELECT data_source_id, dir, count(*) AS files FROM e GROUP BY 1, 2""")
def a11_directory_counts(spark, d):
    return catalog.directory_counts(files(spark, d), ["data_source_id"])


@query(f"""WITH {FILES_SQL} SELECT lang, count(DISTINCT data_source_id) AS sources, count(DISTINCT (data_source_id, file_path)) AS files, count(*) AS chunks, count(*) FILTER (WHERE file_path LIKE '%.md') AS guides FROM b_files GROUP BY 1""")
def a18_profile(spark, d):
    return catalog.profile(files(spark, d), ["lang"], guides=F.col("file_path").endswith(".md"))


TREE_SQL = f"""{FILES_SQL}, s AS (SELECT data_source_id, file_path, CAST(ceil(size / 4.0) AS BIGINT) AS tokens, string_split(file_path, '/') AS p, {EXT} AS ext FROM b_files),
leaf AS (SELECT data_source_id, list_transform(p, lambda x, i: concat(CASE WHEN i = len(p) THEN '1' ELSE '0' END, icu_sort_key(x, 'en'))) AS place, len(p) - 1 AS level,
  concat(p[-1], ' [', ext, CASE WHEN tokens > 0 THEN concat(', ', format('{{:,}}', tokens), ' tokens') ELSE '' END,
  CASE WHEN file_path LIKE 'pkg/test/%' THEN ', test' WHEN ext = 'md' THEN ', docs' WHEN file_path LIKE '.github/%' THEN ', workflow' WHEN file_path LIKE '%/action.yml' THEN ', action' WHEN file_path LIKE '%/package.json' THEN ', config' ELSE '' END, ']') AS line
  FROM s WHERE len(p) <= 2),
dirs AS (SELECT data_source_id, q, count(*) AS n FROM (SELECT data_source_id, p[1:i] AS q FROM (SELECT data_source_id, p, unnest(range(1, least(len(p) - 1, 2) + 1)) AS i FROM s)) GROUP BY 1, 2),
folder AS (SELECT data_source_id, list_transform(q, lambda x: concat('0', icu_sort_key(x, 'en'))) AS place, len(q) - 1 AS level, concat(q[-1], '/ [dir, ', n, CASE WHEN n = 1 THEN ' file]' ELSE ' files]' END) AS line FROM dirs),
hidden AS (SELECT data_source_id, list_append(list_transform(q, lambda x: concat('0', icu_sort_key(x, 'en'))), '2') AS place, len(q) AS level, concat('[', n, CASE WHEN n = 1 THEN ' file' ELSE ' files' END, ' not shown — use path: ''', q[-1], '/'' or increase maxDepth]') AS line FROM dirs WHERE len(q) = 2),
rows AS (SELECT * FROM leaf UNION ALL SELECT * FROM folder UNION ALL SELECT * FROM hidden)"""


@query(f"""WITH {TREE_SQL} SELECT data_source_id, CAST(row_number() OVER (PARTITION BY data_source_id ORDER BY place) AS INTEGER) AS row, concat(repeat('  ', level), line) AS line FROM rows""")
def r18_tree_rows(spark, d):
    stats = files(spark, d).select("data_source_id", "file_path", F.ceil(F.col("size") / 4).cast("long").alias("tokens"))
    return catalog.tree_rows(stats, ["data_source_id"], max_depth=2)


@query(f"""WITH {TREE_SQL}, r AS (SELECT data_source_id, row_number() OVER (PARTITION BY data_source_id ORDER BY place) AS row, line FROM rows),
m AS (SELECT data_source_id, CAST(ceil(max(row) / 20.0) AS BIGINT) AS pages FROM r GROUP BY 1)
SELECT data_source_id, CAST(row AS INTEGER) AS row, pages FROM r JOIN m USING (data_source_id) WHERE row > (least(3, pages) - 1) * 20 AND row <= least(3, pages) * 20""")
def w07_tree_page(spark, d):
    return catalog.page(r18_tree_rows(spark, d), ["data_source_id"], 3, 20).select("data_source_id", "row", F.col("pages").cast("long").alias("pages"))


#: What is asked for: files by their number, whole or from a line to a line; 9 is binary.
ASKED = [(0, None, None), (1, 2, 4), (9, None, None), (12, None, 3), (23, 2, None), (30, None, None), (41, None, None), (52, 1, 2)]


@query(f"""WITH RECURSIVE {FILES_SQL}, q AS (SELECT * FROM (VALUES {", ".join(f"({i}, {n}, {a or 'NULL'}, {b or 'NULL'})" for i, (n, a, b) in enumerate(ASKED, 1))}) v(position, n, lo, hi)),
f AS (SELECT position, concat('o/', data_source_id) AS repository, file_path, string_split(content, chr(10)) AS l, greatest(1, coalesce(lo, 1)) AS first, least(len(string_split(content, chr(10))), coalesce(hi, 1 << 30)) AS last,
  CASE WHEN file_path LIKE '%.png' THEN 'binary' WHEN length(content) > 6000 THEN 'too large' END AS st, length(content) AS raw FROM q JOIN b_files ON doc_id = n),
p AS (SELECT *, CASE WHEN first <= last THEN array_to_string(l[first:last], chr(10)) ELSE '' END AS part FROM f),
r AS (SELECT 0 AS position, 0 AS total, '' AS status UNION ALL
  SELECT p.position, CASE WHEN p.st IS NULL AND total + raw <= 9000 THEN total + length(part) ELSE total END, coalesce(p.st, CASE WHEN total + raw > 9000 THEN 'over total' ELSE 'ok' END) FROM r JOIN p ON p.position = r.position + 1)
SELECT CAST(position AS INTEGER) AS position, repository, file_path, r.status, CASE WHEN r.status = 'ok' THEN part END AS part FROM p JOIN r USING (position)""")
def r14_get_files(spark, d):
    held = files(spark, d).withColumn("repository", F.concat(F.lit("o/"), "data_source_id"))
    known = {r.doc_id: r for r in held.where(F.col("doc_id").isin([n for n, *_ in ASKED])).select("doc_id", "repository", "file_path").collect()}
    asked = [(known[n].repository.upper(), known[n].file_path, a, b) for n, a, b in ASKED]
    got = catalog.get_files(held, asked, most_each=6000, most_total=9000)
    return got.select("position", F.lower("repository").alias("repository"), "file_path", "status", "part")


#: Paths with capitals, accents and digits: the first word of each text.
MIXED = r"concat(lang, '/', regexp_extract(text, '^([A-Za-z0-9À-ÿ]*)', 1), '_', CAST(doc_id AS VARCHAR), CASE doc_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.md' ELSE '-Ä.md' END)"


@query(f"""SELECT source, path, CAST(row_number() OVER (PARTITION BY source ORDER BY icu_sort_key(path, 'en'), path) AS INTEGER) AS place FROM (SELECT source, {MIXED} AS path FROM documents)""")
def t05_locale_order(spark, d):
    path = F.expr(MIXED.replace("VARCHAR", "STRING").replace("'^([", "r'^([") )
    held = table(spark, d, "documents").select("source", path.alias("path"))
    placed = ranking.numbered(held, ["source"], [F.collate("path", catalog.LOCALE), F.col("path")], "place")
    return placed.select("source", "path", F.col("place").cast("int").alias("place"))


@query(f"""WITH f AS (SELECT source, {MIXED} AS p FROM documents), x AS (SELECT source, lang_of, name FROM (SELECT source, split_part(p, '/', 1) AS lang_of, split_part(p, '/', 2) AS name FROM f)),
n AS (SELECT source, lang_of, count(*) AS n FROM x GROUP BY 1, 2),
r AS (SELECT source, icu_sort_key(lang_of, 'en') AS a, 0 AS b, '' AS c, concat(lang_of, '/ [dir, ', n, CASE WHEN n = 1 THEN ' file]' ELSE ' files]' END) AS line FROM n
UNION ALL SELECT source, icu_sort_key(lang_of, 'en'), 1, icu_sort_key(name, 'en'), concat('  ', name, ' [md, docs]') FROM x)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY a, b, c, line) AS INTEGER) AS row, line FROM r""")
def r18_locale_tree(spark, d):
    path = F.expr(MIXED.replace("VARCHAR", "STRING").replace("'^([", "r'^(["))
    stats = table(spark, d, "documents").select("source", path.alias("file_path"), F.lit(0).cast("long").alias("tokens"))
    return catalog.tree_rows(stats, ["source"])


@query("""SELECT doc_id, CAST(len(l) AS INTEGER) AS lines, CAST(least(2, len(l)) AS INTEGER) AS first, CAST(greatest(least(2, len(l)), least(4, len(l))) AS INTEGER) AS last,
array_to_string(l[least(2, len(l)):greatest(least(2, len(l)), least(4, len(l)))], chr(10)) AS part FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def r14_line_range(spark, d):
    held = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return catalog.line_range(held, F.lit(2), F.lit(4)).select("doc_id", "lines", "first", "last", "part")


@query(f"""WITH {FILES_SQL} SELECT data_source_id, concat('Build ', data_source_id) AS name, file_path, concat('push,', lang) AS triggers FROM b_files WHERE file_path LIKE '.github/%'""")
def r16_workflows(spark, d):
    held = bridge.workflow_files(spark, d).select("data_source_id", "file_path", F.col("workflow").alias("content"), F.lit(1).alias("start_line"), F.col("doc_id").alias("ordinal"))
    return catalog.workflows(held).select("data_source_id", "name", "file_path", F.array_join("triggers", ",").alias("triggers"))


@query(f"""WITH {FILES_SQL} SELECT data_source_id, file_path, concat('Act ', data_source_id) AS name, concat('Runs ', lang) AS description, 2 AS inputs FROM b_files WHERE file_path LIKE '%/action.yml'""")
def r17_actions(spark, d):
    held = bridge.workflow_files(spark, d).select("data_source_id", "file_path", F.col("action").alias("content"), F.lit(1).alias("start_line"), F.col("doc_id").alias("ordinal"))
    return catalog.actions(held).select("data_source_id", "file_path", "name", "description", F.size("inputs").alias("inputs"))


@query("""SELECT lang, concat('docs/', CASE min(CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END) WHEN 0 THEN 'README.md' WHEN 1 THEN 'README.mdx' WHEN 2 THEN 'README.txt' ELSE 'readme.md' END) AS file_path
FROM documents GROUP BY 1""")
def r15_readme(spark, d):
    name = F.expr("CASE doc_id % 4 WHEN 0 THEN 'README.mdx' WHEN 1 THEN 'README.txt' WHEN 2 THEN 'readme.md' ELSE 'README.md' END")
    return catalog.readme(table(spark, d, "documents").select("lang", F.concat(F.lit("docs/"), name).alias("file_path")), ["lang"], "docs")


@query("""WITH s AS (SELECT c_custkey AS id, c_name AS repo, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ready' ELSE 'syncing' END AS status FROM customer),
n AS (SELECT o_custkey AS id, count(DISTINCT o_orderpriority) AS files, count(*) AS chunks, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS tokens FROM orders GROUP BY 1)
SELECT id, repo, status, coalesce(files, 0) AS files, coalesce(chunks, 0) AS chunks, coalesce(tokens, 0) AS tokens, status <> 'ready' AS partial FROM s LEFT JOIN n USING (id)""")
def r13_source_listing(spark, d):
    held = sources(spark, d).selectExpr("c_custkey AS id", "c_name AS repo", "CASE WHEN c_mktsegment = 'BUILDING' THEN 'ready' ELSE 'syncing' END AS status")
    chunks = table(spark, d, "orders").selectExpr("o_custkey AS data_source_id", "o_orderpriority AS file_path", "CAST(floor(o_totalprice) AS BIGINT) AS token_count")
    return catalog.source_listing(held, chunks)


