"""The given tables seen as files, vectors, manifests, runs and judgements of indexed sources.

The expressions are plain SQL that Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PATH_SQL = """CASE doc_id % 10
  WHEN 0 THEN concat('docs/guide_', doc_id, '.md') WHEN 1 THEN concat('src/app/mod_', doc_id, '.ts')
  WHEN 2 THEN concat('src/lib/mod_', doc_id, '.py') WHEN 3 THEN concat('.github/workflows/wf_', doc_id, '.yml')
  WHEN 4 THEN concat('actions/act_', doc_id, '/action.yml') WHEN 5 THEN concat('pkg/test/mod_', doc_id, '.test.ts')
  WHEN 6 THEN concat('config/pkg_', doc_id, '/package.json') WHEN 7 THEN concat('pkg/', lang, '/mod_', doc_id, '.go')
  WHEN 8 THEN concat('web/node_modules/dep_', doc_id, '/index.js') ELSE concat('assets/img_', doc_id, '.png') END"""

FILE_COLUMNS = ["doc_id", "source AS data_source_id", f"{PATH_SQL} AS file_path", "text AS content", "n_chars AS size", "lang"]
#: Two listings of the files: by length, some are new, some are gone and some have changed.
OLD_COLUMNS = ["data_source_id", "file_path", "size", "CAST(doc_id AS STRING) AS sha"]
OLD_WHERE, NEW_WHERE = "size % 7 <> 0", "size % 11 <> 0"
NEW_COLUMNS = ["data_source_id", "file_path", "size", "concat(CAST(doc_id AS STRING), CASE WHEN size % 13 = 0 THEN '+' ELSE '' END) AS sha"]
RUN_COLUMNS = [
    "user_id AS data_source_id",
    "event_id AS seq",
    "ts AS started_at",
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status",
    "CAST(floor(value) AS BIGINT) AS files",
    "event_type",
]
WORKFLOW_SQL = r"concat('name: Build ', source, '\non: [push, ', lang, ']\njobs:\n  main:\n    runs-on: any\n')"
ACTION_SQL = (
    r"concat('name: \'Act ', source, '\'\ndescription: Runs ', lang, '\ninputs:\n  token:\n    required: true\n  level:\n    default: 1\nruns:\n  using: node\n')"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*FILE_COLUMNS)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id", "embedding", "label AS data_source_id")


def old_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(OLD_WHERE).selectExpr(*OLD_COLUMNS)


def new_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where(NEW_WHERE).selectExpr(*NEW_COLUMNS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*RUN_COLUMNS)


def workflow_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with workflow and action text made from its columns."""
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr("doc_id", "source AS data_source_id", f"{PATH_SQL} AS file_path", f"{WORKFLOW_SQL} AS workflow", f"{ACTION_SQL} AS action")


def sql(*columns: str) -> str:
    return ", ".join(columns).replace("AS STRING", "AS VARCHAR")


FILES_SQL = f"b_files AS (SELECT {sql(*FILE_COLUMNS)} FROM documents)"
OLD_SQL = f"b_old AS (SELECT {sql(*OLD_COLUMNS)} FROM b_files WHERE {OLD_WHERE})"
NEW_SQL = f"b_new AS (SELECT {sql(*NEW_COLUMNS)} FROM b_files WHERE {NEW_WHERE})"
RUNS_SQL = f"b_runs AS (SELECT {sql(*RUN_COLUMNS)} FROM events)"
