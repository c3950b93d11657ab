"""Locale order, row numbers over hot keys, and lookups by id."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.functions import scalars as X
from loamgrid.operators import catalog, ranking, retrieval, tokencount, vector
from loamgrid.sources import stored


def rows(spark, kind, *values):
    return spark.createDataFrame(list(values), kind)


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


#: Names in the order that readers expect, from the published root collation.
NAMES = ["_a.md", "-a.md", ".a.md", "1.md", "10.md", "2.md", "a.md", "A.md", "ä.md", "Ä.md", "aa.md", "Aa.md", "b.md", "B.md", "e.md", "é.md", "ea.md", "z.md", "Z.md"]


def test_tree_and_results_in_locale_order(spark):
    held = rows(spark, "file_path string, tokens long", *[(n, 0) for n in reversed(NAMES)])
    lines = [r.line.split(" ")[0] for r in catalog.tree_rows(held, []).orderBy("row").collect()]
    assert lines == NAMES
    kind = "data_source_id string, file_path string, start_line long, end_line long, chunk_id string, distance double"
    results = rows(spark, kind, *[("s", n, 1, 1, n, 0.5) for n in reversed(NAMES)])
    got = [r.file_path for r in retrieval.diverse(results, [], retrieval.payload_order()).orderBy("position").collect()]
    assert got == NAMES


def test_sources_by_type_and_name(spark):
    kind = "id int, type string, owner string, repo string"
    held = rows(spark, kind, (1, "b", "Own", "x"), (2, "a", "own", "Y"), (3, "?", "own", "a"), (4, "a", "own", "x"), (5, "a", "Own", "x"), (6, None, "a", "a"))
    got = [(r.id, r.place) for r in catalog.grouped_sources(held, ["b", "a"]).orderBy("place").collect()]
    assert got == [(1, 1), (4, 2), (5, 3), (2, 4), (6, 5), (3, 6)]


def test_numbers_of_a_hot_key(spark):
    """One key holds nearly all rows, one is null, and rows arrive in no order; ranges cut the hot key."""
    held = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 50 == 1, "small").otherwise("hot").alias("k"), F.xxhash64("id").alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.numbered(held, ["k"], [F.col("x")]).toPandas().sort_values("x")
        laid = held.repartitionByRange(F.col("k"), F.col("x")).where("k = 'hot'").groupBy(F.spark_partition_id()).count()
        assert laid.count() > 3 and max(r[1] for r in laid.collect()) < 6000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for _, g in got.groupby("k", dropna=False):
        assert g["row"].tolist() == list(range(1, len(g) + 1))
    assert ranking.numbered(held.where("false"), ["k"], [F.col("x")]).count() == 0
    assert [r.row for r in ranking.numbered(rows(spark, "x int", (3,), (1,), (2,)), [], [F.col("x")]).orderBy("x").collect()] == [1, 2, 3]


def test_lookups_read_their_buckets(spark):
    held = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("chunk_id"), (F.col("id") % 7).alias("source"), F.col("id").alias("n"))
    name = stored.saved_by_id(held, "chunk_id", 8)
    ids = [r.chunk_id for r in held.where("n IN (5, 77)").collect()]
    found = stored.by_ids(spark, name, "chunk_id", [*ids, "none"])
    assert sorted(r.n for r in found.collect()) == [5, 77]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # only so that the plan shows the buckets chosen
    try:
        assert re.search(r"SelectedBucketsCount: [1-3] out of 8", plan_of(stored.by_ids(spark, name, "chunk_id", [*ids, "none"])))
    finally:
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    asked = held.where("n % 10 = 3").select("chunk_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        batch = stored.by_id_table(spark, name, "chunk_id", asked)
        assert sorted(r.n for r in batch.collect()) == list(range(3, 1000, 10))
        assert "Bucketed: true" in plan_of(batch) and "Bucketed: false" not in plan_of(batch)
        gone = stored.without_ids(spark, name, "chunk_id", asked)
        assert gone.count() == 900
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ids_only = stored.ids_where(spark, name, "chunk_id", F.col("source") == 3)
    assert ids_only.count() == held.where("source = 3").count()
    assert "ReadSchema: struct<chunk_id:string,source:bigint>" in plan_of(ids_only)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_ties_are_numbered_without_gaps(spark, by):
    held = rows(spark, "k string, x int", *[("a", 1)] * 5, *[("b", 1)] * 5)
    got = sorted(r.row for r in ranking.numbered(held, by, [F.col("x")]).collect())
    assert got == (list(range(1, 11)) if not by else sorted([*range(1, 6)] * 2))


def test_files_asked_for(spark):
    """Caps are on whole files in UTF-16 units, the total counts parts that were given."""
    kind = "repository string, file_path string, content string"
    held = rows(spark, kind, ("O/R", "a.py", "1\n2\n3\n4"), ("O/R", "b.md", "x" * 30), ("O/R", "c.md", "\U0001f600" * 11), ("P/Q", "d.txt", "y" * 15), ("P/Q", "e.txt", "z" * 12), ("O/R", "i.png", ""))
    asked = [("o/r", "a.py", 2, 3), ("o/r", "b.md", 1, 1), ("o/r", "c.md", None, None), ("p/q", "d.txt", None, None), ("no/ne", "a.py", None, None), ("o/r", "none.md", None, None), ("o/r", "i.png", None, None), ("p/q", "e.txt", 9, 2), ("P/q", "e.txt", None, None)]
    got = catalog.get_files(held, asked, most_each=20, most_total=20).orderBy("position").collect()
    assert [(r.status, r.part) for r in got] == [
        ("ok", "2\n3"), ("too large", None), ("too large", None), ("ok", "y" * 15), ("no repository", None), ("not found", None), ("binary", None), ("over total", None), ("over total", None),
    ]
    assert (got[0].lines, got[0].first, got[0].last, got[0].fence) == (4, 2, 3, "py")
    with pytest.raises(ValueError, match="10 at most"):
        catalog.get_files(held, asked * 2)


def test_token_counts_equal_the_encoder(spark):
    odd = ["", None, "a   b", "  it's\u00a0 ok\n\n\n  x", "\U0001f600é\u0301 12345 ***", "tab\t\tend ", "\u2003wide\u2028line", "don't WE'LL"]
    held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = held.unionByName(rows(spark, "doc_id long, text string", *[(-1 - i, t) for i, t in enumerate(odd)]))
    encode = tokencount.encoder(tokencount.VOCABULARY).encode_ordinary
    want = {r.doc_id: len(encode(r.text or "")) for r in held.collect()}
    assert {r.doc_id: r.tokens for r in tokencount.token_counts(held, ["doc_id"], "text").collect()} == want


@pytest.mark.parametrize("laid", [False, True])
def test_neighbours_in_passes_and_what_is_spared(spark, monkeypatch, laid):
    """Against all distances, with equal vectors, several passes and string keys; laid by pivots, far batches spare their queries."""
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 50, (12, 8))
    x = np.concatenate([c + draw.normal(0, 1, (60, 8)) for c in centres] + [np.repeat(centres[:1], 40, axis=0)]).astype(np.float32)
    keys = [f"k{i:04}" for i in draw.permutation(len(x))]
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        held = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x, strict=True)], "chunk_id string, embedding array<float>")
        stored_rows = vector.by_pivots(held, 16) if laid else held
        queries = held.where("chunk_id < 'k0020'").withColumnRenamed("chunk_id", "query_id")
        spared = spark.sparkContext.accumulator(0)
        got = {}
        for r in vector.knn_batch(stored_rows, queries, 5, spared).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    place = {k: i for i, k in enumerate(keys)}
    for q in got:
        d = np.sqrt(((x.astype(np.float64) - x[place[q]].astype(np.float64)) ** 2).sum(axis=1))
        assert got[q] == [keys[i] for i in sorted(range(len(x)), key=lambda i: (d[i], keys[i]))[:5]]
    assert len(got) == 20 and (not laid or spared.value > 100)


def test_addresses_that_name_no_repository(spark):
    held = {
        "": "empty", " \n": "empty", "https://github.com/o/r": None, " git@github.com:o/r.git ": None, "https://github.com/o/r.git": None, "http://github.com/o/r/tree/main": None,
        "https://git.corp.example/o/r": "enterprise", "https://example.com/o": "invalid", "https://github.com/o": "invalid", "https://github.com/o/r.js": "invalid", "o/r": "invalid",
    }
    got = {r.u: r.e for r in rows(spark, "u string", *[(u,) for u in held]).select("u", X.repo_url_error(F.col("u")).alias("e")).collect()}
    assert got == held
