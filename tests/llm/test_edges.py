"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import os

import pytest
from pyspark.sql import functions as F

from loamgrid.llm import fingerprints, html_text, language, lm_scoring, mixing, near_join, packing, quality, sharding, tables, vector_dedup
from loamgrid.llm.tables import stored

LONG = "many different words " * 4000
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word7 ", "other ")
ROWS = [
    (1, BASE, "en", "a", 1),
    (2, BASE, "en", "a", 1),
    (3, NEAR, "en", None, 1),
    (4, None, None, "b", None),
    (5, "", "en", "b", 0),
    (6, "  \n ", "de", "a", 4),
    (7, LONG, "de", "a", len(LONG)),
    (8, "ein kurzer Satz", "de", "b", 15),
    (8, "ein kurzer Satz", "de", "b", 15),
    (None, "text without an id", "en", "a", 18),
    (9, "💡 ünïcode « text » mit Zeichen", "de", "c", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within.
CLASH = ["id", "rep", "copies", "shard", "slot", "row", "block", "h", "g", "size", "component", "score", "label", "key", "n", "ids", "spread", "name", "rank"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return stored(df.withColumns({c: F.lit("clash") for c in CLASH}))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df):
    return {r[0]: r for r in df.collect()}


def test_near_join(docs, none):
    rows = near_join.ngram_jaccard_join(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS)
    assert [got[i].class_id for i in (1, 2, 3)] == [1, 1, 1]
    assert [got[i].n_links for i in (1, 2, 3, 4, 5, 6)] == [2, 2, 2, 0, 0, 0]
    assert got[4].class_id == 4 and got[8].n_copies == 2 and not got[None].kept
    assert near_join.ngram_jaccard_join(none).count() == 0


def test_keep_one(docs, none):
    kept = near_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), *[(True, i) for i in (1, 4, 5, 6, 7, 8, 9)]]
    assert near_join.keep_one(none).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    other = " ".join(f"thing{i}" for i in range(40))
    rows = [(1, BASE), (1, other), (2, other), (None, BASE), (None, other + " more"), (None, "alone here"), (3, NEAR)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.class_id, r.kept) for r in near_join.ngram_jaccard_join(df).collect())
    assert got == [(0, 0, None, False), (0, 2, 1, False), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False)]
    kept = sorted((r.doc_id or 0, r.text) for r in near_join.keep_one(df).collect())
    assert kept == [(0, "alone here"), (1, other), (1, BASE)]


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, 4).collect()
    assert len(rows) == len(ROWS)
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows}[4] == (16, 0)
    assert sharding.shard_documents(none, 4).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 1
    assert sum(r.length for r in rows if r.doc_id == 8) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 8)
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert packing.pack_documents(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs, block_rows=2).collect()
    assert sorted(r.position for r in rows) == list(range(len(ROWS)))
    assert {r.source for r in rows} == {"a", "b", "c", None}
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs, {"a": 1.0}).count() == len(ROWS)
    assert mixing.mix_sources(none).count() == 0


def test_quality(spark, docs, none):
    known = labels(spark, [(1, 1, 0), (1, 1, 0), (7, 0, 0), (None, 1, 0), (3, None, 1), (99, 0, 0)])
    rows = quality.quality_scores(docs, known).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 1 for r in quality.quality_scores(docs, labels(spark, [])).collect())
    assert quality.quality_scores(none, known).count() == 0
    kept = quality.keep_good(docs, labels(spark, []))
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality.keep_good(none, known).count() == 0


def test_language(docs, none):
    rows = by_id(language.identify(docs))
    assert rows[4].lang_pred == rows[5].lang_pred == rows[6].lang_pred == "und" and rows[4].score == 0
    assert rows[7].lang_pred == "de"
    assert language.identify(none).count() == 0
    kept = language.keep_known(docs)
    assert kept.columns == docs.columns and not {4, 5, 6} & {r.doc_id for r in kept.collect()}
    assert language.keep_known(none).count() == 0


def test_lm_scoring(docs, none):
    rows = lm_scoring.score_texts(docs).collect()
    assert len(rows) == len(ROWS) and all(r.score < 0 and r.base_score < 0 for r in rows)
    assert by_id(lm_scoring.score_texts(docs))[4].n_tokens == 1
    assert lm_scoring.score_texts(none).count() == 0


def test_fingerprints(docs, none):
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[1].fingerprint == got[2].fingerprint and got[1].class_id == got[3].class_id == 1
    assert got[1].near_next == 1.0 and got[4].n_chars == 0
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprints_leave_no_tables_that_nothing_reads(spark, monkeypatch):
    made = []
    monkeypatch.setattr(tables, "scratch", lambda s, scratch=tables.scratch: made.append(scratch(s)) or made[-1])
    text = "one two three four five six seven eight nine ten eleven twelve "
    docs = spark.createDataFrame([(i, text * 3 + f"tail {i % 5}") for i in range(40)], "doc_id long, text string")
    rows = fingerprints.edited_fingerprints(docs).collect()
    assert all((r.class_id, r.n_links) == (0, 39) for r in rows)
    left = [set(spark.read.parquet(p).columns) for p in made if os.path.isdir(p.removeprefix("file://"))]
    assert sum("text" in c for c in left) == 1 and not any("bands" in c for c in left)
    assert len(made) > 10 and len(left) < len(made)


def test_keys_of_bands(spark):
    same, other = bytes(256), bytes(12) + b"1" * 12 + bytes(232)
    rows = spark.createDataFrame([(same,), (other,)], "fp binary").select(fingerprints.bands_of("fp").alias("k")).collect()
    assert [len(set(r.k)) for r in rows] == [fingerprints.BANDS] * 2
    assert [a == b for a, b in zip(*(r.k for r in rows), strict=True)] == [b != 1 for b in range(fingerprints.BANDS)]


def test_html(spark):
    pages = spark.createDataFrame(
        [(1, "u", None), (2, None, ""), (3, "u", "plain &amp; simple"), (3, "u", "plain &amp; simple"), (None, "u", "<p>a<p>b</b>"), (4, "u", "<div>" * 3000 + "deep")],
        "page_id long, url string, html string",
    ).withColumns({c: F.lit("clash") for c in ("id", "text", "n_chars")})
    got = html_text.extract_pages(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "a\n\nb", 4), (1, "", 0), (2, "", 0), (3, "plain & simple", 14), (3, "plain & simple", 14), (4, "deep", 4)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_vectors(spark):
    x, y, nan = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5], float("nan")
    rows = [(1, x, 1), (2, x, 1), (3, y, 1), (4, x, 2), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 1.0, 0.0], 1), (8, [None, 1.0, 1.0], 1), (9, x, None), (None, x, 1), (3, y, 1), (10, [], 1), (11, [1.0, 0.0], 1), (12, [float("inf"), 0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("id", "v", "rep", "g", "tile")})
    got = vector_dedup.cosine_links(df).collect()
    assert len(got) == len(rows)
    at = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert at[1] == (4, 1, True) and at[2] == (4, 1, False) and at[3] == (4, 1, False)
    assert all(at[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert vector_dedup.cosine_links(df.limit(0)).count() == 0
