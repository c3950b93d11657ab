"""Operators on small inputs of their own."""

import datetime
import io
import json
import re
import sqlite3
import tarfile
import threading
import time

import pytest
from pyspark.sql import functions as F

from loamgrid import model
from loamgrid.functions import globs
from loamgrid.functions import scalars as X
from loamgrid.functions.stemmer import stem
from loamgrid.operators import catalog, chunking, evaluation, filters, incremental, retrieval, runs, textindex, vector
from loamgrid.plans import queue
from loamgrid.plans.engine import Engine, HashProvider, RetryingProvider
from loamgrid.sources import config, readers
from loamgrid.streaming import ingest


@pytest.mark.parametrize(
    ("glob", "path", "match"),
    [
        ("**/*.md", "a.md", True),
        ("**/*.md", "x/y/a.md", True),
        ("*.md", "x/a.md", False),
        ("**/README.md", "README.md", True),
        ("docs/**", "docs/a/b.txt", True),
        ("docs/**", "docsx/a", False),
        ("**/node_modules/**", "a/node_modules/b/c.js", True),
        ("**/node_modules/**", "node_modules/c.js", True),
        ("**/*.{ts,tsx}", "src/a.tsx", True),
        ("**/*.{ts,tsx}", "src/a.js", False),
        ("a?c/[xy].txt", "abc/y.txt", True),
        ("a?c/[!xy].txt", "abc/y.txt", False),
        ("**/.git/**", ".git/config", True),
        ("a/**/b", "a/b", True),
        ("a/**/b", "a/x/y/b", True),
        ("#x", "#x", False),
        ("*", "ab", True),
        ("a.b", "axb", False),
    ],
)
def test_glob(glob, path, match):
    assert bool(re.search(globs.globs_regex([glob]), path)) == match


def test_globs_refuse_what_they_cannot_say():
    for g in ("!a", "+(a|b)"):
        with pytest.raises(ValueError, match="not supported"):
            globs.glob_regex(g)


def rows(spark, columns, *values):
    return spark.createDataFrame(list(values), columns)


def test_paths(spark):
    paths = {
        "src/a.TS": ("typescript", "ts", "ts", "", "code", "ast"),
        "docs/x.mdx": (None, "mdx", "", "docs", "documentation", "headings"),
        "a/docs/x.txt": (None, "txt", "", "docs", "code", "tokens"),
        "x/.github/workflows/ci.yaml": (None, "yaml", "yaml", "workflow", "workflow", "whole"),
        "my/action.yml": (None, "yml", "yaml", "action", "action", "whole"),
        "a/tests/b.spec.rb": ("ruby", "rb", "rb", "test", "code", "ast"),
        "Makefile": (None, "", "", "", "code", "tokens"),
        "a/vite.config.mjs": ("javascript", "js", "js", "config", "code", "ast"),
        ".env": (None, "env", "", "config", "code", "tokens"),
    }
    p = F.col("path")
    made = rows(spark, "path string", *[(k,) for k in paths]).select(
        p, X.language(p), X.display_extension(p), X.fence(p), F.array_join(X.flags(p), ","), X.result_type(p), X.chunk_strategy(p)
    )
    assert {r[0]: tuple(r[1:]) for r in made.collect()} == paths


def test_yaml_and_urls(spark):
    wf = "name: 'CI run'\non:\n  push:\n    branches: [a]\n  pull_request:\njobs:\n  x: 1\n"
    act = "name: A\ninputs:\n  one:\n    required: true\n  two:\n    description: x\nruns:\n  a: b\n"
    t = F.col("t")
    got = rows(spark, "t string", (wf,), ("on: push\n",), ("on: [a, b ]\n",), ("x: 1",)).select(X.yaml_scalar(t, "name"), X.workflow_triggers(t)).collect()
    assert [tuple(r) for r in got] == [("CI run", ["push", "pull_request"]), (None, ["push"]), (None, ["a", "b"]), (None, [])]
    inputs = rows(spark, "t string", (act,)).select(X.action_inputs(t)).first()[0]
    assert [tuple(x) for x in inputs] == [("one", True), ("two", False)]
    odd = ["inputs:\n  a-b:  \n    default: x\n  c: inline\n    required: true\n\n  after:\n", "x: 1", "inputs: {}\n", "name: y\ninputs:\n  last:\n    required:  true"]
    got = [[tuple(x) for x in r[0]] for r in rows(spark, "t string", *[(x,) for x in odd]).select(X.action_inputs(t)).collect()]
    assert got == [[("a-b", True)], [], [], [("last", True)]]
    odd = {"on:\n  schedule:\n    - cron: x\n\n  push:\n": ["schedule"], "on:\n  [push,\n   'x' ]\n": ["push", "'x'"], "true: 1\non:   release  \njobs:\n  a:\n": ["release"], "jobs:\n  on:\n": []}
    assert {r[0]: r[1] for r in rows(spark, "t string", *[(x,) for x in odd]).select(t, X.workflow_triggers(t)).collect()} == odd
    urls = {" https://github.com/o/r.git ": ("o", "r"), "git@github.com:o/r.git": ("o", "r"), "https://example.com/o/r": None, "": None, "http://github.com/o/r/tree/main": ("o", "r")}
    got = {r[0]: r[1] and tuple(r[1]) for r in rows(spark, "t string", *[(u,) for u in urls]).select(t, X.repo_of_url(t)).collect()}
    assert got == urls


def test_texts(spark):
    n = F.col("n")
    assert [r[0] for r in rows(spark, "n long", (999,), (1_500,), (2_500_000,)).select(X.byte_size(n)).collect()] == ["1 KB", "2 KB", "2.5 MB"]
    assert [r[0] for r in rows(spark, "n long", (0,), (1,), (10_000_000,)).select(X.cost(n, F.lit(0.02))).collect()] == ["$0.00", "<$0.01", "$0.20"]
    t = F.col("t")
    assert rows(spark, "t string", ("a\u00a0 b\n",)).select(X.snippet(t)).first()[0] == "a b"
    assert rows(spark, "t string", ("😀a",)).select(X.utf16_units(t), X.estimate_tokens(t)).first() == (3, 1)


VOCABULARY = (
    "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky "
    "relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness "
    "hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner "
    "gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate "
    "cease controll roll session sessions indexing indexed authentication authenticate queries query running runner generalizations oscillators"
).split()


def fts(texts, tokenizer="porter ascii"):
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(p, c, tokenize='{tokenizer}')")
    con.executemany("INSERT INTO t(rowid, p, c) VALUES (?, ?, ?)", texts)
    return con


def test_stems_agree_with_sqlite():
    con = fts([(i + 1, "", w) for i, w in enumerate(VOCABULARY)])
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    assert {VOCABULARY[doc - 1]: term for term, doc in con.execute("SELECT term, doc FROM v")} == {w: stem(w) for w in VOCABULARY}


def test_bm25_agrees_with_sqlite(spark):
    texts = [(1, "src/auth/session.ts", "session store for the session"), (2, "docs/login.md", "how sessions are indexed"), (3, "a.py", "index of queries"), (4, "b.py", "query running index index"), (5, "c.md", "nothing here"), (6, "session/index.go", "indexing sessions")]
    con = fts(texts)
    held = rows(spark, "chunk_id long, file_path string, content string", *texts)
    postings, lengths = textindex.build_index(held)
    for q in ("session", "index", "sessions index", "the", "query nothing"):
        want = {r: s for r, s in con.execute("SELECT rowid, -bm25(t, 5, 1) FROM t WHERE t MATCH ?", (q,))}
        got = {r.chunk_id: r.bm25 for r in textindex.bm25_scan(held, q, stemmed=True).collect()}
        assert got == pytest.approx(want, rel=1e-9)
        looked = {r.chunk_id: r.bm25 for r in textindex.bm25_lookup(postings, lengths, {1: q}, 10).collect()}
        assert looked == pytest.approx(want, rel=1e-9)
    assert textindex.query_phrases("src/a.ts foo_bar x, AND") == [["srcats"], ["foo", "bar"], ["and"]]
    assert {r.chunk_id for r in textindex.bm25_scan(held, "sessions_are", stemmed=True).collect()} == {2}
    assert textindex.bm25_scan(held, "! x").count() == 0


def test_search_modes(spark):
    chunks = rows(spark, model.CHUNKS, *[(f"c{i}", "s1" if i < 3 else "s2", f"src/m{i}.ts", 0, t, 1, 2, 3) for i, t in enumerate(["alpha beta", "beta beta gamma", "delta", "beta"])])
    emb = rows(spark, model.EMBEDDINGS, *[(f"c{i}", [1.0 if j == i else 0.0 for j in range(4)]) for i in range(4)], ("gone", [0.9, 0.0, 0.0, 0.0]))
    q = [1.0, 0.0, 0.0, 0.0]
    first = retrieval.search(chunks, emb, "beta", q, 3).collect()
    assert first[0].chunk_id == "c0" and [r.distance for r in first] == sorted(r.distance for r in first)
    assert {r.chunk_id for r in retrieval.search(chunks, emb, "beta", q, 5, scope=F.col("data_source_id") == "s2").collect()} == {"c3"}
    assert {r.chunk_id for r in retrieval.search(chunks, emb, "beta", q, 5, "fts-only").collect()} == {"c0", "c1", "c3"}
    near = [r.chunk_id for r in retrieval.search(chunks, emb, "beta", q, 2, "vector-only").collect()]
    assert near == ["c0", "c1"]
    names = rows(spark, "id string, owner string, repo string", ("s1", "o", "r"))
    page = retrieval.payload(retrieval.search(chunks, emb, "beta", q, 4), names, 0, 2).orderBy("position").collect()
    assert [r.position for r in page] == [1, 2] and page[0].repository == "o/r" and page[0].has_more


def test_batches_of_queries_equal_single_ones(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id AS chunk_id", "embedding")
    queries = emb.where("chunk_id < 3").selectExpr("chunk_id AS query_id", "embedding")
    got = vector.knn_batch(emb, queries, 4).orderBy("query_id", "rank").collect()
    for q in queries.collect():
        one = vector.knn(emb, list(q.embedding), 4).collect()
        assert [r.chunk_id for r in got if r.query_id == q.query_id] == [r.chunk_id for r in one]


def test_queries_beyond_one_block(spark):
    emb = spark.range(5000).selectExpr("id AS chunk_id", "array(cast(id AS float), 0f) AS embedding")
    got = vector.knn_batch(emb, emb.withColumnRenamed("chunk_id", "query_id"), 1).collect()
    assert len(got) == 5000 and all(r.chunk_id == r.query_id for r in got)


def test_equal_vectors_keep_the_least_ids(spark):
    emb = spark.range(3000).selectExpr("2999 - id AS chunk_id", "array(0.1f, 0.7f, 0.3f) AS embedding").coalesce(1)
    queries = spark.createDataFrame([(1, [0.2, 0.4, 0.9])], "query_id long, embedding array<float>")
    got = vector.knn_batch(emb, queries, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1, 2]


def test_cursor_and_sizes():
    c = retrieval.encode_cursor("q", "a,b", 5)
    assert retrieval.decode_cursor(c) == {"query": "q", "scopeKey": "a,b", "offset": 5} and "=" not in c
    assert retrieval.decode_cursor("!!") is None and retrieval.decode_cursor(None) is None
    assert [retrieval.page_size(x) for x in (None, 0, 2.9, 99, float("nan"))] == [5, 1, 2, 25, 5]
    assert retrieval.fetch_size(10, 10, 5) == 20


def test_tree(spark):
    held = rows(spark, "file_path string, tokens long", ("src/a.ts", 1200), ("src/deep/x/y.py", 0), ("README.md", 3))
    lines = [r.line for r in catalog.tree_rows(held, [], max_depth=2).orderBy("row").collect()]
    assert lines == [
        "src/ [dir, 2 files]",
        "  deep/ [dir, 1 file]",
        "    [1 file not shown — use path: 'deep/' or increase maxDepth]",
        "  a.ts [ts, 1,200 tokens]",
        "README.md [md, 3 tokens, docs]",
    ]
    assert [r.line for r in catalog.tree_rows(held, [], root="src/deep").orderBy("row").collect()] == ["x/ [dir, 1 file]", "  y.py [py]"]


def test_readme_and_fetch(spark):
    held = rows(spark, "s string, file_path string", ("a", "README.rst"), ("a", "readme.md"), ("b", "docs/README.md"), ("b", "Readme.MD"))
    assert {r.s: r.file_path for r in catalog.readme(held, ["s"]).collect()} == {"a": "README.rst", "b": "Readme.MD"}
    parts = rows(spark, "i int, part string", (1, "x" * 6), (2, "x" * 20), (3, "x" * 6), (4, "x"))
    got = catalog.fetch_status(parts, "i", 3, 10, 10).orderBy("i").collect()
    assert [(r.i, r.status) for r in got] == [(1, "ok"), (2, "too large"), (3, "over total")]


def test_sources(spark, tmp_path):
    held = rows(spark, "id string, owner string, repo string, branch string, status string", ("1", "Own", "Rep", "main", "ready"), ("2", "own", "x", "main", "deleting"))
    assert [r.id for r in filters.in_repository(held, "REP").collect()] == ["1"]
    assert [r.id for r in filters.in_repository(held, "rep", strict=True).collect()] == []
    assert filters.known_sources(held, held.where("id = '1'").withColumn("owner", F.lower("owner"))).count() == 1
    assert filters.stale_index({"fingerprint": "a", "vectors": "3", "width": "8"}, "a", 16)
    (tmp_path / "ok.json").write_text(json.dumps({"version": 1, "dataSources": [{"id": "a", "owner": "o", "repo": "r", "branch": "b"}]}))
    (tmp_path / "bad.json").write_text("{")
    assert [(r.id, r.type) for r in readers.config(spark, str(tmp_path / "ok.json")).collect()] == [("a", "general")]
    assert readers.config(spark, str(tmp_path / "bad.json")).count() == 0


def test_archives(spark, tmp_path):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w:gz") as t:
        for name, text in (("top/src/a.py", "a = 1"), ("top/b.md", "b")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "x.tar.gz").write_bytes(held.getvalue())
    (tmp_path / "broken.tar.gz").write_bytes(b"no archive")
    got = readers.archives(spark, str(tmp_path)).collect()
    assert sorted((r.file_path or "", r.content or "") for r in got) == [("", ""), ("b.md", "b"), ("src/a.py", "a = 1")]
    wanted = rows(spark, "file_path string", ("b.md",))
    assert readers.archives(spark, str(tmp_path), wanted).count() == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.txt").write_text("text")
    assert [(r.file_path, r["size"]) for r in readers.tree(spark, str(tmp_path / "d")).collect()] == [("f.txt", 4)]


def test_folding(spark):
    events = rows(spark, "id int, seq int, status string, error string", (1, 1, "running", None), (1, 2, "failed", "e"), (1, 3, "running", None), (2, 1, None, None))
    got = {r.id: (r.status, r.error) for r in incremental.folded(events, ["id"], ["status", "error"]).collect()}
    assert got == {1: ("running", "e"), 2: (None, None)}


def test_metrics(spark):
    ranked = rows(spark, "q int, mode string, item string, rank int", (1, "m", "a", 1), (1, "m", "b", 2), (1, "m", "c", 3), (2, "m", "x", 1))
    qrels = rows(spark, "q int, item string, grade int", (1, "b", 3), (1, "z", 1))
    got = {r.q: r for r in evaluation.query_metrics(ranked, qrels, ["q"], ["mode"], "item").collect()}
    assert (got[1].recall_1, got[1].recall_3, got[1].mrr_10, got[1].success_5) == (0, 0.5, 0.5, 1)
    assert got[1].ndcg_10 == pytest.approx((7 / 1.584962500721156) / (7 + 1 / 1.584962500721156))
    assert (got[2].recall_10, got[2].ndcg_10) == (0, 0)


def test_engine_syncs_by_changes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    first = rows(spark, model.FILES, ("s", "src/a.py", "def alpha():\n    return 1\n", 26), ("s", "docs/b.md", "# beta\ntext", 11), ("s", "x.png", "no", 2))
    assert {r.change for r in engine.sync(first).collect()} == {"added"}
    assert engine.stats().first().files == 2
    second = rows(spark, model.FILES, ("s", "src/a.py", "def alpha():\n    return 1\n", 26), ("s", "docs/c.md", "# gamma\nnew text", 16))
    kinds = {r.file_path: r.change for r in engine.sync(second).collect()}
    assert kinds == {"src/a.py": "unchanged", "docs/b.md": "deleted", "docs/c.md": "added"}
    assert {r.file_path for r in engine.chunks().collect()} == {"src/a.py", "docs/c.md"}
    assert engine.store.table("embeddings").count() == engine.chunks().count()
    assert {r.term for r in engine.store.table("postings").where("file_path = 'docs/c.md'").collect()} == {"gamma", "new", "text", "doc", "c", "md"}
    hits = engine.search("gamma", "s").orderBy("position").collect()
    assert hits[0].file_path == "docs/c.md"
    assert [r.line for r in engine.file_tree().collect()][0].startswith("docs/ [dir, 1 file]")
    with pytest.raises(ValueError, match="another search"):
        engine.search("other", cursor=retrieval.encode_cursor("gamma", "", 5))


def test_engine_searches_repositories_by_pages(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    texts = [(s, f"docs/p{i}.md", f"# sessions {i}\nindexing of {s} number {i}", 40) for s in ("1", "b/2", "3") for i in range(4)]
    engine.sync(rows(spark, model.FILES, *texts))
    blank = {f.strip().split(" ")[0]: None for f in model.SOURCES.split(", ")}
    known = [blank | {"id": i, "owner": "own", "repo": r, "branch": "main", "status": s} for i, r, s in (("1", "one", "ready"), ("b/2", "two", "ready"), ("3", "three", "deleting"))]
    engine.set_sources(spark.createDataFrame([tuple(k.values()) for k in known], model.SOURCES))
    page = engine.search("session index", page_size=3).orderBy("position").collect()
    seen = [(r.repository, r.file_path) for r in page]
    while page and page[0].next_cursor:
        page = engine.search("session index", cursor=page[0].next_cursor, page_size=3).orderBy("position").collect()
        seen += [(r.repository, r.file_path) for r in page]
    assert sorted(seen) == sorted((f"own/{n}", f"docs/p{i}.md") for n in ("one", "two") for i in range(4))
    assert {r.repository for r in engine.search("sessions", "own/two").collect()} == {"own/two"}
    scan = retrieval.search(engine.chunks(), engine.store.table("embeddings").select("chunk_id", "embedding"), "sessions", engine.provider.embed(["sessions"])[0], 20, "fts-only", stemmed=True)
    held = {r.chunk_id: r.bm25 for r in textindex.bm25_lookup(engine.store.table("postings"), engine.store.table("lengths"), {0: "sessions"}, 20).collect()}
    assert held == pytest.approx({r.chunk_id: -r.distance for r in scan.collect()})
    assert {r.file_path for r in engine.search("number_2", mode="fts-only").collect()} == {"docs/p2.md"}
    assert engine.search("indexing_number", mode="fts-only").count() == 0


def test_engine_tries_failed_files_again(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "index"))
    held = rows(spark, model.FILES, ("s", "a.txt", "fine", 4), ("s", "b.txt", "bad", 3))
    whole = chunking.chunk_files

    def failing(files, limits):
        out = whole(files, limits)
        return out.withColumn("error", F.when(F.col("content") == "bad", "cannot")).withColumn("content", F.when(F.col("error").isNull(), F.col("content")))

    monkeypatch.setattr(chunking, "chunk_files", failing)
    engine.sync(held)
    assert [(r.file_path, r.error) for r in engine.store.table("failed").collect()] == [("b.txt", "cannot")]
    assert {r.file_path for r in engine.store.table("manifest").collect()} == {"a.txt"}
    monkeypatch.setattr(chunking, "chunk_files", whole)
    assert {r.file_path: r.change for r in engine.sync(held).collect()} == {"a.txt": "unchanged", "b.txt": "added"}
    assert engine.store.table("failed").count() == 0 and {r.content for r in engine.chunks().collect()} == {"fine", "bad"}


def test_publishing_is_whole_and_excludes_others(spark, tmp_path):
    one, two = (runs.Runs(spark, str(tmp_path / "index")) for _ in range(2))
    kind = "data_source_id string, x int"
    base = one.current()
    one.publish(base, {"t": one.write(base, "t", rows(spark, kind, ("a", 1), ("b/c", 2), (None, 3)))})
    base = two.current()
    entry = two.write(base, "t", rows(spark, kind, ("a", 5)), ["a"])
    two.publish(base, {"t": entry}, {"by": "two"})
    assert sorted(r.x for r in one.table("t").collect()) == [2, 3, 5] and one.current()["meta"] == {"by": "two"}
    assert sorted(r.x for r in one.read(one.current()["tables"]["t"], ["a"]).collect()) == [5]
    with pytest.raises(OSError, match="another run"):
        one.publish(base, {"t": entry})
    assert one.current()["number"] == 2


def test_a_writer_from_an_older_base_loses_nothing(spark, tmp_path):
    """Both read the same base; the second to publish is refused, whichever sources it wrote."""
    one, two = (runs.Runs(spark, str(tmp_path / "index")) for _ in range(2))
    kind = "data_source_id string, x int"
    base, same = one.current(), two.current()
    mine = one.write(base, "t", rows(spark, kind, ("8", 8)), ["8"])
    theirs = two.write(same, "t", rows(spark, kind, ("9", 9)), ["9"])
    one.publish(base, {"t": mine}, replaced=["8"])
    with pytest.raises(OSError):
        two.publish(same, {"t": theirs})
    assert [r.x for r in two.table("t").collect()] == [8]
    two.publish(same, {"t": theirs}, replaced=["9"])
    assert sorted(r.x for r in one.table("t").collect()) == [8, 9]
    with pytest.raises(OSError):  # source 8 has changed since
        two.publish(same, {"t": two.write(same, "t", rows(spark, kind, ("8", 1)), ["8"])}, replaced=["8"])
    assert sorted(r.x for r in one.table("t").collect()) == [8, 9]


def test_many_writers_at_once_lose_nothing(spark, tmp_path):
    store, kind = runs.Runs(spark, str(tmp_path / "index")), "data_source_id string, x int"
    base = store.current()
    store.publish(base, {"t": store.write(base, "t", rows(spark, kind, ("0", 0)))})
    base = store.current()
    made = {str(i): store.write(base, "t", rows(spark, kind, (str(i), i)), [str(i)]) for i in range(1, 9)}
    threads = [threading.Thread(target=store.publish, args=(base, {"t": entry}, None, [s])) for s, entry in made.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.x for r in store.table("t").collect()) == list(range(9)) and store.current()["number"] == 9


def test_a_pointer_left_half_written_is_passed_over_in_time(spark, tmp_path, monkeypatch):
    store = runs.Runs(spark, str(tmp_path / "index"))
    base = store.current()
    store.publish(base, {"t": store.write(base, "t", rows(spark, "x int", (1,)))})
    (tmp_path / "index" / "current-000000000002.json").write_text('{"number": 2, "tab')
    with pytest.raises(OSError, match="being published"):
        store.current()
    monkeypatch.setattr(runs, "ABANDONED", 0)
    assert store.current()["number"] == 1


def test_cleaning_keeps_what_counts(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    for text in ("one", "two", "three"):
        engine.sync(rows(spark, model.FILES, ("s", "a.txt", text, 3), ("t", "b.txt", "same", 4)))
    before = len(list((tmp_path / "index").glob("run-*")))
    assert engine.clean() > 0 and len(list((tmp_path / "index").glob("run-*"))) < before
    assert {r.content for r in engine.chunks().collect()} == {"three", "same"}
    assert engine.search("same").first().file_path == "b.txt"
    ids = [r.chunk_id for r in engine.chunk_ids("t").collect()]
    assert [r.content for r in engine.chunks_by_id([*ids, "none"]).collect()] == ["same"]
    assert engine.chunk_ids("s", "a.txt").count() == 1 and engine.chunk_ids("s", "b.txt").count() == 0
    assert {r.change for r in engine.sync(rows(spark, model.FILES, ("s", "a.txt", "three", 3), ("t", "b.txt", "same", 4))).collect()} == {"unchanged"}


def test_a_delta_after_other_settings_loses_no_file(spark, tmp_path):
    root = str(tmp_path / "index")
    held = [("s", f"f{i}.txt", f"text {i}", 6) for i in range(3)]
    Engine(spark, root).sync(rows(spark, model.FILES, *held))
    more = Engine(spark, root, model.Settings(top_k=25))
    more.sync(rows(spark, model.FILES, ("s", "f1.txt", "changed", 7)), whole=False)
    assert {r.content for r in more.chunks().collect()} == {"text 0", "changed", "text 2"}
    short = Engine(spark, root, model.Settings(limits=model.ChunkLimits(max_tokens=1, overlap_tokens=0)))
    with pytest.raises(ValueError, match="other limits"):
        short.sync(rows(spark, model.FILES, ("s", "f1.txt", "a\nb", 3)), whole=False)
    assert more.chunks().count() == 3
    short.sync(rows(spark, model.FILES, *held[:2], ("s", "f9.txt", "first line\nsecond line", 22)))
    assert sorted(r.file_path for r in short.chunks().collect()) == ["f0.txt", "f1.txt", "f9.txt", "f9.txt"]


def test_another_provider_embeds_everything_anew(spark, tmp_path):
    root = str(tmp_path / "index")
    held = [("s", "a.txt", "one", 3), ("t", "b.txt", "two", 3)]
    Engine(spark, root, provider=HashProvider(8)).sync(rows(spark, model.FILES, *held))
    wide = Engine(spark, root, provider=HashProvider(64))
    with pytest.raises(ValueError, match="another provider"):
        wide.search("one")
    wide.sync(rows(spark, model.FILES, ("s", "a.txt", "three", 5)), whole=False)
    assert [len(r.embedding) for r in wide.store.table("embeddings").collect()] == [64, 64]
    assert {r.content for r in wide.chunks().collect()} == {"three", "two"}
    assert wide.search("two").first().file_path == "b.txt"


def test_engine_rebuilds_and_removes(spark, tmp_path):
    class Flaky(HashProvider):
        failed = False

        def embed(self, texts):
            if not Flaky.failed:
                Flaky.failed = True
                raise OSError("busy")
            return super().embed(texts)

    assert len(RetryingProvider(Flaky(8), wait=0.0).embed(["a", "b"])) == 2
    engine = Engine(spark, str(tmp_path / "index"))
    engine.sync(rows(spark, model.FILES, ("s", "a.txt", "one", 3), ("t", "b.txt", "two", 3)))
    wider = Engine(spark, str(tmp_path / "index"), model.Settings(dimensions=16))
    wider.rebuild_vectors()
    assert {len(r.embedding) for r in wider.store.table("embeddings").collect()} == {16}
    wider.remove("s")
    assert [r.data_source_id for r in wider.chunks().collect()] == ["t"] and wider.store.table("embeddings").count() == 1


def test_feed_leaves_other_files_alone(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    path = str(tmp_path / "in")
    long = "\n".join(f"line {i} of a long file with some words in it" for i in range(300))
    steps = [
        [("s", "long.txt", long, len(long)), ("s", "a.txt", "one", 3)],
        [("s", "a.txt", "two", 3), ("s", "b.txt", "three", 5)],
        [("s", "b.txt", None, 0), ("t", "c.txt", "four", 4)],
    ]
    for step in steps:
        rows(spark, model.FILES, *step).coalesce(1).write.mode("append").parquet(path)
        ingest.index_feed(engine, ingest.arriving(spark, path, model.FILES), str(tmp_path / "check")).awaitTermination()
        own = engine.chunks().where("file_path = 'long.txt'").orderBy("ordinal").collect()
        assert own[-1].end_line == 300 and own[0].content == long[: len(own[0].content)]
        assert {line for c in own for line in c.content.split("\n")} == set(long.split("\n"))
    assert {r.file_path: r.content for r in engine.chunks().where("file_path != 'long.txt'").collect()} == {"a.txt": "two", "c.txt": "four"}
    assert {r.file_path for r in engine.store.table("manifest").collect()} == {"long.txt", "a.txt", "c.txt"}


def test_windowed_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = ingest.windowed_counts(ingest.arriving(spark, str(tmp_path / "e"), events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r.start, r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, ingest.windowed_counts(events).collect()))


FTS = [
    ("src/alpha_beta.py", "alpha beta gamma\nbeta alpha. Alpha, beta"),
    ("docs/alpha.md", "the alpha beta beta runs running runner"),
    ("docs/gamma.md", "running alphas beta alpha beta"),
    ("beta/alpha.txt", "nothing of it; a run"),
    ("x/empty.txt", ""),
    ("x/long.txt", "beta " * 50 + "alpha " * 50),
]


@pytest.fixture(scope="module")
def searched(spark):
    held = rows(spark, "chunk_id int, file_path string, content string", *[(i, p, c) for i, (p, c) in enumerate(FTS)])
    return held, {s: [x.cache() for x in textindex.build_index(held, stemmed=s)] for s in (True, False)}


@pytest.mark.parametrize("stemmed", [True, False])
@pytest.mark.parametrize("query", ["alpha_beta", "beta_beta", "alpha beta", "alpha_beta gamma", "beta_alpha alpha_beta", "runs", "running beta_alpha", "beta_beta_beta", "alpha_nothing", "alpha alpha"])
def test_phrases_from_postings(spark, searched, query, stemmed):
    """Against the scan of all texts, and against a full-text engine of its own with the same tokens."""
    held, index = searched
    got = {r.chunk_id: r.bm25 for r in textindex.bm25_hits(*index[stemmed], query, 100, stemmed=stemmed).collect()}
    assert got == pytest.approx({r.chunk_id: r.bm25 for r in textindex.bm25_scan(held, query, stemmed=stemmed).collect()})
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE VIRTUAL TABLE t USING fts5(path, content, tokenize='{'porter ' if stemmed else ''}unicode61')")
    con.executemany("INSERT INTO t(rowid, path, content) VALUES (?, ?, ?)", [(i + 1, p.replace("_", " "), c) for i, (p, c) in enumerate(FTS)])
    asked = " AND ".join('"' + w.replace("_", " ") + '"' for w in query.split())
    want = {i - 1: -s for i, s in con.execute("SELECT rowid, bm25(t, 5.0, 1.0) FROM t WHERE t MATCH ?", (asked,))}
    assert got.keys() == want.keys()
    assert got == pytest.approx(want, rel=1e-6, abs=1e-9)


def test_postings_alone_are_read(spark, searched, tmp_path):
    _, index = searched
    for name, df in zip(("p", "l"), index[False], strict=True):
        df.sortWithinPartitions(df.columns[0]).write.parquet(str(tmp_path / name))
    hits = textindex.bm25_hits(spark.read.parquet(str(tmp_path / "p")), spark.read.parquet(str(tmp_path / "l")), "alpha_beta", 9, stemmed=False)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [alpha,beta])" in plan and "content#" not in plan.replace("content_", "")


def test_queue_takes_three_sources_at_a_time(spark, tmp_path):
    """Five sources, one of which fails and one of which is asked for again while it waits and while it runs."""
    engine = Engine(spark, str(tmp_path / "index"))
    engine.sync(rows(spark, model.FILES, ("old", "x.txt", "kept", 4)))
    lock, running, most, order = threading.Lock(), set(), [], []

    def listing(source):
        with lock:
            running.add(source)
            most.append(len(running))
            order.append(source)
        time.sleep(1)
        with lock:
            running.discard(source)
        if source == "bad":
            raise OSError("no listing")
        return rows(spark, model.FILES, (source, "a.txt", f"text of {source}", 10))

    work = queue.SourceQueue(engine, listing)
    assert [work.request(s) for s in ("s1", "s2", "bad", "s3", "s4", "s3", "s1")] == [True, True, True, True, True, False, False]
    assert work.states["s4"] == "queued" and work.wait(240)
    assert work.states == {"s1": "ready", "s2": "ready", "bad": "error", "s3": "ready", "s4": "ready"} and "no listing" in work.errors["bad"]
    assert max(most) == 3 and sorted(order[:3]) == ["bad", "s1", "s2"] and len(order) == 5
    assert {r.data_source_id: r.content for r in engine.chunks().collect()} == {"old": "kept"} | {s: f"text of {s}" for s in ("s1", "s2", "s3", "s4")}
    assert engine.store.table("embeddings").count() == 5


def test_due_sources_are_requested(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    blank = {f.strip().split(" ")[0]: None for f in model.SOURCES.split(", ")}
    now = datetime.datetime.now()
    known = [blank | {"id": i, "status": s, "sync_schedule": "daily", "last_synced_at": now - datetime.timedelta(hours=h)} for i, s, h in (("a", "ready", 30), ("b", "ready", 1), ("c", "deleting", 90))]
    engine.set_sources(spark.createDataFrame([tuple(k.values()) for k in known], model.SOURCES))
    work = queue.SourceQueue(engine, lambda s: rows(spark, model.FILES, (s, "a.txt", "x", 1)))
    assert work.request_due() == ["a"] and work.wait(120)
    assert [r.data_source_id for r in engine.chunks().collect()] == ["a"]


def test_configuration_files(spark, tmp_path):
    path = str(tmp_path / "config.json")
    sources, excludes = config.load(spark, path)
    assert sources.count() == 0 and excludes == model.DEFAULT_EXCLUDES
    blank = {f.strip().split(" ")[0]: None for f in model.SOURCES.split(", ")}
    held = [blank | {"id": i, "owner": "o", "repo": f"r{i}", "branch": "main", "include_patterns": ["**/*.md"], "status": "ready"} for i in ("b", "a")]
    config.save(spark.createDataFrame([tuple(k.values()) for k in held], model.SOURCES), path, ["**/x/**"])
    sources, excludes = config.load(spark, path)
    assert [(r.id, r.repo, r.type, r.include_patterns) for r in sources.orderBy("id").collect()] == [("a", "ra", "general", ["**/*.md"]), ("b", "rb", "general", ["**/*.md"])]
    assert excludes == ["**/x/**"] and not (tmp_path / "config.json.bak").exists()
    (tmp_path / "config.json").write_text('{"version": 1, "dataSou')
    assert config.load(spark, path)[0].count() == 0
    assert (tmp_path / "config.json.bak").read_text() == '{"version": 1, "dataSou'
    for text, valid in (('{"version": 1, "dataSources": [{"owner": "o", "repo": "r"}]}', True), ('{"version": "1", "dataSources": []}', False), ('{"version": 1, "dataSources": {}}', False), ("[]", False), ("{", False)):
        (tmp_path / "shared.json").write_text(text)
        got = config.shareable(spark, str(tmp_path / "shared.json"))
        assert (got is not None) == valid
        if valid:
            assert [(r.owner, r.repo, r.type) for r in got.collect()] == [("o", "r", "general")]
    config.write_rows(spark.range(3), str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == [{"id": 0}, {"id": 1}, {"id": 2}]
