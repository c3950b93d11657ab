"""Stateful progress and the change-set source as streams, across restarts."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest

from loamgrid.plans.engine import Engine
from loamgrid.sources import changesets
from loamgrid.streaming import ingest, progress

KINDS = progress.EVENTS


@pytest.fixture
def rocks(spark):
    key, value = next(iter(progress.ROCKSDB.items()))
    before, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, value)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(key, before)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def plain(events):
    """Event by event."""
    state, out = {}, []
    for source, seq, kind, files, done, tokens in sorted(events, key=lambda e: e[1]):
        now = state.get(source)
        if kind == "started" and (now is None or seq > now[3]):
            now = [files, done or 0, tokens or 0, seq]
        elif now is None or seq <= now[3]:
            continue
        elif kind == "file":
            now = [now[0], now[1] + 1, now[2] + (tokens or 0), seq]
        out.append((source, seq, "completed" if kind == "completed" else "running", *now[:3]))
        state[source] = None if kind == "completed" else now
    return out


DAY = datetime(2024, 5, 1)


def write(spark, path, events, at=DAY):
    spark.createDataFrame([(*e, at + timedelta(seconds=e[1])) for e in events], KINDS).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, tmp_path, quiet=timedelta(hours=24)):
    feed = spark.readStream.schema(KINDS).parquet(path)
    out = progress.progress_stream(feed, quiet)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]


def test_progress_goes_on_after_a_restart(rocks, tmp_path):
    path = str(tmp_path / "in")
    first = [("s", 1, "started", 3, None, None), ("s", 2, "file", None, None, 10), ("t", 1, "file", None, None, 5), ("s", 3, "file", None, None, None)]
    second = [("s", 3, "file", None, None, 10), ("s", 4, "file", None, None, 7), ("s", 5, "completed", None, None, None), ("t", 2, "started", 2, 1, 9), ("s", 6, "file", None, None, 1)]
    seen = []
    for batch in (first, [*second, ("t", 3, "file", None, None, 4), ("s", 7, "started", 1, 0, 0)]):
        write(rocks, path, batch)
        seen += [e for e in batch if e[:2] not in {s[:2] for s in seen}]
        got = run(rocks, path, tmp_path)  # each run starts from the checkpoint
        assert Counter(got) == Counter(plain(seen))
    assert ("s", 5, "completed", 3, 3, 17) in got and ("t", 3, "running", 2, 2, 13) in got


def test_silent_runs_are_given_up(rocks, tmp_path):
    path = str(tmp_path / "in")
    write(rocks, path, [("s", 1, "started", 3, None, None)])
    assert len(run(rocks, path, tmp_path)) == 1
    write(rocks, path, [("t", 1, "started", 1, None, None)], DAY + timedelta(days=3))
    assert ("s", 1, "given up", 3, 0, 0) in run(rocks, path, tmp_path)


def commit(root, number, files):
    """A listing of ``files`` (path to text), whose contents lie beside it; None stands for a content that is gone."""
    lines = []
    for path, text in files.items():
        where = f"blobs/{abs(hash((path, text)))}"
        if text is not None:
            (root / "blobs").mkdir(parents=True, exist_ok=True)
            (root / where).write_text(text)
        lines.append(json.dumps({"file_path": path, "sha": str(hash((path, text))), "path": where}))
    (root / f"{number}.json").write_text("\n".join(lines))


def test_change_sets_in_batches(spark, tmp_path):
    changesets.registered(spark)
    first = {f"f{i}.txt": f"text {i}" for i in range(7)}
    commit(tmp_path, 1, first)
    commit(tmp_path, 4, first | {"f1.txt": "changed", "new.txt": "ü", "lost.txt": None} | {"f2.txt": "text 2"})
    (tmp_path / "4.json").write_text("\n".join(x for x in (tmp_path / "4.json").read_text().split("\n") if '"f3.txt"' not in x))
    read = lambda **o: spark.read.format("change_sets").options(path=str(tmp_path), source="s", wait="0", filesPerPartition="2", **o).load()
    whole = read(end="1")
    assert whole.rdd.getNumPartitions() == 4
    assert {(r.file_path, r.content, r.change) for r in whole.collect()} == {(p, t, "added") for p, t in first.items()}
    got = {r.file_path: (r.content, r["size"], r.change, r.error) for r in read(start="1").collect()}
    assert got == {
        "f1.txt": ("changed", 7, "modified", None), "new.txt": ("ü", 2, "added", None), "f3.txt": (None, None, "deleted", None),
        "lost.txt": (None, None, "added", "FileNotFoundError: No such file or directory"),
    }
    assert read(start="4").count() == 0


def test_commits_stream_into_an_index(spark, tmp_path):
    """Each commit's changes reach the index once, also after a restart; what a commit does not name stays."""
    changesets.registered(spark)
    root, engine = tmp_path / "commits", Engine(spark, str(tmp_path / "index"))
    root.mkdir()
    feed = spark.readStream.format("change_sets").options(path=str(root), source="s", filesPerPartition="1").load()
    changed = feed.where("error IS NULL").select("data_source_id", "file_path", "content", "size")
    commits = [{"a.txt": "one", "b.txt": "two"}, {"a.txt": "one", "b.txt": "more", "c.txt": "three"}, {"c.txt": "three", "b.txt": "more"}]
    for number, files in enumerate(commits, 1):
        commit(root, number, files)
        ingest.index_feed(engine, changed, str(tmp_path / "check")).awaitTermination()
        assert {r.file_path: r.content for r in engine.chunks().collect()} == files
    before = engine.store.current()["number"]
    ingest.index_feed(engine, changed, str(tmp_path / "check")).awaitTermination()
    assert engine.store.current()["number"] == before
