"""The pipeline's stages, each against what its own input demands."""

from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from loamgrid.llm import packing
from loamgrid.llm.tables import read_table, stored

from .test_registered import grams, jaccard

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read_table(spark, D, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], D)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    label = {r.doc_id: r.quality for r in read_table(spark, D, "labels").collect()}
    kept = set(texts(stages[1]))
    good = [k for k, q in label.items() if q == 1]
    bad = [k for k, q in label.items() if q == 0]
    assert sum(k in kept for k in good) / len(good) > 0.95 and sum(k in kept for k in bad) / len(bad) < 0.5


def test_language_keeps_lettered_texts(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert {k for k, t in before.items() if sum(c.isalpha() for c in t) > 20} <= after.keys()


def test_one_of_each_class_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    sets = {k: grams(t) for k, t in before.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert set(after) == {k for k in sets if root(k) == k} and all(after[k] == before[k] for k in after)


def test_mixing_keeps_all_rows(stages):
    assert texts(stages[3]) == texts(stages[4]) and stages[3].count() == stages[4].count()
    first = [r.source for r in stages[4].collect()[:40]]
    assert len(set(first)) > 1


def test_packing_covers_all_documents(stages):
    laid = defaultdict(int)
    total = {}
    for r in stages[5].collect():
        laid[r.doc_id] += r.length
        total[r.doc_id] = r.doc_tokens
    assert laid == total and laid.keys() == texts(stages[4]).keys()


def test_packing_follows_the_mixture(spark, stages, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 20_000)
    order = {r.doc_id: (r.file_name, r.row_index) for r in stages[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()}
    last = defaultdict(list)
    for r in packing.pack_documents(stages[4], in_order=True).collect():
        last[r.sequence_id >> 28].append(order[r.doc_id])
    shards = [last[k] for k in sorted(last)]
    assert len(shards) > 3 and all(max(a) < min(b) for a, b in zip(shards, shards[1:], strict=False))


def test_run_is_registered(spark, stages):
    assert __spark_entry__.queries()["pipeline"](spark, D).count() == stages[5].count()
