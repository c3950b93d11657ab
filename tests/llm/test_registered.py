"""Registered queries against brute force, exact round trips and held-out accuracy, on whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loamgrid.llm import html_text, lm_scoring
from loamgrid.llm.registry import QUERIES
from loamgrid.llm.tables import read_table

WORDS = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in read_table(spark, D, "documents").collect()}


def grams(text):
    w = WORDS.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_op1(spark, texts):
    sets, holders = {k: grams(t) for k, t in texts.items()}, defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    parent, links = {k: k for k in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for o, n in Counter(o for g in s for o in holders[g]).items():
            if o != k and n / (len(s) + len(sets[o]) - n) >= 0.8:
                links[k] += 1
                a, b = root(k), root(o)
                parent[max(a, b)] = min(a, b)
    got = QUERIES["op1_ngram_jaccard_join"](spark, D).collect()
    assert {(r.doc_id, r.n_links, r.class_id) for r in got} == {(k, links[k], root(k)) for k in sets}


def test_op2(spark, texts):
    got = QUERIES["op2_sharding"](spark, D).toPandas()
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    sizes = got.groupby("shard")["size"].sum()
    total, below = sizes.sum(), sizes.sort_index().cumsum().to_numpy()
    off = np.abs(below - total * np.arange(1, 41) / 40)
    assert len(sizes) == 40 and off.max() <= max(0.001 * total / 40, got["size"].max())
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)


def brute_links(x, label, ids):
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    component = ids.copy()
    while True:
        new = np.array([min([component[i], *component[linked[i]]]) for i in range(len(ids))])
        if (new == component).all():
            return linked.sum(axis=1), component
        component = new


@pytest.mark.parametrize("tile", [512, 40])
def test_op3(spark, tmp_path, tile, monkeypatch):
    """The given vectors, with copies, near copies and a chain planted among them, and all moved by a common mean."""
    from loamgrid.llm import vector_dedup

    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rows = read_table(spark, D, "embeddings").toPandas()
    x, label, ids = np.array(rows.embedding.tolist(), np.float32), rows.label.to_numpy(), rows.vec_id.to_numpy()
    draw = np.random.default_rng(4)
    x = x[:1200] + x.std() * 2
    label, ids, scale = label[:1200], ids[:1200], x.std()
    near = [x[i] + draw.standard_normal(x.shape[1]).astype(np.float32) * scale * r for i, r in zip(draw.integers(0, 400, 300), draw.uniform(0.01, 0.4, 300), strict=True)]
    chain = [x[5] + draw.standard_normal(x.shape[1]).astype(np.float32) * scale * 0.02 * k for k in range(30)]
    x = np.concatenate([x, x[:50], near, chain]).astype(np.float32)
    label = np.concatenate([label, label[:50], draw.choice(label, 300), np.full(30, label[5])])
    ids = np.arange(len(x), dtype=np.int64) * 7 + 3
    links, component = brute_links(x.astype(float), label, ids)
    assert (links > 0).sum() > 100 and len(np.unique(component)) > 100
    kind = read_table(spark, D, "embeddings").schema
    held = spark.createDataFrame([(int(i), v.tolist(), int(n)) for i, v, n in zip(ids, x, label, strict=True)], "vec_id long, embedding array<float>, label int")
    assert {"vec_id", "embedding", "label"} <= set(kind.names)
    held.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op3_embedding_dedup"](spark, str(tmp_path)).toPandas().set_index("vec_id").loc[ids]
    assert (got.n_links.to_numpy() == links).all() and (got.component_id.to_numpy() == component).all()


def test_op4(spark, texts):
    from tokenizers import Tokenizer

    from loamgrid.llm.tokens import vocabulary_path

    tok = Tokenizer.from_file(vocabulary_path())
    ids = dict(zip(texts, [[*e.ids, 1] for e in tok.encode_batch(list(texts.values()), add_special_tokens=False)], strict=True))
    got = QUERIES["op4_packing"](spark, D).toPandas()
    pieces = defaultdict(list)
    for r in got.itertuples():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (zlib.crc32(part.tobytes()), len(part), len(ids[r.doc_id])) == (r.ids_crc32, r.length, r.doc_tokens)
        pieces[r.doc_id].append((r.start, r.length))
    for k, v in pieces.items():
        v.sort()
        assert [s for s, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1].tolist()] and sum(n for _, n in v) == len(ids[k])
    assert pieces.keys() == texts.keys()
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= 2048 and filled.sum() / (2048 * len(filled)) > 0.99
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


def article(page):
    import html

    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", p)).split()) for p in re.split("</?p>|</?h1>", inner))
    return "\n\n".join(p for p in parts if p)


def test_op5(spark):
    pages = {r.page_id: r.html for r in read_table(spark, D, "pages").collect()}
    for r in QUERIES["op5_html_extraction"](spark, D).collect():
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_op5_finds_articles_by_density(spark):
    """The same pages without the element, with class names that say nothing, and without any prior."""
    pages = [r.html for r in read_table(spark, D, "pages").collect()]
    want = [article(p) for p in pages]
    plain = [re.sub(r"<(/?)article>", r"<\1div>", p) for p in pages]
    assert [html_text.main_text(p) for p in plain] == want
    nameless = [p.replace('class="ad"', 'class="x1"') for p in plain]
    assert np.mean([html_text.main_text(p) == w for p, w in zip(nameless, want, strict=True)]) >= 0.97
    assert np.mean([html_text.main_text(p, prior=False) == w for p, w in zip(nameless, want, strict=True)]) >= 0.95


def test_op5_reads_long_pages():
    many = "".join(f"<p>Paragraph number {i} of a long page &amp; more.</p>" for i in range(20_000))
    got = html_text.main_text(f"<body><div><a href=x>menu</a></div><div>{many}</div><div><a href=y>end</a></div></body>")
    assert got.count("\n\n") == 19_999 and got.startswith("Paragraph number 0 of a long page & more.")


def test_op6(spark):
    quality = {r.doc_id: r.quality for r in read_table(spark, D, "labels").collect()}
    got = [r for r in QUERIES["op6_quality"](spark, D).collect() if r.held_out and r.doc_id in quality]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert sum(r.predicted == quality[r.doc_id] for r in got) / len(got) > 0.93


def test_op7(spark):
    lang = {r.doc_id: r.lang for r in read_table(spark, D, "documents").collect()}
    got = [r for r in QUERIES["op7_language"](spark, D).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) / len(got) > 0.98


def test_op8(spark, texts):
    got = QUERIES["op8_mixing"](spark, D).toPandas()
    assert sorted(got.doc_id) == sorted(texts) and sorted(got.position) == list(range(len(texts)))
    assert ((got.slot >= got.release) & (got.slot < got.due)).all()


@pytest.mark.parametrize("frequent", [200_000, 3000])
def test_op9(spark, texts, frequent, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    split, low = re.compile(r"[^\x20\x09-\x0D]+"), {i: i + 32 for i in range(65, 91)}
    tokens = {k: [*split.findall(t.translate(low)), None] for k, t in texts.items()}
    count = Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in ws)
    total = sum(count.values())
    rows = QUERIES["op9_lm_scoring"](spark, D).collect()
    new = [r for r in rows if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new) and sum(r.score > r.base_score for r in new) > len(new) / 2
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)


def test_op10(spark, texts):
    rows = sorted(texts.items())
    wrong = []
    got = {r.doc_id: r for r in QUERIES["op10_fingerprints"](spark, D).collect()}
    for i, (k, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        changed = t[: len(t) - q] + after[:q]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        wrong += [abs(got[k].near_edited - jaccard(grams(t), grams(changed))), abs(got[k].near_next - jaccard(grams(t), grams(after)))]
    assert max(wrong) < 0.25 and np.mean(wrong) < 0.05
    same = defaultdict(set)
    for k, t in rows:
        same[t].add(got[k].fingerprint)
    assert all(len(v) == 1 for v in same.values())
