"""Parts of the operators on their own: schedules, attention, windows, trees of html, components."""

from collections import Counter
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamgrid.llm import attention_lm, language, lm_scoring, mixing, near_join, packing, sharding
from loamgrid.llm.components import connected_components
from loamgrid.llm.html_text import main_text
from loamgrid.llm.near_join import shared_counts
from loamgrid.llm.shingles import ngram_hashes, utf8, word_hashes
from loamgrid.llm.tokens import vocabulary_path, word_tokenizer


@given(st.lists(st.floats(0.01, 100), min_size=1, max_size=12))
@settings(deadline=None, max_examples=50)
def test_pfair_is_earliest_deadline_first_within_a_block(weights):
    """Against a plain reading of the rule in fractions, and within one block of the very weights."""
    parts = [Fraction(w) for w in weights]
    shares = [p / sum(parts) for p in parts]
    done = [0] * len(parts)
    for t, (s, release, due) in zip(range(300), mixing.pfair(mixing.exact_weights(weights)), strict=False):
        released = [i for i, w in enumerate(shares) if floor(done[i] / w) <= t]
        best = min(released, key=lambda i: (ceil((done[i] + 1) / shares[i]), i))
        assert (s, release, due) == (best, floor(done[best] / shares[best]), ceil((done[best] + 1) / shares[best])) and release <= t < due
        done[s] += 1
        assert all(abs(w * (t + 1) - d) < 1 for w, d in zip(shares, done, strict=True))


@given(st.lists(st.tuples(st.integers(0, 400), st.floats(0, 5)), min_size=1, max_size=8))
def test_schedule_places_every_block_once(sources):
    rows, weights = [n for n, _ in sources], [w for _, w in sources]
    slots = [p.start + t for p in mixing.schedule(rows, weights, 16) for t in p.pattern]
    assert sorted(slots) == list(range(sum(-(-n // 16) for n in rows)))


def test_mixture_follows_the_schedule(spark, monkeypatch):
    """Positions and whole rows against the schedule laid out by hand, with blocks that grow beyond a bound."""
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 40)
    counts = {"a": 500, "b": 90, "c": 7, None: 30}
    rows = [(i, s, f"text {i}", "clash") for i, s in enumerate(x for x, n in counts.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, position string")
    targets = {"a": 0.5, "b": 0.3, "c": 0.2, None: 0.1}
    size = -(-len(rows) // 40)
    got = sorted(mixing.mix_sources(docs, targets).collect(), key=lambda r: r.position)
    left, done, want, phase = dict(counts), dict.fromkeys(counts, 0), [], 0
    while any(left.values()):
        alive = sorted((s for s in left if left[s]), key=lambda s: (s is not None, s or ""))
        local = dict.fromkeys(alive, 0)
        share = {s: Fraction(targets[s]) / sum(Fraction(targets[x]) for x in alive) for s in alive}
        t, over = 0, False
        while not over:
            best = min((s for s in alive if floor(local[s] / share[s]) <= t), key=lambda s: (ceil((local[s] + 1) / share[s]), alive.index(s)))
            n = min(size, left[best])
            want += [(best, done[best], phase)] * n
            local[best], done[best], left[best], t = local[best] + 1, done[best] + 1, left[best] - n, t + 1
            over = left[best] == 0
        phase += 1
    assert [(r.source, r.block, r.phase) for r in got] == want
    assert [r.position for r in got] == list(range(len(rows)))
    whole = mixing.mixed_documents(docs, targets)
    assert whole.columns == docs.columns
    assert [tuple(r) for r in whole.collect()] == [tuple(r.row) for r in got]


def test_neighbours_are_those_of_plain_bm25():
    draw = np.random.default_rng(6)
    docs = [draw.zipf(1.3, draw.integers(1, 90)).clip(0, 200).astype(np.uint16) for _ in range(120)] + [np.zeros(0, np.uint16)] * 2
    df = np.zeros(packing.VOCABULARY)
    for d in docs:
        df[np.unique(d)] += 1
    idf, mean = np.log1p((len(docs) - df + 0.5) / (df + 0.5)), np.mean([len(d) for d in docs])

    def bm25(query, doc):
        words = Counter(doc.tolist())
        norm = packing.K1 * (1 - packing.B + packing.B * len(doc) / mean)
        return sum(idf[t] * words[t] * (packing.K1 + 1) / (words[t] + norm) for t in set(query.tolist()) if t in words)

    index = packing.Index(docs, idf, mean)
    for i in (0, 5, 121):
        assert np.allclose(index.scores(i), [bm25(docs[i], d) for d in docs])
    pieces = packing.pack(np.array([len(d) + 1 for d in docs]), index, 256)
    used, seed = set(), None
    for doc, start, _, _, offset in pieces:
        if offset == 0:
            seed = doc
        elif start == 0:
            score = index.scores(seed)
            assert doc == min((i for i in range(len(docs)) if i not in used), key=lambda i: (-score[i], i))
        used.add(doc)


def test_shards_hold_close_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 3000)
    draw = np.random.default_rng(7)
    topics = [[f"{c}{i}word" for i in range(60)] for c in "abcdef"]
    rows = [(i, " ".join(draw.choice(topics[i % 6], 120))) for i in range(180)] + [(1000 + i, "one long copy " * 200) for i in range(60)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    filled = got.groupby("sequence_id").length.sum()
    size = got.groupby(got.sequence_id // (1 << 28)).length.sum()
    assert filled.max() <= packing.WINDOW and len(size) > 6 and size.max() < 4 * 3000
    topic = got[got.doc_id < 1000].assign(topic=got.doc_id % 6).groupby("sequence_id").topic.nunique()
    assert (topic == 1).mean() > 0.5


def test_written_shards_keep_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50), "s", "l") for i in range(400)] + [(None, None, "s", "l")], "doc_id long, text string, shard string, lane string")
    name = sharding.write_shards(docs, f"{tmp_path}/out", 5)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert name == "shard_" and sorted(back.columns) == sorted([*docs.columns, name])
    assert sorted(map(tuple, back.select(docs.columns).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    same = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 5).collect()}
    assert {r.doc_id: r[name] for r in back.select("doc_id", name).collect()} == same


def brute_log(model, ids):
    """log10 probability of a text, id by id, with plain loops over its context."""
    w, c = model.weights, attention_lm.CONTEXT
    total = 0.0
    for t, y in enumerate([*ids, attention_lm.END]):
        places = range((t // c) * c - c, t + 1)
        e = w["embed"][[model.slot[ids[p - 1] if p > 0 else attention_lm.START] for p in places]].astype(float)
        a = (e @ w["key"]) @ (e[-1] @ w["query"]) / np.sqrt(attention_lm.KEY) + [w["bias"][t - p] for p in places]
        a = np.exp(a - a.max())
        h = e[-1] + (a / a.sum()) @ (e @ w["value"])
        h = h + np.maximum(h @ w["enter"] + w["enter_bias"], 0) @ w["leave"]
        row = model.slot[y]
        g = model.group_of[row]
        lo, hi = model.edges[g], model.edges[g + 1]
        z, v = h @ w["group"] + w["group_bias"], w["within"][lo:hi] @ h + w["within_bias"][lo:hi]
        total += z[g] - np.log(np.exp(z).sum()) + v[row - lo] - np.log(np.exp(v).sum())
        total += np.log(10) * model.spare if row == len(model.group_of) - 1 else 0
    return total / np.log(10)


def test_attention_is_a_distribution_and_causal():
    draw = np.random.default_rng(0)
    ids, rows = draw.integers(0, 50, 4000).astype(np.uint16), np.arange(0, 4001, 100)
    model = attention_lm.train(ids, rows, np.bincount(ids, minlength=attention_lm.VOCABULARY))
    texts = [ids[:1], ids[:15], ids[:16], ids[:64], ids[100:170], np.array([7, 48_000, 3], np.uint16), ids[:0]]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.score(np.concatenate(texts), at)
    assert np.allclose(got, [brute_log(model, t.tolist()) for t in texts], rtol=1e-4)
    assert np.allclose(got, [model.score(t, np.array([0, len(t)]))[0] for t in texts], rtol=1e-5)
    # All ids that may follow a context have probabilities that sum to one: those of a text's last id, without its end.
    every = np.arange(attention_lm.VOCABULARY)
    row = model.slot[every]
    w, h = model.weights, np.ones((1, attention_lm.WIDTH), np.float32)
    order = np.argsort(row, kind="stable")
    goal = row[order]
    logs, _ = model._logs(w, np.repeat(h, len(every), axis=0), goal, np.searchsorted(goal, model.edges))
    logs = logs + np.where(goal == len(model.group_of) - 1, model.spare * np.log(10), 0)
    assert abs(np.exp(logs.astype(float)).sum() - 1) < 1e-3


@pytest.mark.parametrize("back", [0, attention_lm.CONTEXT])
def test_gradients(back):
    draw = np.random.default_rng(1)
    ids, rows = draw.integers(0, 30, 300).astype(np.uint16), np.array([0, 100, 110, 300])
    model = attention_lm.first_weights(ids, rows, np.bincount(ids, minlength=attention_lm.VOCABULARY))
    number = np.arange(attention_lm.window_count(rows, back).sum())
    given, target, _ = attention_lm.windows(ids, rows, number, back)
    assert sorted(target[target >= 0].tolist()) == sorted([*ids.tolist(), *[attention_lm.END] * 3])
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    grads = model.gradients(w, model.slot[given], target)

    def loss(weights):
        distance, hidden = attention_lm._mask(back)
        e = weights["embed"][model.slot[given]]
        last = e[:, back:]
        a = attention_lm._attention(last @ weights["query"] / np.sqrt(attention_lm.KEY), e @ weights["key"], weights["bias"][distance] + hidden)
        h = (last + a @ (e @ weights["value"])).reshape(-1, attention_lm.WIDTH)
        order, goal, cuts = model._sorted(target)
        return -model._logs(weights, attention_lm._hidden(weights, h[order])[2], goal, cuts)[0].mean()

    for name in attention_lm.WEIGHTS:
        for at in [tuple(draw.integers(0, s) for s in w[name].shape) for _ in range(3)]:
            moved = [{**w, name: w[name].copy()} for _ in range(2)]
            moved[0][name][at] += 1e-4
            moved[1][name][at] -= 1e-4
            assert abs((loss(moved[0]) - loss(moved[1])) / 2e-4 - grads[name][at]) < 2e-4, name


@settings(deadline=None)
@given(st.lists(st.text("aB é!\n", max_size=30), max_size=8))
def test_words_do_not_depend_on_their_neighbours(texts):
    data, rows = utf8(pa.array([t.lower() for t in texts], pa.string()))
    words, at = word_hashes(data, rows)
    for i, t in enumerate(texts):
        own, _ = word_hashes(*utf8(pa.array([t.lower()], pa.string())))
        assert own.tolist() == words[at[i] : at[i + 1]].tolist()
    grams, starts = ngram_hashes(words, at, 3)
    assert [int(x) for x in np.diff(starts)] == [max(n - 2, min(n, 1)) for n in np.diff(at)]


def test_shared_counts():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 3000, draw.integers(0, 900)).astype(np.uint64)) for _ in range(20)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = shared_counts(sets)
    assert all(got[i, j] == want[i][j] for i in range(20) for j in range(20) if i != j)


def test_components(spark):
    draw = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4300)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((root(a), root(b)))
        parent[hi] = lo
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=30))
@settings(deadline=None, max_examples=30)
def test_packing_lays_each_id_once(lengths):
    draw = np.random.default_rng(len(lengths))
    docs = [draw.integers(0, 40, n - 1).astype(np.uint16) for n in lengths]
    pieces = packing.pack(np.array(lengths), packing.Index(docs, np.ones(packing.VOCABULARY), 100.0))
    done = dict.fromkeys(range(len(lengths)), 0)
    for d, start, n, _, _ in pieces:
        assert done[d] == start and n > 0
        done[d] += n
    assert done == dict(enumerate(lengths))
    filled: dict[int, int] = {}
    for _, _, n, seq, offset in pieces:
        assert filled.get(seq, 0) == offset
        filled[seq] = offset + n
    assert sum(v != packing.WINDOW for v in filled.values()) <= 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a>x</a></nav><article><h1>T</h1><p>One  &amp; two</p><p>three<br>four</article><footer>f</footer>", "T\n\nOne & two\n\nthree four"),
        ("<div id=comments><p>I think this is a long comment on the page</p></div><article><p>Short text.</p></article>", "Short text."),
        ("<article><p>Text<script>x()</script> here<style>y</style></p><form>Name <input></form></article>", "Text here"),
        ("<!-- <p>no</p> --><p>yes</p>", "yes"),
        ("<p>a &lt; b &#233; &nbsp; c</p>", "a < b é c"),
        ("<header><h1>Site</h1></header><div class=post><h1>Title</h1><p>The article has one paragraph of text, long enough.</p></div>", "Title\n\nThe article has one paragraph of text, long enough."),
        ("<div class='page has-sidebar'><h1>T</h1><p>Some text that is the article.</p><div class=sidebar><p>Other things to read here.</p></div></div>", "T\n\nSome text that is the article."),
        ("<article><p>Body of text.</p></article><div class=related><article><p>Another teaser text that is longer than the body.</p></article></div>", "Body of text."),
        ("<div class=cookie-notice><p>We use cookies on this site to annoy you at length.</p></div><main><p>Main text.</p><section class=comments><p>Nice!</p></section></main>", "Main text."),
        ("<p>x</p><table><tr><td>a<td>b</table>", "x\n\na\n\nb"),
        ("", ""),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("scale", [1, 30, 1000])
def test_softmax_of_any_size(scale):
    draw = np.random.default_rng(4)
    z = (draw.standard_normal((50, 7)) * scale).astype(np.float32)
    at = np.arange(50), draw.integers(0, 7, 50)
    log, exps, sums = attention_lm._softmax(z.copy, at)
    exact = z.astype(np.float64) - z.max(axis=1, keepdims=True)
    exact -= np.log(np.exp(exact).sum(axis=1, keepdims=True))
    assert np.allclose(log, exact[at], rtol=1e-5, atol=1e-5) and np.allclose(exps / sums[:, None], np.exp(exact), atol=1e-6)
    q, k = draw.standard_normal((2, 3, 4, 5)).astype(np.float32) * np.float32(np.sqrt(scale))
    a = attention_lm._attention(q, k, np.where(np.tri(4) > 0, 0, -1e9).astype(np.float32))
    assert np.isfinite(a).all() and np.allclose(a.sum(axis=2), 1, atol=1e-5) and (a[:, np.tri(4) == 0] == 0).all()


def test_groups_of_unequal_size_give_the_same_gradients():
    draw = np.random.default_rng(5)
    ids, rows = draw.integers(0, 40, 500).astype(np.uint16), np.array([0, 500])
    model = attention_lm.first_weights(ids, rows, np.bincount(ids, minlength=attention_lm.VOCABULARY))
    assert len(set(np.diff(model.edges).tolist())) > 1 and (np.diff(model.padded.ravel()[model.padded.ravel() < model.edges[-1]]) == 1).all()
    y = draw.integers(0, 40, (1, 200))
    order, goal, cuts = model._sorted(y)
    w, h = model.weights, draw.standard_normal((200, attention_lm.WIDTH)).astype(np.float32)
    log, g = model._logs(w, h, goal, cuts, True)
    for k, (lo, hi) in enumerate(zip(model.edges, model.edges[1:], strict=False)):
        own = h[cuts[k] : cuts[k + 1]]
        v = own.astype(float) @ w["within"][lo:hi].T + w["within_bias"][lo:hi]
        p = np.exp(v - np.log(np.exp(v).sum(axis=1, keepdims=True)))
        p[np.arange(len(own)), goal[cuts[k] : cuts[k + 1]] - lo] -= 1
        assert np.allclose(g["within"][lo:hi], p.T @ own / 200, atol=1e-6) and np.allclose(g["within_bias"][lo:hi], p.sum(axis=0) / 200, atol=1e-6)


def test_blocks_of_any_size_give_the_same_results(monkeypatch):
    draw = np.random.default_rng(7)
    ids, rows = draw.integers(0, 300, 6000).astype(np.uint16) ** 2 % 300, np.array([0, 0, 2500, 2501, 6000])
    model = attention_lm.first_weights(ids, rows, np.bincount(ids, minlength=attention_lm.VOCABULARY))
    for back in (0, attention_lm.CONTEXT):
        given, target, _ = attention_lm.windows(ids, rows, np.arange(attention_lm.window_count(rows, back).sum()), back)
        got = []
        for block in (1, 100, 1 << 20):
            monkeypatch.setattr(attention_lm, "BLOCK", block)
            got.append((model.gradients(model.weights, model.slot[given], target), model.score(ids, rows)))
        for grads, score in got[1:]:
            assert np.allclose(score, got[0][1], rtol=1e-5)
            assert all(np.allclose(grads[k], got[0][0][k], rtol=1e-3, atol=1e-6) for k in attention_lm.WEIGHTS)


def test_attention_learns_from_all_training_texts(spark, monkeypatch):
    draw = np.random.default_rng(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = [" ".join(words[(s + j) % 6] for j in range(40)) for s in draw.integers(0, 6, 300)] + [" ".join(words * 500)]
    monkeypatch.setattr(lm_scoring, "SHARD_ROWS", 50)
    ids, rows = word_tokenizer(vocabulary_path())(texts)
    counts = np.bincount(ids, minlength=attention_lm.VOCABULARY)
    held = [(i, bytes(ids[a:b].astype("<u2"))) for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True))]
    learned = spark.createDataFrame(held, "i long, ids binary").selectExpr("xxhash64(i) AS spread", "ids")
    first = attention_lm.train(ids[: rows[3]], rows[:4], counts)
    model, windows = lm_scoring.learn_all(first, learned, len(texts))
    assert windows == attention_lm.window_count(rows, attention_lm.TRAIN_BACK).sum()
    assert model.score(ids, rows).sum() > first.score(ids, rows).sum()
    again, _ = lm_scoring.learn_all(first, learned.repartition(7), len(texts))
    assert np.allclose(again.score(ids, rows), model.score(ids, rows), rtol=1e-4)


def test_samples_do_not_vanish_at_scale():
    for n in (1, 300, 10**6, 5 * 10**10, 10**15):
        share = language.sample_bound(400, n) / 2**63
        assert 0 < share <= 1 and (share == pytest.approx(min(1, 320 / n), rel=1e-6))


def test_more_languages_than_bits_of_a_word():
    draw = np.random.default_rng(3)
    letters = [chr(c) for c in range(0x61, 0x7B)]
    texts = {f"l{i:03}": [" ".join("".join(draw.choice(letters, 5)) for _ in range(8)) * 3] * 3 for i in range(150)}
    filters = language.learn(texts)
    names, _, _ = language.predictions(filters, pa.array([t[0] for t in texts.values()]))
    assert names == sorted(texts) and len(filters.tables) == 3


@pytest.mark.parametrize(("whole", "tile"), [(16, 24), (256, 1024)])
def test_large_components_lose_no_link(spark, monkeypatch, whole, tile):
    """Three families of near copies and loose relatives, against brute force; small tiles force the differences' path."""
    monkeypatch.setattr(near_join, "WHOLE_ROWS", whole)
    monkeypatch.setattr(near_join, "TILE_ROWS", tile)
    draw = np.random.default_rng(5)
    texts = []
    for family in range(3):
        base = [f"w{family}x{i}" for i in range(120)]
        for _ in range(70):
            own = list(base)
            for _ in range(int(draw.integers(0, 5))):
                own[int(draw.integers(0, len(own)))] = f"e{int(draw.integers(0, 40))}"
            texts.append(" ".join(own[: int(draw.integers(90, 121))]))
    sets = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for t in texts]
    linked = np.array([[i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    component = np.arange(len(texts))
    for _ in range(len(texts)):
        component = np.array([min([component[i], *component[linked[i]]]) for i in range(len(texts))])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_join.ngram_jaccard_join(df).toPandas().set_index("doc_id").loc[np.arange(len(texts))]
    assert got.n_links.tolist() == linked.sum(axis=1).tolist() and got.class_id.tolist() == component.tolist()
    assert linked.sum() > 2000


def test_schedule_keeps_the_real_targets():
    rows, weights = [16 * 40_000, 16 * 9000, 16 * 20], [float(3333) ** 0.7, float(351) ** 0.7, 0.05]
    plan = [p for p in mixing.schedule(rows, weights, 16) if p.phase == 0]
    slots = max(max(p.pattern) for p in plan) + 1
    assert slots > 40_000
    for s, w in enumerate(weights):
        own = np.array(sorted(t for p in plan if p.source == s for t in p.pattern))
        times = np.arange(1, slots + 1)
        assert np.abs(w / sum(weights) * times - np.searchsorted(own, times)).max() < 1
