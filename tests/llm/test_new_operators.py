"""Quality rules, spelling variants and lexical search against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import language, lexical_search, quality_rules, spelling
from loamgrid.llm.tables import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "word", "n", "term", "tf", "lane", "m", "rules", "item", "score", "rank", "w", "l", "lo", "hi", "outer"]
LONG = "many different words, " * 30_000
ROWS = [
    (1, "the sea and the shore. " * 3 + "Colour colour colour.\ncolor color\n\ncolor", None),
    (2, "the sea and the shore. " * 3 + "Colour colour colour.\ncolor color\n\ncolor", "en"),
    (3, None, "en"),
    (4, "", "en"),
    (5, "  \n \t ", "de"),
    (6, LONG, "en"),
    (7, "Élan élan ÉLAN straße strasse \U0001f4a1 ünïcode « text »", "fr"),
    (None, "colours colours colours colours", "en"),
    (None, "colours colours colours colours", "en"),
    (8, "a" * 70_000 + " " + "a" * 69_999 + " ...\n* x\n- y\n…", "xx"),
    (9, "a" * 70_000 + " " + "a" * 69_999, "xx"),
    (10, "a" * 70_000 + " " + "a" * 69_999, "xx"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "s", None) for i, t, lang in ROWS]
    return stored(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH}))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words),
        "n_lines": len(lines),
        "n_bullet_lines": sum(x.strip(" \t")[0] in "-*•" for x in lines if x.strip(" \t")),
        "n_stop_words": sum(w.lower() in quality_rules.STOP_WORDS for w in words),
    }


def test_rules_against_plain_counts(docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, tuple(sorted(plain_rules(t).items()))) for i, t, _ in ROWS)
    names = plain_rules("").keys()
    assert Counter((r.doc_id, tuple(sorted((k, r[k]) for k in names))) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_rules_of_a_table(docs, none):
    rules = (quality_rules.Rule("few", "n_words", most=60), quality_rules.Rule("plain", "n_symbols", "n_words", most=0))
    text = " ".join(f"w{i}" for i in range(60))
    rows = docs.sparkSession.createDataFrame([(1, text), (2, text + " x"), (3, text[:-1] + "#")], "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.failed) for r in quality_rules.quality_rules(rows, rules=rules).collect()}
    assert got == {1: (True, ""), 2: (False, "few"), 3: (False, "plain")}
    assert quality_rules.quality_rules(none).count() == 0
    held = quality_rules.apply_rules(docs)
    assert set(docs.columns) < set(held.columns) and held.count() == len(ROWS)


def test_rules_stay_in_the_jvm(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def plain_words(rows):
    held = Counter()
    for i, text in rows:
        for run, n in Counter(re.findall("[A-Za-zÀ-ÿ]+", text or "")).items():
            low = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            held[low] += n
    return {w: n for w, n in held.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    """By striking out each place of each word."""
    holders = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holders[w[:i], i, w[i + 1 :]].add(w)
    near = defaultdict(set)
    for held in holders.values():
        for w in held:
            near[w] |= held - {w}
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def variants(df, **how):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(df, **how).collect()}


def test_variants_of_a_corpus(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert variants(df) == plain_variants(plain_words(rows))


@pytest.mark.parametrize("tile", [2, 16, 256])
def test_variants_of_crowded_words(spark, tile):
    """Few letters and shared halves, so blocks are cut down to two places."""
    draw = random.Random(5)
    words = ["".join(draw.choices("abé", k=draw.randint(4, 8))) for _ in range(500)] + ["prefixes" + "".join(draw.choices("xyz", k=4)) for _ in range(80)]
    rows = [(i, " ".join(draw.choices(words, k=400))) for i in range(12)]
    got = variants(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile)
    assert got == plain_variants(plain_words(rows))
    assert any(v[0] for v in got.values())


def test_blocks_stay_small(spark):
    """Ten times the words that share a half give about ten times the blocked rows, in blocks of bounded size."""
    letters = [a + b + c for a in "abcdefghijklm" for b in "nopqrstuvwxyz" for c in "abcdefghij"]
    sizes = []
    for n in (160, 1600):
        words = stored(spark.createDataFrame([("samestart" + x, 3) for x in letters[:n]], "word string, n long"))
        laid = spelling.tiles(words, 64)
        sizes.append(laid.count())
        most = laid.groupBy(*spelling.KEY).agg(F.count("*").alias("k"), F.max(F.col("hi") - F.col("lo")).alias("width")).where("width > 2").agg(F.max("k")).first()[0]
        assert most <= 64
    assert sizes[1] <= 30 * sizes[0]


def test_variants_edges(docs, none):
    got = variants(docs)
    assert got == plain_variants(plain_words([(i, t) for i, t, _ in ROWS]))
    assert got["a" * 70_000][3] == 1
    assert variants(none) == {}


def test_crcs():
    draw = np.random.default_rng(3)
    words = [bytes(draw.integers(97, 123, k, dtype=np.uint8)) for k in (1, 5, 63, 64, 65, 300, 2)]
    data, edges = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    seed = np.array([zlib.crc32(b"7:")] * len(words), np.uint32)
    assert spelling.crcs(seed, data, edges[:-1], np.diff(edges)).tolist() == [zlib.crc32(b"7:" + w) for w in words]


def test_near_pairs():
    words = ["abcde", "abxde", "abde", "abcdef", "xabcde", "abced", "abcxy", "éabcde"]
    ahead, back, length = spelling.code_points(pa.array(words))
    near, _ = spelling.near_pairs(ahead, back, length, np.zeros(7, int), np.arange(1, 8))
    assert near.tolist() == [True, True, True, True, False, False, True]


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plain_search(rows, items, k):
    held = [(i, Counter(terms(t))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = set(terms(text)) & df.keys()
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        scored = []
        for i, c, n in held:
            m = 50 + (50 * n * n_docs) // n_terms
            score = sum(w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return out


def found(docs, items, k=50, **how):
    return lexical_search.search(lexical_search.build_index(docs, **how), items, k).collect()


def test_search_of_a_corpus(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert sorted(map(tuple, found(docs, items))) == sorted(want)


def test_search_ties_and_small_blocks(spark, monkeypatch):
    """Copies tie in one stratum over many blocks; passes, halves of sums and steps are all cut small."""
    draw = random.Random(2)
    vocabulary = [f"t{i}" for i in range(40)]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([3, 9, 9, 30])))) for i in range(300)]
    rows += [(1000 - i, "t1 t2 t3 t3 t4 unique") for i in range(200)] + [(7, "t1 t2"), (7, "t1 t2"), (None, "unique t1"), (None, None)]
    items = [(i, " ".join(draw.choices(vocabulary, k=5)) + " unique" * (i % 2)) for i in range(20)] + [(3, "T1 unknown"), (None, "t2"), (50, None), (51, "none of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 25)
    monkeypatch.setattr(lexical_search, "LANE_POSTINGS", 100)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for k in (3, 10):
        assert sorted(map(key, found(docs, asked, k))) == sorted(map(key, plain_search(rows, items, k)))


def test_scores_in_halves():
    draw = np.random.default_rng(1)
    value, place = draw.integers(0, 1 << 20, 5000), draw.integers(0, 7, 5000)
    start, length = np.arange(0, 5000, 50), np.full(100, 50)
    item, weight = draw.integers(0, 3, 100), draw.integers(0, 1 << 15, 100)
    both = [lexical_search._scores(item, weight, start, length, place, value, (3, 7), exact) for exact in (True, False)]
    assert (both[0] == both[1]).all() and both[0].sum() == (np.repeat(weight, 50) * value).sum()


def test_bounds_spare_strata(spark):
    """Where one stratum's documents hold an item whole, the postings of the others stay closed for it."""
    best = lexical_search.Best(2, 2)
    best.add(np.array([0, 1]), np.array([[9, 8, 0], [5, 5, 5]]), np.array([4, 5, 6]))
    assert best.score.tolist() == [[9, 8], [5, 5]] and best.doc.tolist() == [[4, 5], [4, 5]]
    assert best.reached(np.array([8, 5]), 5).tolist() == [False, False]
    assert best.reached(np.array([8, 5]), 4).tolist() == [True, True]
    assert best.reached(np.array([9, 4]), 99).tolist() == [True, False]


def test_search_edges(spark, docs, none):
    items = docs.select(F.lit(5).cast("long").alias("item_id"), "text").where("doc_id IN (1, 6, 7)")
    want = plain_search([(i, t) for i, t, _ in ROWS], [(5, t) for i, t, _ in ROWS if i in (1, 6, 7)], 50)
    assert sorted(map(str, map(tuple, found(docs, items)))) == sorted(map(str, want))
    assert found(none, items) == [] and found(docs, items.where("false")) == []


def test_a_language_of_many_copies_is_learned(spark):
    """One row thousands of times counts once, so the language's other texts are not crowded out of its sample."""
    rows = [(0, "der eine immer gleiche Satz der oft vorkommt", "de")] * 6000
    rows += [(i, f"ein anderer deutscher Satz mit Nummer {i} und weiteren Worten", "de") for i in range(1, 61)]
    rows += [(i, f"an english sentence with number {i} and further words", "en") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.training_texts(docs, "doc_id", "text", "lang", 400)
    assert learned.keys() == {"de", "en"} and len(learned["de"]) > 30 and len(learned["en"]) > 150
