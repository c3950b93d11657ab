"""The chunkers as expressions against plain models, on random and awkward files."""

import random

import pytest
from pyspark.sql import functions as F

from loamgrid import model
from loamgrid.functions import arrays
from loamgrid.operators import chunking

from . import chunk_models as models

PYTHON = "import x\n\nclass A:\n    z = 1\n    def m(self):\n        def inner():\n            pass\n        return inner\n\n    @staticmethod\n    def s():\n        pass\n\ndef f():\n    return 1\n\nclass Empty:\n    y = 2\n"
TYPESCRIPT = "import x;\nexport class A<T> extends B {\n  private z = 1;\n  run(a: string): void {\n    if (a) { this.z = 2; }\n  }\n}\nexport function f(x: number) {\n  return '}';\n}\n"
PATHS = {"headings": "a.md", "whole": "x/action.yml", "yaml": "b.yaml", "ast": "c.py", "tokens": "d.txt"}


def texts():
    draw = random.Random(7)
    words = ["a", "bc def", "é", "# head", "##", "key: 1", "on:", "  x: y", "", " ", "\t", "😀😀", "x" * 70, "def f():", "    pass", "long word " * 9, "k-1:\r"]
    made = ["\n".join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(60)]
    return [*made, "", "\n", "\n\n\n", "x", "😀" * 200 + "a" * 300, "a\n" * 400, "no feed " * 300, "# only", "a: 1\nb: 2", "\n\na: 1\nb:\n" + "z" * 500, PYTHON, TYPESCRIPT, PYTHON * 9]


@pytest.mark.parametrize("limits", [model.ChunkLimits(), model.ChunkLimits(20, 5, 60), model.ChunkLimits(7, 0, 7), model.ChunkLimits(3, 9, 5), model.ChunkLimits(12, 12, 1)])
def test_expressions_equal_models(spark, limits):
    held = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts())], "data_source_id string, content string").cache()
    for strategy, path in PATHS.items():
        got = chunking.chunk_files(held.withColumn("file_path", F.lit(path)), limits, strategy).collect()
        want = {(str(i), k, *c) for i, t in enumerate(texts()) for k, c in enumerate(models.cut(t, path, strategy, limits))}
        assert {(r.data_source_id, r.ordinal, r.content, r.start_line, r.end_line, r.token_count) for r in got} == want, strategy


def test_routes_and_errors(spark, monkeypatch):
    held = [("s", p, t) for p, t in (("a.md", "# t\nx"), ("b.txt", None), ("c.txt", " \n"), ("d.py", PYTHON), ("e.ts", TYPESCRIPT), ("f.py", "def ("), ("g.go", "func (s *Srv) Run() {\n}\n"), ("h.rb", "x = 1"), (".github/workflows/w.yml", "on: x"))]
    got = chunking.chunk_files(spark.createDataFrame(held, "data_source_id string, file_path string, content string")).collect()
    how = {"a.md": "headings", ".github/workflows/w.yml": "whole"}
    want = {(p, k, *c) for _, p, t in held for k, c in enumerate(models.cut(t, p, how.get(p, "tokens" if p.endswith("txt") else "ast"), model.ChunkLimits()))}
    assert {(r.file_path, r.ordinal, r.content, r.start_line, r.end_line, r.token_count) for r in got} == want
    heads = {(r.file_path, r.start_line, r.end_line, r.content.split("\n")[0]) for r in got if r.file_path in ("d.py", "e.ts", "g.go")}
    assert heads == {
        ("d.py", 5, 8, "# Class: A"), ("d.py", 10, 12, "# Class: A"), ("d.py", 14, 15, "def f():"), ("d.py", 17, 18, "class Empty:"),
        ("e.ts", 4, 6, "// Class: A"), ("e.ts", 8, 10, "export function f(x: number) {"), ("g.go", 1, 2, "// Class: s *Srv"),
    }
    assert len({r.chunk_id for r in got}) == len(got)


def test_plans_without_python(spark):
    held = spark.createDataFrame([("s", "a.txt", "x")], "data_source_id string, file_path string, content string")
    for strategy in ("tokens", "headings", "yaml", "whole"):
        plan = chunking.chunk_files(held, strategy=strategy)._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "Exchange" not in plan


def test_long_file_of_many_lines(spark):
    """Rounds double, so a file of 60,000 lines and as many windows takes a few rounds."""
    text = "\n".join(f"{i:09}" for i in range(60_000))
    held = spark.createDataFrame([("s", "a.txt", text)], "data_source_id string, file_path string, content string")
    got = chunking.chunk_files(held, model.ChunkLimits(3, 0), "tokens").agg(F.count("*"), F.max("end_line"), F.sum("token_count")).first()
    assert tuple(got) == (60_000, 60_000, 180_000)


def test_iterated_arrays(spark):
    row = spark.range(1).select(
        arrays.running_sums(F.array(*[F.lit(x) for x in (3, 0, 5, 1, 1)])).alias("s"),
        arrays.chain(F.array(*[F.lit(x) for x in (2, 3, 4, 5, 5, 5)]), F.lit(5)).alias("c"),
        arrays.last_at_most(F.array(*[F.lit(x) for x in (0, 1, 1, 4, 9)]), F.lit(4), F.lit(0), F.lit(4), F.array(F.lit(4), F.lit(2), F.lit(1))).alias("l"),
    ).first()
    assert (row.s, row.c, row.l) == ([3, 3, 8, 9, 10], [0, 2, 4], 3)
