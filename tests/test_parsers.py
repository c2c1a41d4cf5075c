from pyspark.sql import functions as F

from textloom.operators import answers as A
from textloom.operators import parsers as P

PYTHON = '''import os

class Store(Base):
    """Keeps things."""

    def put(self, key, value):
        import json
        if not key:
            raise ValueError("no key")

async def run():
    raise RuntimeError
'''


def test_python_symbols(spark):
    files = spark.createDataFrame([(1, PYTHON), (2, "def broken("), (3, None)], "doc_id long, text string")
    got = {r.symbol: r for r in P.python_symbols(files).collect()}
    assert set(got) == {"Store", "put", "run"} and got["Store"].kind == "class" and (got["put"].first_line, got["put"].last_line) == (6, 9)
    assert got["Store"].description == "class Store; bases: Base; methods: put; Keeps things."
    assert got["put"].description == "function put; arguments: self, key, value; uses: json; raises: ValueError"


def test_line_symbols(spark):
    code = {
        "python": ("def f(x):\n  pass\nclass C:", [(1, "function", "f"), (3, "class", "C")]),
        "javascript": ("export function a() {}\nconst b = (x) => 1\nclass D {}", [(1, "function", "a"), (2, "function", "b"), (3, "class", "D")]),
        "java": ("public class A {\n  private static int go(int x) {", [(1, "class", "A"), (2, "function", "go")]),
        "go": ("func (s *S) Run() {\ntype S struct {", [(1, "function", "Run"), (2, "class", "S")]),
        "rust": ("pub fn x() {\nstruct Y;", [(1, "function", "x"), (2, "class", "Y")]),
        "cpp": ("class Z {\nint main(int argc) {", [(1, "class", "Z"), (2, "function", "main")]),
    }
    for language, (text, expected) in code.items():
        files = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert [(r.line, r.kind, r.symbol) for r in P.line_symbols(files, language).orderBy("line").collect()] == expected


def test_sheets(spark):
    rows = spark.createDataFrame([("s", i, f"n{i}" if i % 3 else None, None) for i in range(1, 8)], "sheet string, row int, name string, other string")
    first = P.row_blocks(rows, ["name", "other"], block=2).orderBy("block").collect()
    assert [(r.first_row, r.last_row, r.primary_value) for r in first] == [(1, 2, "n1"), (4, 5, "n4"), (7, 7, "n7")] and first[0].chunk == "row 1: name=n1\nrow 2: name=n2"
    after = P.row_blocks(rows, ["name", "other"], block=4, drop_first=False).orderBy("block").collect()
    assert [(r.block, r.first_row, r.last_row) for r in after] == [(0, 1, 2), (1, 4, 7)]


def test_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    assert one(P.plain_tables(F.lit("a\n| x | y |\n|---|---|\n| 1 | 2 |"))) == "a\nx y\n1 2"
    assert one(P.signature_lines(F.lit("x = 1\ndef f():\n  y"))) == "def f():" and one(P.signature_lines(F.lit("zz"))) == "zz"
    assert one(A.weights(F.lit("a=1,b=x,c=0.5"), {"a": 0.1, "d": 2.0})) == {"d": 2.0, "a": 1.0, "c": 0.5}
    assert one(A.extract(F.lit("no\nhas Word here\nword\nmore word lines"), "word")) == ["has Word here", "more word lines"]
