"""Blocks of code: strings, comments, nesting, and texts of any shape."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import code

JS = '''// function no() {
class A {
  const_ = "}";  /* function
  nope() { */
}
function f(a = {x: 1}) {
  const g = (b) => {
    return `}} ${b}`;
  }
  return '{';
}
export async function h() { return 1; }
const k = (x);
'''
PY = '''import os
def f(a,
      b=(1,
2)):
    """def g():
    no"""
    if a:

        return "def h():"
    # def i():
class C(object):
    x = [
1]
    async def m(self):
        pass

y = 1
def last(): return 1
'''
GO = "package a\nfunc (t T) Run(x int) {\n  s := `}\n}`\n  if x > '{' { }\n}\ntype T struct {\n  a int\n}\n"


def test_blocks():
    found = lambda text, language: [b[1:] for b in code.blocks(text, language)]
    assert found(JS, "javascript") == [("A", 2, 5, 0), ("f", 6, 11, 0), ("g", 7, 9, 1), ("h", 12, 12, 0), ("k", 13, 13, 0)]
    assert found(PY, "python") == [("f", 2, 9, 0), ("C", 11, 15, 0), ("m", 14, 15, 1), ("last", 18, 18, 0)]
    assert found(GO, "go") == [("Run", 2, 6, 0), ("T", 7, 9, 0)]
    assert found("struct P;\nfn f<'a>(x: &'a str) -> char {\n  '{'\n}\nfn open() {\n", "rust") == [("P", 1, 1, 0), ("f", 2, 4, 0), ("open", 5, 6, 0)]
    assert found("public class B {\n  public int f(int a) { String s = \"\"\"\n }\"\"\"; return 1; }\n}", "java") == [("B", 1, 4, 0), ("f", 2, 3, 1)]
    assert found('int main(int a) {\n  auto s = R"x( } )x";\n}\n', "cpp") == [("main", 1, 3, 0)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="{}()\"'`/*#;\\ \n", max_size=300), st.integers(0, 4), st.sampled_from(sorted(code.HIDDEN)), st.integers(1, 9))
def test_nothing_is_lost(noise, at, language, most):
    seeds = {"python": "def f():\n  x\n", "javascript": "function f() {\n x\n}\n", "java": "class f {\n}\n", "go": "func f() {\n}\n", "rust": "fn f() {\n}\n", "cpp": "class f {\n};\n"}
    text = noise[: at * 50] + "\n" + seeds[language] * 3 + noise[at * 50 :]
    bare = code.blanked(text, language)
    assert len(bare) == len(text) and [i for i, c in enumerate(bare) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    parts = list(code.pieces(text, language, most))
    assert "\n".join(p[3] for p in parts) == text and all(p[2] - p[1] < most for p in parts)
    lines = text.count("\n") + 1
    for _, _, first, last, depth in code.blocks(text, language):
        assert 1 <= first <= last <= lines and depth >= 0


@pytest.mark.parametrize("language", sorted(code.HIDDEN))
def test_long_sources_take_linear_time(language):
    for text in ("{" * 300_000, '"' * 300_000, "/*" * 150_000, "'''" * 100_000, "def f():\n  x = '{'\n" * 20_000, "function f() {\n" * 20_000, "\\" * 300_000):
        began = time.perf_counter()
        list(code.pieces(text, language))
        assert time.perf_counter() - began < 10


def test_rows(spark):
    files = spark.createDataFrame([(1, JS, "x"), (2, None, "x"), (None, "", "x")], "doc_id long, text string, symbol string")
    assert code.code_blocks(files, "javascript").count() == 5
    assert [(r.doc_id, r.chunk_index, r.symbol, r.first_line) for r in code.code_chunks(files, "javascript").where("doc_id = 1").orderBy("chunk_index").collect()] == [(1, 0, None, 1), (1, 1, "A", 2), (1, 2, "f", 6), (1, 3, "h", 12), (1, 4, "k", 13), (1, 5, None, 14)]
