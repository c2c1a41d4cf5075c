"""Code cut where its blocks end: a scanner that knows strings, comments and nesting, over sources in Arrow batches.

Strings and comments are blanked first (line ends stay), so neither braces nor words in them count. Lines that begin a symbol are those of
``parsers.LINE_PATTERNS``. In languages with braces a symbol's block runs to the brace that closes the first one behind it, or to the semicolon that
comes before any; in Python to the last line that is indented deeper, brackets and blank lines aside. A block that is never closed runs to
the end. Everything is one pass and binary searches, so the work is linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.parsers import LINE_PATTERNS

BLOCK = "doc_id long, kind string, symbol string, first_line int, last_line int, depth int"
CHUNK = "doc_id long, chunk_index int, symbol string, first_line int, last_line int, chunk string"
MOST_LINES = 50

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?"
HIDDEN = {
    "python": r"#[^\n]*|(?:\"\"\"(?:\\.|.)*?(?:\"\"\"|\Z))|(?:'''(?:\\.|.)*?(?:'''|\Z))|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?",
    "javascript": _C + r"|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?",
    "java": r"\"\"\".*?(?:\"\"\"|\Z)|" + _C + r"|'(?:\\.|[^'\\\n])*'?",
    "go": _C + r"|'(?:\\.|[^'\\\n])*'?|`[^`]*`?",
    "rust": _C + r"|'(?:\\[^\n][^'\n]*|[^'\\\n])'",
    "cpp": r"R\"(?P<raw>[^(\s]{0,16})\(.*?(?:\)(?P=raw)\"|\Z)|" + _C + r"|'(?:\\.|[^'\\\n])*'?",
}


def blanked(text: str, language: str) -> str:
    """The text with blanks in place of strings and comments, line by line as long as before."""
    return re.sub(HIDDEN[language], lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)


def _symbols(lines: list[str], language: str) -> list[tuple[int, str, str]]:
    patterns = [(kind, re.compile(p)) for kind, p in LINE_PATTERNS[language]]
    found = []
    for i, line in enumerate(lines):
        line = re.sub(r"\s{2,}", " ", line)  # blanked strings may be long, and patterns try blanks again and again
        for kind, pattern in patterns:
            if m := pattern.match(line):
                found.append((i, kind, m[1]))
                break
    return found


def _braced(bare: str, starts: list[int], symbols: list[tuple[int, str, str]]) -> list[int]:
    """The last line of each symbol's block."""
    # braces and semicolons by how many round brackets are open around them
    opens: dict[int, list[int]] = {}
    ends: dict[int, list[int]] = {}
    closes, stack, round_, depths = {}, [], 0, []
    for m in re.finditer(r"[{}();\n]", bare):
        c, at = m[0], m.start()
        if c == "\n":
            depths.append(round_)
        elif c == "{":
            opens.setdefault(round_, []).append(at)
            stack.append(at)
        elif c == "}":
            if stack:
                closes[stack.pop()] = at
        elif c == ";":
            ends.setdefault(round_, []).append(at)
        else:
            round_ = max(0, round_ + (1 if c == "(" else -1))
    depths = [0, *depths]
    out = []
    for line, _, _ in symbols:
        near, far = opens.get(depths[line], []), ends.get(depths[line], [])
        brace, end = bisect_left(near, starts[line]), bisect_left(far, starts[line])
        if brace < len(near) and (end == len(far) or near[brace] < far[end]):
            at = closes.get(near[brace], len(bare))
        else:
            at = far[end] if end < len(far) else starts[line]
        out.append(bisect_right(starts, at) - 1)
    return out


def _indented(lines: list[str], symbols: list[tuple[int, str, str]]) -> list[int]:
    depth, open_lines = 0, []  # lines that begin outside brackets and are not blank
    for i, line in enumerate(lines):
        if not depth and line.strip():
            open_lines.append((i, len(line) - len(line.lstrip())))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
    last = max((i for i, line in enumerate(lines) if line.strip()), default=0)
    # from the end: the next line that is not indented deeper, by a stack of indents
    ends, stack = {}, []
    for i, indent in reversed(open_lines):
        while stack and stack[-1][1] > indent:
            stack.pop()
        ends[i] = stack[-1][0] - 1 if stack else last
        stack.append((i, indent))
    out = []
    for line, _, _ in symbols:
        end = ends.get(line, line)
        while end > line and not lines[end].strip():
            end -= 1
        out.append(end)
    return out


def blocks(text: str, language: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, symbol, first line, last line, how many blocks it lies in) of each symbol, lines from 1."""
    bare = blanked(text, language)
    lines = bare.split("\n")
    starts = [0]
    for line in lines[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    symbols = _symbols(lines, language)
    ends = _indented(lines, symbols) if language == "python" else _braced(bare, starts, symbols)
    out, around = [], []
    for (line, kind, name), end in zip(symbols, ends):
        while around and around[-1] < line:
            around.pop()
        out.append((kind, name, line + 1, end + 1, len(around)))
        around.append(end)
    return out


def pieces(text: str, language: str, most: int = MOST_LINES) -> Iterator[tuple[str | None, int, int, str]]:
    """(symbol, first line, last line, text) that together are the whole text: outermost blocks, and what lies between them; both in stretches of at
    most ``most`` lines, a block's stretches ending before an inner block where one begins in their second half."""
    lines = text.split("\n")
    found = blocks(text, language)
    inner = sorted(first for _, _, first, _, depth in found if depth)
    at = 1
    parts: list[tuple[str | None, int, int]] = []
    for _, name, first, last, depth in found:
        if depth or first < at:
            continue
        if first > at:
            parts.append((None, at, first - 1))
        parts.append((name, first, last))
        at = last + 1
    if at <= len(lines):
        parts.append((None, at, len(lines)))
    for name, first, last in parts:
        while first <= last:
            end = min(last, first + most - 1)
            if end < last:
                k = bisect_right(inner, end + 1) - 1
                if k >= 0 and inner[k] > first + most // 2:
                    end = inner[k] - 1
            yield name, first, end, "\n".join(lines[first - 1 : end])
            first = end + 1


def _run(shape: str, rows, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = [c.split() for c in shape.split(", ")]
    for batch in batches:
        out = [(doc_id, *r) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in rows(text or "")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(columns)], names=[n for n, _ in columns])


def code_blocks(files: DataFrame, language: str) -> DataFrame:
    """(doc_id, kind, symbol, first_line, last_line, depth) of the symbols of sources (doc_id, text); null texts have none."""
    return files.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_run, BLOCK, partial(blocks, language=language)), BLOCK)


def _numbered(text: str, language: str, most: int) -> list[tuple]:
    return [(i, *p) for i, p in enumerate(pieces(text, language, most))]


def code_chunks(files: DataFrame, language: str, most: int = MOST_LINES) -> DataFrame:
    """(doc_id, chunk_index, symbol, first_line, last_line, chunk): sources cut by their blocks, nothing lost."""
    return files.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(_run, CHUNK, partial(_numbered, language=language, most=most)), CHUNK)
