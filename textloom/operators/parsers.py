"""Structure of code, sheets and slides as rows.

Line patterns are plain columns over exploded lines. Python sources are read by the ast module, file by file, in Arrow batches.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.running import running_sums

#: Row numbers of a sheet that one task counts together.
STRETCH = 1 << 14

SYMBOL = "doc_id long, symbol string, kind string, first_line int, last_line int, description string"

#: Symbol patterns by language: (kind, pattern with the name in its first group); the first that matches a line counts.
LINE_PATTERNS = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "javascript": [("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)"), ("function", r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(")],
    "java": [("class", r"^\s*(?:public\s+)?(?:abstract\s+|final\s+)?(?:class|interface|enum)\s+(\w+)"), ("function", r"^\s*(?:public|private|protected)\s+[\w<>\[\], ]+\s+(\w+)\s*\(")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)"), ("class", r"^type\s+(\w+)\s+(?:struct|interface)")],
    "rust": [("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("class", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)")],
    "cpp": [("class", r"^\s*(?:class|struct)\s+(\w+)"), ("function", r"^[\w:<>*& ]+\s+(\w+)\s*\([^;]*$")],
}


def line_symbols(files: DataFrame, language: str) -> DataFrame:
    """(doc_id, line, kind, symbol) of the lines that begin a symbol."""
    lines = files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    hit = None
    for kind, pattern in LINE_PATTERNS[language]:
        name = F.regexp_extract("code", pattern, 1)
        value = F.struct(F.lit(kind).alias("kind"), name.alias("symbol"))
        hit = F.when(name != "", value) if hit is None else hit.when(name != "", value)
    return lines.withColumn("x", hit).where("x is not null").select("doc_id", (F.col("line") + 1).alias("line"), "x.kind", "x.symbol")


def signature_lines(text: Column | str, pattern: str = r"^\s*(?:def |class |function |func |public |private |#|//|--|CREATE )", n: int = 30, width: int = 100) -> Column:
    """The first n lines that look like signatures or comments, cut to width; without any, the first 500 characters."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.slice(F.filter(F.split(t, "\n"), lambda line: line.rlike(pattern)), 1, n)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda line: F.substring(line, 1, width)), "\n")).otherwise(F.substring(t, 1, 500))


def described(node: ast.AST) -> str:
    """What a function or class is: name, arguments or bases, docstring, what it imports, raises and holds."""
    parts = [f"{'class' if isinstance(node, ast.ClassDef) else 'function'} {node.name}"]
    if isinstance(node, ast.ClassDef):
        parts += ["bases: " + ", ".join(map(ast.unparse, node.bases))] if node.bases else []
        methods = [n.name for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))][:10]
        parts += ["methods: " + ", ".join(methods)] if methods else []
    else:
        names = [a.arg for a in node.args.args]
        parts += ["arguments: " + ", ".join(names)] if names else []
        inner = list(ast.walk(node))
        imports = [a.name for n in inner if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
        raised = [ast.unparse(n.exc.func if isinstance(n.exc, ast.Call) else n.exc) for n in inner if isinstance(n, ast.Raise) and n.exc]
        parts += ["uses: " + ", ".join(list(dict.fromkeys(imports))[:10])] if imports else []
        parts += ["raises: " + ", ".join(dict.fromkeys(raised))] if raised else []
    doc = ast.get_docstring(node)
    return "; ".join(parts + ([doc] if doc else []))


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions and classes of Python sources, methods too; sources that don't parse give none (see line_symbols)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                        out.append((doc_id, node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno, described(node)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in SYMBOL.split(", ")])

    return files.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SYMBOL)


def row_blocks(rows: DataFrame, headers: list[str], sheet: str = "sheet", order: str = "row", block: int = 50, primary: tuple[str, ...] = ("id", "编号", "name", "名称"), drop_first: bool = True) -> DataFrame:
    """Rows of a sheet in blocks as texts: each row says its number and its filled cells; with the rows' bounds and the first value
    of the primary column, the first header that holds one of the ``primary`` pieces. Empty rows are dropped before blocks are
    counted, or after where ``drop_first`` is false. Row numbers are unique in a sheet; its rows are counted by stretches of them, so that
    no task sorts a sheet."""
    filled = [F.when(F.coalesce(F.col(h).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{h}="), F.col(h).cast("string"))) for h in headers]
    cells = F.array_compact(F.array(*filled))
    said = rows.withColumn("__cells", cells)
    if drop_first:
        said = running_sums(said.where(F.size("__cells") > 0), sheet, [order], F.floor(F.col(order) / STRETCH), {"__place": F.lit(1)})
    place = F.col("__place") - 1 if drop_first else F.col(order)
    text = F.concat(F.lit("row "), F.col(order).cast("string"), F.lit(": "), F.array_join("__cells", ", "))
    key = next((h for h in headers if any(p.lower() in h.lower() for p in primary)), None)
    numbered = said.withColumns({"block": F.floor(place / block).cast("int"), "__text": text, "__key": F.col(key).cast("string") if key else F.lit(None).cast("string")})
    numbered = numbered.where(F.size("__cells") > 0)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("__text").alias("t"))))
    told = numbered.groupBy(sheet, "block").agg(lines.alias("x"), F.min(order).alias("first_row"), F.max(order).alias("last_row"), F.min_by("__key", order).alias("primary_value"))
    return told.select(sheet, "block", F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("chunk"), "first_row", "last_row", "primary_value")


# What stands before a slide's title and its notes.
TITLE_MARK, NOTES_MARK = "标题: ", "备注: "


def slides(shapes: DataFrame, marks: tuple[str, str] = (TITLE_MARK, NOTES_MARK)) -> DataFrame:
    """(deck, slide, title, has_notes, text) from a deck's shapes (deck, slide, shape, kind, text): the title, then text and tables in their order, then
    notes, each trimmed, a line each. Blank shapes are left out, slides without any too; of several titles the first counts. A slide is
    gathered by itself, never a deck."""
    said = shapes.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where(F.col("text") != "")
    place = F.when(F.col("kind") == "title", 0).when(F.col("kind") == "notes", 2).otherwise(1)
    mark = F.when(F.col("kind") == "title", marks[0]).when(F.col("kind") == "notes", marks[1]).otherwise("")
    lines = F.array_sort(F.collect_list(F.struct(place.alias("place"), "shape", F.concat(mark, "text").alias("line"))))
    title = F.min_by(F.when(F.col("kind") == "title", F.col("text")), F.when(F.col("kind") == "title", F.col("shape")))
    told = said.groupBy("deck", "slide").agg(title.alias("title"), F.bool_or(F.col("kind") == "notes").alias("has_notes"), lines.alias("x"))
    return told.select("deck", "slide", "title", "has_notes", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def plain_tables(text: Column | str) -> Column:
    """Markdown tables without their separator rows, cells parted by blanks."""
    t = F.col(text) if isinstance(text, str) else text
    kept = F.filter(F.split(t, "\n"), lambda line: ~line.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|?\s*$") | ~line.contains("|"))
    return F.array_join(F.transform(kept, lambda line: F.when(line.rlike(r"^\s*\|.*\|\s*$"), F.trim(F.regexp_replace(line, r"\s*\|\s*", " "))).otherwise(line)), "\n")
