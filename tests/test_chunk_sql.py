"""The packers against their SQL over texts with headings, breaks, quotes and long stretches, which the tables have few of."""

import random

import duckdb
import pyarrow as pa
import pytest

from textloom.operators.chunk import PACKERS
from textloom.plans import chunk_sql

PIECES = ["\n\n", "\n", "\n## ", "## ", "# a", ". ", "; ", ";", "。", "；", "!", "?", "'", '"', "`", " ", "word ", "two words ", "x" * 90, "long stretch " * 30, "\n \n", "统计"]
TEXTS = [None, "", " ", "\n", "\n## ", ";", "a;b", "'a;b'; c", "x" * 2000, "x" * 2001, "y " * 1600 + ".", "\n" * 300 + "## t\nz"]


def texts(seed):
    r = random.Random(seed)
    return TEXTS + ["".join(r.choices(PIECES, k=r.choice((3, 12, 60, 150)))) for _ in range(150)]


@pytest.mark.parametrize("packer, sql", [("markdown", chunk_sql.MARKDOWN), ("force", chunk_sql.FORCE), ("paragraphs", chunk_sql.PARAGRAPHS), ("sentences", chunk_sql.SENTENCES), ("sql", chunk_sql.STATEMENTS)])
def test_packers_say_what_their_sql_says(packer, sql):
    rows = texts(7)
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(rows))), "text": pa.array(rows, pa.string())}))
    want = {(d, i): (h, c) for d, i, h, c in con.sql(f"SELECT doc_id, chunk_index, heading, chunk FROM ({sql})").fetchall()}
    got = {(d, i): x if isinstance(x, tuple) else (None, x) for d, text in enumerate(rows) for i, x in enumerate(PACKERS[packer](text or ""))}
    for key in sorted(want.keys() | got.keys()):
        assert got.get(key) == want.get(key), (key, rows[key[0]])
