import datetime as dt

import pytest
from pyspark.sql import functions as F

from textloom.operators import chunk as C
from textloom.operators import parsers as P
from textloom.operators import reports as R

DAY = dt.date


def test_reports_round_trip_and_days_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "reports")
    figures = {"docs": F.col("docs"), "rate": F.col("rate")}
    days = lambda rows: spark.createDataFrame(rows, "day date, docs long, rate double").select("day", R.rendered(F.col("day").cast("string"), figures).alias("text"))
    R.put(days([(DAY(2024, 1, 1), 5, 0.25), (DAY(2024, 1, 2), 7, None), (DAY(2024, 1, 4), 9, 0.5), (None, 1, 1.0)]), folder)
    text = {r.day: r.text for r in R.read(spark, folder).collect()}
    assert text[DAY(2024, 1, 1)] == "# 2024-01-01\n\n- docs: 5\n- rate: 0.25\n\n<!-- stats: docs=5 rate=0.25 -->\n" and len(text) == 3
    R.put(days([(DAY(2024, 1, 2), 8, 0.75)]), folder)
    got = {(r.day.day, r.key): (r.value, r.before, r.delta) for r in R.beside_day_before(R.read(spark, folder)).collect()}
    assert got == {(1, "docs"): (5, None, None), (1, "rate"): (0.25, None, None), (2, "docs"): (8, 5, 3), (2, "rate"): (0.75, 0.25, 0.5), (4, "docs"): (9, None, None), (4, "rate"): (0.5, None, None)}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("x\n<!-- stats: a=1 b=2.5 -->", {"a": 1.0, "b": 2.5}),
        ("<!-- stats:  a=1   word c=x d=-3 a=4 -->", {"d": -3.0, "a": 4.0}),
        ("<!-- stats: word -->", None),
        ("no figures", None),
        ("", None),
        (None, None),
    ],
)
def test_figures(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(R.figures("t").alias("r")).first().r == expected


def test_latest_logs(spark):
    names = ["run_20240101_0900.log", "run_20240101_1200.log", "run_20249901_0900.log", "check_20240101_0100.log", "other_20240101_0100.log", "run_20240102_1.log.gz", None]
    got = R.latest_logs(spark.createDataFrame([(n,) for n in names], "name string"), ["run", "check"])
    assert {(r.day, r.kind, r.name) for r in got.collect()} == {(DAY(2024, 1, 1), "run", names[1]), (DAY(2024, 1, 1), "check", names[3])}


def test_slides(spark):
    shapes = [("d", 1, 1, "text", " body "), ("d", 1, 0, "title", "Head"), ("d", 1, 2, "table", "a | b"), ("d", 1, 3, "notes", "say it"), ("d", 2, 0, "title", "  "), ("d", 2, 1, "text", None), ("d", 3, 0, "text", "only")]
    got = P.slides(spark.createDataFrame(shapes, "deck string, slide int, shape int, kind string, text string")).orderBy("slide").collect()
    assert [tuple(r) for r in got] == [("d", 1, "Head", True, "标题: Head\nbody\na | b\n备注: say it"), ("d", 3, None, False, "only")]
    assert P.slides(spark.createDataFrame([], "deck string, slide int, shape int, kind string, text string")).count() == 0


def test_slide_pieces():
    assert list(C.slide_pieces("one two", 2)) == ["one two"] and list(C.slide_pieces(" \n", 2)) == []
    assert list(C.slide_pieces("a b\nc\nd e f. g! h i j k\nl", 3)) == ["a b\nc", "d e f", "g", "h i ", "j k", "l"]
    long = "word " * 50000
    pieces = list(C.slide_pieces(long, 800))
    assert "".join(pieces) == long.strip() and max(map(len, pieces)) == 1200


def test_routed_chunks(spark):
    docs = spark.createDataFrame([(1, "/x/cursor_a.sql", "select 1; select 2"), (2, "/x/b.TXT", "one\n\ntwo"), (3, "c", "plain"), (4, "/x/d.md", None)], "doc_id long, path string, text string")
    got = {(r.doc_id, r.chunk_index, r.chunk, r.type) for r in C.routed_chunks(docs).collect()}
    assert got == {(1, 0, "select 1", "cursor"), (1, 1, "select 2", "cursor"), (2, 0, "one\ntwo", "narrative"), (3, 0, "plain", "narrative")}
