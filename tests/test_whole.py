"""Queries and operators do the whole job: no row is left out."""

import duckdb
import pyarrow as pa

from textloom.operators import evaluate as E
from textloom.registry import QUERIES
from textloom.sources import tables
from textloom.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def test_all_events_and_terms_count(spark):
    one = lambda sql: duckdb.sql(sql).fetchall()[0][0]
    events = f"'{SF}/events.parquet'"
    assert QUERIES["weights_parse_all"](spark, SF).count() == one(f"SELECT count(*) FROM {events}")
    assert QUERIES["version_compare_all"](spark, SF).count() == one(f"SELECT count(DISTINCT user_id) FROM {events}")
    assert QUERIES["term_statistics_all"](spark, SF).where("df < 5").count() > 0


def test_passages_of_any_length_and_place(spark):
    eight = " ".join(f"w{i}" for i in range(8))
    twelve = " ".join(f"w{i}" for i in range(12))
    passages = [(1, "short one"), (2, "w3"), (3, eight), (4, twelve), (5, "not there"), (6, None)]
    docs = [(1, f'he said "{twelve}" today'), (2, f"({eight}), and so on"), (3, "a short one."), (4, f"x {twelve} y")]
    found = E.passages_found(spark.createDataFrame(passages, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.item_id: r.n_docs for r in found.collect()} == {i: sum(p is not None and p in t for _, t in docs) for i, p in passages}


def test_stream_limits_hold_no_client_whole(spark, tmp_path):
    """Verdicts come out before a client's next rows are read, and times are kept from batch to batch."""
    read = []

    def chunks():
        for k in range(5):
            read.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([7]), pa.array([k * 1_000_000]), pa.array([False])], names=["event_id", "user_id", "micros", "kept"])

    first = next(out := J.carried(chunks(), 2, 60))
    assert read == [0] and first.column("allowed").to_pylist() == [True]
    rest = [r for b in out for r in b.to_pylist()]
    assert [r["allowed"] for r in rest if not r["kept"]] == [True, False, False, False] and [r["micros"] for r in rest if r["kept"]] == [0, 1_000_000]
    for k in range(3):
        events = spark.createDataFrame([(k * 10 + i, 7, f"2024-01-01 00:0{k}:{i * 20:02d}") for i in range(3)], "event_id long, user_id long, ts string")
        events.select("event_id", "user_id", events.ts.cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    path = str(tmp_path / "events.parquet")
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.event_id: r.allowed for r in J.rate_limits_to_end(stream, "limits", most=2, seconds=90).collect()}
    assert got == {r.event_id: r.allowed for r in J.rate_limited(table, most=2, seconds=90).collect()} and len(got) == 9


def test_gbk_files(spark, tmp_path):
    texts = {"a.md": ("向量检索与文档" * 20, "utf-8"), "b.md": ("向量检索与文档" * 20, "gbk"), "c.md": ("caf\xe9 " * 20 + "\xff", "latin-1")}
    for name, (text, coding) in texts.items():
        (tmp_path / name).write_bytes(text.encode(coding))
    found = tables.decoded(tables.scan_files(spark, [str(tmp_path)], [".md"]))
    assert {r.name: r.text for r in found.collect()} == {name: text for name, (text, _) in texts.items()}
