"""Row numbers hold however the files are split by a later scan."""

import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, pii, scratch, simhash, warc

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def moving(spark, monkeypatch):
    """Every table that is written leaves files split another way, as when executors come or go between two scans."""
    real, left = exact_dedup.written, [0]

    def moved(df, name):
        out = real(df, name)
        left[0] += 1
        spark.conf.set(SPLIT, str((20_000, 7_000, 12_000)[left[0] % 3]))
        return out

    for module in (exact_dedup, simhash, pii, warc):
        monkeypatch.setattr(module, "written", moved)
    monkeypatch.setattr(scratch, "written", moved)
    before, cost = spark.conf.get(SPLIT), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    spark.conf.set(SPLIT, before)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.fixture
def docs(spark, tmp_path):
    body = lambda i: " ".join(f"w{i * 31 % 97}x{i}y{j}" for j in range(30))
    rows = [(i, f"{body(i // 2 if i % 3 == 0 else i)} " + (f"mail a{i}@example.com now" if i % 5 == 0 else "")) for i in range(600)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6, "doc_id").write.option("parquet.block.size", "4096").parquet(path)
    return path


def test_copies_are_dropped_and_nothing_else(moving, docs):
    rows = moving.read.parquet(docs)
    for drop in (exact_dedup.drop_copies, simhash.drop_near_copies):
        texts = [r.text for r in drop(rows).select("text").collect()]
        if drop is exact_dedup.drop_copies:
            bare = lambda t: "".join(t.split())
            assert sorted(map(bare, texts)) == sorted({bare(r.text) for r in rows.collect()})
        else:
            wanted = {r.doc_id for r in simhash.near_dedup(rows).where("kept").collect()}
            assert {r.doc_id for r in drop(rows).collect()} == wanted


def test_spans_stay_with_their_documents(moving, docs):
    rows = moving.read.parquet(docs)
    found = {r.doc_id: r.n_email for r in pii.find(rows).collect()}
    assert found == {i: int(i % 5 == 0) for i in range(600)}
    clean = {r.doc_id: r.text for r in pii.sanitise(rows).collect()}
    assert all(("[EMAIL]" in t) == (i % 5 == 0) and "@" not in t for i, t in clean.items())


def test_revisits_are_the_copies(moving, docs):
    pages = moving.read.parquet(docs).select(F.col("doc_id").alias("page_id"), F.lit("http://a").alias("url"), (F.col("doc_id") % 300).cast("string").alias("n"))
    pages = pages.select("page_id", "url", F.concat(F.lit("p" * 120), "n").alias("html"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_report(pages).collect()}
    assert got == {i: ("response", None) if i < 300 else ("revisit", i - 300) for i in range(600)}
