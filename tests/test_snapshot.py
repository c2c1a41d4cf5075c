"""Snapshot tables: commits, conflicts, writes that die, files that are left alone."""

import threading

import pytest
from pyspark.sql import functions as F

from textloom.sources import snapshot
from textloom.sources.snapshot import SnapshotTable


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/t", ["id"], file_rows=100)


def rows(spark, low, high, v=0):
    return spark.range(low, high).select("id", F.lit(v).alias("v"))


def content(df):
    return {r.id: r.v for r in df.collect()}


def test_versions(spark, table):
    assert table.read() is None and table.versions() == []
    table.append(rows(spark, 0, 1000))
    table.upsert(rows(spark, 990, 1010, 1))
    table.delete(rows(spark, 0, 5))
    now = content(table.read())
    assert now == {i: int(i >= 990) for i in range(5, 1010)} and table.snapshot().rows == len(now)
    assert len(content(table.read(0))) == 1000 and table.versions() == [0, 1, 2]
    assert [h["did"] for h in table.history()] == ["append", "upsert", "delete"]
    with pytest.raises(ValueError):
        table.read(9)
    table.upsert(rows(spark, 0, 0))
    assert table.versions() == [0, 1, 2]  # nothing to write


def test_an_upsert_of_one_percent_rewrites_the_files_it_touches(spark, table):
    table.append(rows(spark, 0, 2000))
    before = set(table.snapshot().files)
    table.upsert(rows(spark, 500, 520, 1))
    after = table.snapshot()
    gone = before - set(after.files)
    assert 1 <= len(gone) <= 2 and len(before) >= 20 and after.rows == 2000
    assert table.history()[1]["rows_removed"] <= 200
    held = table.pruned(after, {"id": (100, 110)})
    assert 1 <= len(held) <= 2 and content(table.read(ranges={"id": (100, 110)}).where("id between 100 and 110")) == {i: 0 for i in range(100, 111)}


def test_a_write_that_dies_leaves_the_table_as_it_was(spark, table, monkeypatch):
    table.append(rows(spark, 0, 100))
    stop = F.udf(lambda x: 1 // (x - 150), "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        table.upsert(rows(spark, 100, 200).select("id", stop("id").cast("int").alias("v")))
    with monkeypatch.context() as m:
        m.setattr(snapshot._Files, "put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            table.append(rows(spark, 500, 600))
    assert table.snapshot().rows == 100
    table.upsert(rows(spark, 50, 150, 2))
    assert content(table.read()) == {i: 2 * int(i >= 50) for i in range(150)}
    assert table.vacuum(grace_seconds=3600) == []
    left = table.vacuum(keep=1, grace_seconds=-1)
    assert len(left) == 2 and len(content(table.read())) == 150


def test_two_writers(spark, table, monkeypatch):
    """Both read one version; the second commits behind the first, or begins anew where they touch the same keys."""
    table.append(rows(spark, 0, 400))
    real, gate = snapshot.SnapshotTable._store, threading.Barrier(2, timeout=60)
    waits = threading.local()

    def store(self, df):
        out = real(self, df)
        if not getattr(waits, "once", False):
            waits.once = True
            gate.wait()
        return out

    monkeypatch.setattr(snapshot.SnapshotTable, "_store", store)
    failed = []

    def write(low, high, v):
        try:
            SnapshotTable(spark, table.folder, ["id"], file_rows=100).merge(rows(spark, low, high, v), lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("v").cast("int").alias("v")))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    for spans in (((0, 50), (300, 350)), ((0, 50), (20, 70))):
        both = [threading.Thread(target=write, args=(*s, 1)) for s in spans]
        [t.start() for t in both]
        [t.join() for t in both]
        gate.reset()
    assert not failed
    wanted = {i: 2 * int(i < 50) + int(300 <= i < 350) + int(20 <= i < 70) for i in range(400)}
    assert content(table.read()) == wanted and len(table.versions()) == 5


def test_numbered_writes_happen_once(spark, table, monkeypatch):
    monkeypatch.setattr(snapshot, "CHECKPOINT", 4)
    for batch in [0, 1, 1, 2, 0, 3, 4, 5, 6, 5]:
        table.append(rows(spark, batch * 10, batch * 10 + 10, batch), txn=("job", batch))
    assert content(SnapshotTable(spark, table.folder, ["id"]).read()) == {i: i // 10 for i in range(70)} and table.versions() == list(range(7))
    table.compact(1000)
    assert content(table.read()) == {i: i // 10 for i in range(70)} and len(table.snapshot().files) < 7


def test_keys_that_are_null_or_repeat(spark, table):
    odd = spark.createDataFrame([(None, 1), (None, 2), (3, 3), (3, 4)], "id long, v int")
    table.append(odd)
    table.upsert(spark.createDataFrame([(None, 9)], "id long, v int"))
    assert sorted(((r.id, r.v) for r in table.read().collect()), key=str) == [(3, 3), (3, 4), (None, 9)]
    table.delete(spark.createDataFrame([(3,)], "id long"))
    assert [tuple(r) for r in table.read().collect()] == [(None, 9)]
    table.delete(spark.createDataFrame([(None,)], "id long"))
    assert table.read().count() == 0 and table.snapshot().files == {}
    table.upsert(spark.createDataFrame([(1, 1, "x")], "id long, v int, more string"))
    assert table.read().columns == ["id", "v", "more"]
