"""The file-change source: files that come, change and go, and queries that start again."""

import os

from textloom.sources.snapshot import SnapshotTable
from textloom.streaming.files import file_changes, mirror


def test_changes_and_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    put = lambda name, text: (folder / name).write_text(text)

    def run():
        query = mirror(file_changes(spark, str(folder), str(tmp_path / "state"), "*.md"), f"file://{tmp_path}/table", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        table = SnapshotTable(spark, f"file://{tmp_path}/table", ["path"])
        return {r.path: r.size for r in table.read().collect()}, table.versions()

    put("a.md", "one")
    put("sub/b.md", "four")
    put("c.txt", "not asked for")
    assert run() == ({"a.md": 3, "sub/b.md": 4}, [0])
    assert run()[1] == [0]  # nothing new, no commit
    put("a.md", "longer")
    put("d.md", "")
    os.remove(folder / "sub/b.md")
    assert run() == ({"a.md": 6, "d.md": 0}, [0, 1])
    os.utime(folder / "d.md", (1, 1))
    put("sub/b.md", "back")
    os.remove(folder / "a.md")
    assert run() == ({"d.md": 0, "sub/b.md": 4}, [0, 1, 2])
    rows = SnapshotTable(spark, f"file://{tmp_path}/table", ["path"]).read().where("path = 'd.md'").first()
    assert rows.modified.timestamp() == 1


def test_rows_of_each_kind(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        query = file_changes(spark, str(folder), str(tmp_path / "state")).select("path", "change").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, spark.read.schema("path string, change string").json(str(tmp_path / "out")).collect()))

    (folder / "x").write_text("1")
    (folder / "y").write_text("1")
    assert run() == [("x", "created"), ("y", "created")]
    (folder / "x").write_text("22")
    (folder / "y").unlink()
    assert run() == [("x", "created"), ("x", "modified"), ("y", "created"), ("y", "deleted")]
