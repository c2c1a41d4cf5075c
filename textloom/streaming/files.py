"""Changes of a folder's files as a stream: files that came, changed or went.

An offset is the number of a listing. The reader lists the folder (any file system that pyarrow opens), and where the listing differs from the last
one writes it under the next number into the ``state`` folder; a batch is the difference of two listings, so deletions come as rows like the rest, a
batch that is repeated is the same again, and a query that is started anew goes on from the listing that its checkpoint names. A batch spans
the listings between its offsets: a file that came and went between two listings is not seen.

``mirror`` keeps a snapshot table of the files, a commit a batch; a batch that is repeated changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from textloom.sources.snapshot import SnapshotTable

SCHEMA = "path string, change string, modified timestamp, size long"
#: Changed files in a partition of a batch.
PART = 10_000


class Slice(InputPartition):
    def __init__(self, start: int, end: int, number: int, of: int):
        self.start, self.end, self.number, self.of = start, end, number, of


class FileChanges(DataSource):
    """Options: path (the folder), state (a folder for listings), glob (of names, all by default)."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return Listings(dict(self.options))


class Listings(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.state, self.glob = options["path"], options["state"].rstrip("/"), options.get("glob", "*")

    def _open(self, uri: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    def _listed(self) -> dict[str, list[int]]:
        """(time of change in microseconds, size) by path below the folder."""
        store, folder = self._open(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        files = ((i.path[len(folder) :].lstrip("/"), i) for i in found if i.type == fs.FileType.File)
        return {p: [(i.mtime_ns or 0) // 1000, i.size] for p, i in files if fnmatch(i.base_name, self.glob) and not i.base_name.startswith((".", "_"))}

    def _listing(self, number: int) -> dict[str, list[int]]:
        if number < 1:
            return {}
        store, folder = self._open(self.state)
        with store.open_input_stream(f"{folder}/{number:012d}.json") as f:
            return json.loads(f.read())

    def _last(self) -> int:
        store, folder = self._open(self.state)
        names = [i.base_name for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        now, last = self._listed(), self._last()
        if now == self._listing(last):
            return {"listing": last}
        store, folder = self._open(self.state)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/.{last + 1:012d}") as f:
            f.write(json.dumps(now).encode())
        store.move(f"{folder}/.{last + 1:012d}", f"{folder}/{last + 1:012d}.json")
        return {"listing": last + 1}

    def _changes(self, start: int, end: int) -> list[tuple]:
        old, new = self._listing(start), self._listing(end)
        kinds = [(p, "created" if p not in old else "modified") for p in new if old.get(p) != new[p]] + [(p, "deleted") for p in old if p not in new]
        told = lambda p: new.get(p) or old[p]
        return [(p, kind, datetime.fromtimestamp(told(p)[0] / 1e6, timezone.utc), told(p)[1]) for p, kind in sorted(kinds)]

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        count = max(1, -(-len(self._changes(start["listing"], end["listing"])) // PART))
        return [Slice(start["listing"], end["listing"], i, count) for i in range(count)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return iter(self._changes(partition.start, partition.end)[partition.number :: partition.of])

    def commit(self, end: dict) -> None:
        """Listings before the one that is done are not needed again."""
        store, folder = self._open(self.state)
        for i in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if i.base_name.endswith(".json") and i.base_name[:-5].isdigit() and int(i.base_name[:-5]) < end["listing"] - 1:
                store.delete_file(i.path)


def file_changes(spark: SparkSession, path: str, state: str, glob: str = "*") -> DataFrame:
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("path", path).option("state", state).option("glob", glob).load()


def mirror(changes: DataFrame, folder: str, checkpoint: str):
    """A streaming query's writer: the snapshot table in ``folder`` holds path, modified and size of each file that is there."""

    def each(batch: DataFrame, number: int) -> None:
        there = lambda old, new: new.where("change <> 'deleted'").select("path", "modified", "size")
        SnapshotTable(batch.sparkSession, folder, ["path"]).merge(batch, there, txn=("mirror", number))

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
