"""Snapshot tables: Parquet files under a commit log.

A table is a folder with ``data`` (files, never changed) and ``log`` (one JSON file a commit). A commit names the files it adds, with their
rows and the least and greatest value of each key and cluster column, and the files it takes away; every ``CHECKPOINT`` commits one file
lists all that are live. A reader folds the log from the last checkpoint on and reads exactly those files, so a snapshot is one version, old
versions stay readable, and what a writer that died left behind is in no version.

* Commits are put where no file is yet: by a hard link on a local file system and by a rename elsewhere, both of which fail where the
  number is taken (HDFS and its like; on a store whose rename overwrites, one writer at a time is needed). The writer that comes second
  looks at what was committed meanwhile: appends go on behind it; an upsert, a delete or a merge goes on where those commits touched
  none of its files and added none whose key range meets its own, and is done anew on the new snapshot where they did.
* Writes are at file level: the files that hold a key of the new rows are found by the key ranges of the log and one column-pruned
  semi-join, and those alone are written anew. Files are laid out by ranges of the cluster columns, so related rows share files, and a filter
  on those columns prunes files before Spark plans a scan.
* A commit may carry a writer's name and number (``txn``): a number that is already in the log isn't written again, so a batch that is
  repeated after a restart changes nothing.
* ``vacuum`` removes files that no version in keeping names and that are older than a grace time, which must be longer than any write.

The driver sees one log entry a file, never rows. Null keys equal each other, as rows without a key must be replaceable too.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Commits between two full listings, and how often a write is begun anew when others come first.
CHECKPOINT, TRIES = 16, 8


class Conflict(RuntimeError):
    """Others kept committing before this write."""


@dataclass
class Snapshot:
    version: int
    #: file name below data: {"rows": n, "range": {column: [least, greatest]}}
    files: dict[str, dict] = field(default_factory=dict)
    schema: dict | None = None
    txn: dict[str, int] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(f["rows"] for f in self.files.values())


class _Files:
    """The few file operations that the log needs, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.jvm = spark, spark._jvm
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> dict[str, int]:
        """Names in a folder, with the times of their last change in milliseconds."""
        path = self.path(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in self.fs.listStatus(path)} if self.fs.exists(path) else {}

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """Whether the file was put: whole, and only where there was none."""
        waiting = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        self.write(waiting, text)
        try:
            if self.local:
                plain = lambda n: self.path(n).toUri().getPath()
                os.link(plain(waiting), plain(name))
                return True
            return not self.fs.exists(self.path(name)) and self.fs.rename(self.path(waiting), self.path(name))
        except FileExistsError:
            return False
        finally:
            if self.local or self.fs.exists(self.path(waiting)):
                self.fs.delete(self.path(waiting), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _plain(value):
    """A key's least or greatest value as JSON keeps it; None where it can't be compared there."""
    return value if isinstance(value, (int, float, str, bool)) else None


def _meets(a: list, b: list) -> bool:
    """Whether two ranges may share a value; unknown ends meet everything."""
    if None in (*a, *b):
        return True
    return a[0] <= b[1] and b[0] <= a[1]


class SnapshotTable:
    def __init__(self, spark: SparkSession, folder: str, key: list[str], cluster: list[str] | None = None, file_rows: int = 1_000_000):
        self.spark, self.folder, self.key, self.cluster, self.file_rows = spark, folder.rstrip("/"), key, cluster or key, file_rows
        self.files = _Files(spark, self.folder)
        self._log: dict[int, dict] = {}

    # reading

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.folder}/log") if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, version: int) -> dict:
        if version not in self._log:
            self._log[version] = json.loads(self.files.read(f"{self.folder}/log/{version:020d}.json"))
        return self._log[version]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The table as of a version, the last if none is named; version -1 is the table before its first commit."""
        known = self.versions()
        upto = (known[-1] if known else -1) if version is None else version
        if upto >= 0 and upto not in known:
            raise ValueError(f"no version {upto} in {self.folder}")
        out = Snapshot(upto)
        first = max((v for v in known if v <= upto and v % CHECKPOINT == 0), default=0)
        for v in range(first, upto + 1):
            entry = self._entry(v)
            if v == first and "all" in entry:
                out.files = dict(entry["all"])
            for name in entry["removed"]:
                out.files.pop(name, None)
            out.files |= entry["added"]
            out.schema = entry["schema"] or out.schema
            out.txn |= entry["txn"]
        return out

    def read(self, version: int | None = None, ranges: dict[str, tuple] | None = None, values: dict[str, list] | None = None) -> DataFrame | None:
        """The rows of a version, None before the first commit; with ``ranges`` (column: least, greatest) or ``values`` (column: some values) only
        files that may hold such rows."""
        snapshot = self.snapshot(version)
        return self._read(snapshot, names=self.pruned(snapshot, ranges, values))

    def pruned(self, snapshot: Snapshot, ranges: dict[str, tuple] | None = None, values: dict[str, list] | None = None) -> list[str]:
        """The files that may hold rows in the ranges and with one of the values."""

        def may(f: dict) -> bool:
            held = f["range"]
            return all(_meets(held.get(c, [None]), list(r)) for c, r in (ranges or {}).items()) and all(any(_meets(held.get(c, [None]), [v, v]) for v in some) for c, some in (values or {}).items())

        return [n for n, f in sorted(snapshot.files.items()) if may(f)]

    def _read(self, snapshot: Snapshot, ranges: dict[str, tuple] | None = None, names: list[str] | None = None) -> DataFrame | None:
        if snapshot.schema is None:
            return None
        schema = T.StructType.fromJson(snapshot.schema)
        names = self.pruned(snapshot, ranges) if names is None else names
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/data/{n}" for n in names])

    def history(self) -> list[dict]:
        """Each commit: version, what it did, files added and removed, rows of both."""
        out, sizes = [], {}
        for v in self.versions():
            entry = self._entry(v)
            sizes |= {n: f["rows"] for n, f in entry.get("all", {}).items()} | {n: f["rows"] for n, f in entry["added"].items()}
            out.append({"version": v, "did": entry["did"], "files_added": len(entry["added"]), "files_removed": len(entry["removed"]), "rows_added": sum(f["rows"] for f in entry["added"].values()), "rows_removed": sum(sizes.get(n, 0) for n in entry["removed"])})
        return out

    # writing

    def _store(self, rows: DataFrame) -> dict[str, dict]:
        """Rows as new files in ranges of the cluster columns, and what the log keeps of each."""
        name = uuid.uuid4().hex
        path = f"{self.folder}/data/{name}"
        order = [F.col(c) for c in dict.fromkeys([*self.cluster, *self.key])]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", self.file_rows).parquet(path)
        ranged = list(dict.fromkeys([*self.key, *self.cluster]))
        ends = [f(c).alias(f"{k}_{i}") for i, c in enumerate(ranged) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]
        told = self.spark.read.schema(rows.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), *ends)
        found = {}
        for r in told.collect():  # a row a file
            # a column with nulls has no range that can be trusted
            ranges = {c: [_plain(r[f"lo_{i}"]), _plain(r[f"hi_{i}"])] if r[f"n_{i}"] == r.rows else [None, None] for i, c in enumerate(ranged)}
            found[f"{name}/{r.file}"] = {"rows": r.rows, "range": ranges}
        return found

    def _commit(self, base: Snapshot, did: str, added: dict, removed: list[str], schema: dict, txn: tuple[str, int] | None, clash: Callable[[dict], bool]) -> int | None:
        """The version that this became; None where a commit since ``base`` clashes with it."""
        number = base.version + 1
        while True:
            entry = {"did": did, "added": added, "removed": removed, "schema": schema, "txn": dict([txn] if txn else []), "at": int(time.time() * 1000)}
            if number % CHECKPOINT == 0 and number:
                now = self.snapshot(number - 1)
                entry |= {"all": {n: f for n, f in now.files.items() if n not in removed}, "txn": now.txn | entry["txn"]}
            if self.files.put_if_absent(f"{self.folder}/log/{number:020d}.json", json.dumps(entry)):
                return number
            if clash(self._entry(number)):
                return None
            number += 1

    def append(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> int:
        """rows behind those of the table; others' commits don't matter to it."""
        base = self.snapshot()
        if self._done(base, txn):
            return base.version
        version = self._commit(base, "append", self._store(rows), [], rows.schema.jsonValue(), txn, lambda other: bool(txn) and other["txn"].get(txn[0], -1) >= txn[1])
        return self.snapshot().version if version is None else version

    def _done(self, base: Snapshot, txn: tuple[str, int] | None) -> bool:
        return bool(txn) and base.txn.get(txn[0], -1) >= txn[1]

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], txn: tuple[str, int] | None = None, did: str = "merge") -> int:
        """In place of the table's rows that have a key of ``rows``: combine(those, rows). Only files that hold such rows are written anew."""
        keys = rows.select(*self.key).distinct()
        bounds = keys.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(self.key) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))], F.count("*").alias("rows")).first()
        ranges = {c: (_plain(bounds[f"lo_{i}"]), _plain(bounds[f"hi_{i}"])) if bounds[f"n_{i}"] == bounds.rows else (None, None) for i, c in enumerate(self.key)}
        for _ in range(TRIES):
            base = self.snapshot()
            if self._done(base, txn) or not bounds.rows:
                return base.version
            old = self._read(base, ranges)
            touched: list[str] = []
            if old is None or not self.pruned(base, ranges):
                made = combine(self.spark.createDataFrame([], rows.schema if old is None else old.schema), rows)
            else:
                match = self._same(old, keys)
                held = old.select(*self.key, F.col("_metadata.file_path").alias("__file")).join(keys, match, "left_semi").select("__file").distinct().collect()  # a row a file
                touched = sorted("/".join(r[0].rsplit("/", 2)[1:]) for r in held)
                before = self._read(base, names=touched)
                match = self._same(before, keys)
                made = combine(before.join(keys, match, "left_semi"), rows)
                made = before.join(keys, match, "left_anti").unionByName(made, allowMissingColumns=True)
            added = self._store(made)
            gone = set(touched)

            def clash(other: dict) -> bool:
                return bool(gone & set(other["removed"])) or any(all(_meets(f["range"].get(c, [None]), list(r)) for c, r in ranges.items()) for f in other["added"].values()) or bool(txn and other["txn"].get(txn[0], -1) >= txn[1])

            version = self._commit(base, did, {n: f for n, f in added.items() if f["rows"]}, touched, made.schema.jsonValue(), txn, clash)
            if version is not None:
                return version
        raise Conflict(f"{TRIES} writes to {self.folder} came too late")

    def _same(self, rows: DataFrame, keys: DataFrame) -> Column:
        found = F.lit(True)
        for c in self.key:
            found = found & rows[c].eqNullSafe(keys[c])
        return found

    def upsert(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> int:
        """rows in place of those with the same keys."""
        return self.merge(rows, lambda old, new: new, txn, "upsert")

    def delete(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> int:
        """The table without the rows that have a key of ``rows``."""
        return self.merge(rows.select(*self.key), lambda old, new: old.limit(0), txn, "delete")

    # upkeep

    def compact(self, least_rows: int | None = None) -> int:
        """Files of fewer rows than ``least_rows`` (half of file_rows) as few larger ones; rows stay as they are."""
        bound = least_rows or self.file_rows // 2
        base = self.snapshot()
        small = sorted(n for n, f in base.files.items() if f["rows"] < bound)
        if len(small) < 2:
            return base.version
        gone = set(small)
        version = self._commit(base, "compact", self._store(self._read(base, names=small)), small, base.schema, None, lambda other: bool(gone & set(other["removed"])))
        if version is None:
            raise Conflict(f"files of {self.folder} were rewritten meanwhile")
        return version

    def vacuum(self, keep: int = 1, grace_seconds: float = 7 * 86_400) -> list[str]:
        """Removes the folders of files that none of the last ``keep`` versions names and that are older than the grace time; says which."""
        named = {n.split("/")[0] for v in self.versions()[-keep:] for n in self.snapshot(v).files}
        old = time.time() * 1000 - grace_seconds * 1000
        gone = sorted(n for n, changed in self.files.names(f"{self.folder}/data").items() if n not in named and changed < old)
        for n in gone:
            self.files.delete(f"{self.folder}/data/{n}")
        return gone
