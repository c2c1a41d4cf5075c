"""Registration of queries and of the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.shared import new_folder
from textloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, kind: str, build: Callable[[str, DataFrame], object]) -> object:
    """What ``build`` makes of a table in a new folder, once a session for the table's files as they are: other names, lengths or times of
    change make another."""
    df = table(spark, sf_dir, name)
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = [(p, p.getFileSystem(conf).getFileStatus(p)) for p in map(path, sorted(df.inputFiles()))]
    key = (kind, spark.sparkContext.applicationId, *((p.toString(), s.getLen(), s.getModificationTime()) for p, s in files))
    if key not in _STORED:
        _STORED[key] = build(new_folder(spark, kind), df)
    return _STORED[key]


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: DuckDB's way to the same tokens.
TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: length(x) >= 2)"
