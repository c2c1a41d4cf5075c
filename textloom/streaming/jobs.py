"""Stateful work over event streams, by Structured Streaming; each job also runs to its end over what is there (availableNow)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.shared import new_folder
from textloom.sources.snapshot import SnapshotTable


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table (one file or a folder of files) as a stream; times without a zone become timestamps, as watermarks need them."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        rows = reader.parquet(path)
    else:  # a stream reads folders
        rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"})


def run_to_end(out: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a streaming query has written when all present input is read."""
    spark = out.sparkSession
    path = new_folder(spark, name)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def merged_to_end(rows: DataFrame, name: str, key: list[str], combine: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A snapshot table kept up to date batch by batch: of the rows with a batch's keys ``combine(old, batch)`` stays, and only files that hold
    such keys are written anew. Each batch is committed under its number, so one that is repeated after a restart changes nothing."""
    spark = rows.sparkSession
    path = new_folder(spark, name)

    def each(batch: DataFrame, number: int) -> None:
        SnapshotTable(batch.sparkSession, f"{path}/table", key).merge(batch, combine, txn=(name, number))

    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = SnapshotTable(spark, f"{path}/table", key).read()
    none = spark.createDataFrame([], rows.schema)
    return combine(none, none) if found is None else found


def window_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour", by: str = "event_type", ts: str = "ts") -> DataFrame:
    """Counts and sums of each window and kind; rows later than ``late`` are dropped, windows are given out once they are closed."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), by, "n", F.round("total", 4).alias("total"))


def user_sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    found = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), user).agg(F.count("*").alias("n_events"))
    return found.select(user, F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("end_ts"), "n_events")


def latest_per_key(old: DataFrame, batch: DataFrame, key: list[str], order: str) -> DataFrame:
    """Debounce: of events with one key the last stays."""
    rows = old.unionByName(batch)
    others = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(order)).alias("x"))
    return last.select(*key, *[F.col(f"x.{c}").alias(c) for c in others])


def limited(pdfs: Iterator[pd.DataFrame], most: int, seconds: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by client and time, with whether each is let through: at most ``most`` accepted ones in the trailing seconds;
    refused ones don't count. Only one client's accepted times are in memory."""
    client, accepted = None, deque()
    for pdf in pdfs:
        verdicts = []
        for user, t in zip(pdf["user_id"], pdf["micros"]):
            if user != client:
                client, accepted = user, deque()
            while accepted and t - accepted[0] >= seconds * 1e6:
                accepted.popleft()
            ok = len(accepted) < most
            if ok:
                accepted.append(t)
            verdicts.append(ok)
        yield pdf.assign(allowed=verdicts)


def rate_limited(events: DataFrame, most: int = 3, seconds: float = 60) -> DataFrame:
    """event_id, user_id, allowed. The rule reads a client's events one after another; clients are spread over tasks, and a
    client with very many events streams through its task."""
    rows = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "micros", "event_id")
    return ordered.mapInPandas(lambda it: limited(it, most, seconds), "event_id long, user_id long, micros long, allowed boolean").select("event_id", "user_id", "allowed")


def carried(batches: Iterator[pa.RecordBatch], most: int, seconds: float) -> Iterator[pa.RecordBatch]:
    """Rows (event_id, user_id, micros, kept) sorted by client, its kept times first, then by time: verdicts as in limited, and after
    each client the accepted times to keep, numbered in their order."""
    client, accepted, known = None, deque(), False
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    names = ["event_id", "user_id", "micros", "allowed", "kept"]
    told = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
    for batch in batches:
        out = []
        for event, user, t, kept in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if not known or user != client:
                out += [(k, client, x, True, True) for k, x in enumerate(accepted)]
                client, accepted, known = user, deque(), True
            if kept:
                accepted.append(t)
                continue
            while accepted and t - accepted[0] >= seconds * 1e6:
                accepted.popleft()
            ok = len(accepted) < most
            if ok:
                accepted.append(t)
            out.append((event, user, t, ok, False))
        yield told(out)
    yield told([(k, client, x, True, True) for k, x in enumerate(accepted)])


def rate_limits_to_end(events: DataFrame, name: str, most: int = 3, seconds: float = 60) -> DataFrame:
    """The same rule over a stream, run to its end. Each batch is sorted and streams through its tasks behind the times that the
    batch before kept of each client, so no client's events are held together. A repeated batch writes its version again."""
    spark = events.sparkSession
    path = new_folder(spark, name)
    shape = "event_id long, user_id long, micros long, allowed boolean, kept boolean"

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_id", "user_id", F.unix_micros("ts").alias("micros"), F.lit(False).alias("kept"))
        if number:
            rows = rows.unionByName(batch.sparkSession.read.schema(shape).parquet(f"{path}/v{number - 1}").where("kept").drop("allowed"))
        place = F.when(F.col("kept"), F.col("event_id")).otherwise(F.col("micros"))
        ordered = rows.repartition("user_id").sortWithinPartitions("user_id", F.desc("kept"), place, "event_id")
        ordered.mapInArrow(lambda it: carried(it, most, seconds), shape).write.mode("overwrite").parquet(f"{path}/v{number}")

    query = events.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(shape).parquet(f"{path}/v*").where("not kept").select("event_id", "user_id", "allowed")
