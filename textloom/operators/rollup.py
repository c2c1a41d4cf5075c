"""Reports from stored roll-ups: a row a day and kind, with exact counts and sums and mergeable sketches, from which longer reports are made without
reading events again.

Distinct users are HyperLogLog sketches (standard error about 1.04 / sqrt(2**lg_k)), values KLL sketches (rank error about 1.7 / k); both merge, so
a week's estimate is as good as a day's. Days are replaced whole: events of a day that come late are rolled up again with the rest of their day,
and one commit puts the new rows in place of the day's old ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.sources.snapshot import SnapshotTable

LG_K, K = 12, 400


def daily(events: DataFrame, ts: str = "ts", kind: str = "event_type", user: str = "user_id", value: str = "value") -> DataFrame:
    """(day, kind, n, total, users, spread): counts, sums and both sketches."""
    rows = events.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("day"), F.col(kind).alias("kind"), F.col(user).alias("user"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("day", "kind").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.hll_sketch_agg(F.col("user").cast("long"), F.lit(LG_K)).alias("users"), F.kll_sketch_agg_double("value", F.lit(K)).alias("spread")
    )


class RollUps:
    """Stored days."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = SnapshotTable(spark, folder, ["day"])

    def put(self, events: DataFrame, txn: tuple[str, int] | None = None) -> int:
        """Rolls whole days up: events must be all that there are of their days."""
        return self.table.upsert(daily(events), txn)

    def days(self, first: str | None = None, last: str | None = None) -> DataFrame:
        rows = self.table.read()
        return rows if first is None else rows.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))

    def weekly(self) -> DataFrame:
        """(week, kind, n, total, n_users, p50, p95) of each week, by merged sketches."""
        merged = self.days().groupBy(F.date_trunc("week", "day").cast("date").alias("week"), "kind")
        merged = merged.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_union_agg("users").alias("users"), F.kll_merge_agg_double("spread").alias("spread"))
        quantile = lambda p: F.kll_sketch_get_quantile_double("spread", F.lit(p))
        return merged.select("week", "kind", "n", "total", F.hll_sketch_estimate("users").alias("n_users"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"))

    def deltas(self) -> DataFrame:
        """(day, n, total, n_delta, total_delta): each day beside the stored day before it."""
        by_day = self.days().groupBy("day").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        w = Window.orderBy("day")  # as many rows as there are days
        return by_day.withColumn("n_delta", F.col("n") - F.lag("n").over(w)).withColumn("total_delta", F.col("total") - F.lag("total").over(w))
