"""Roll-ups against the events themselves: sums exactly, sketches within their bounds, late days."""

import numpy as np
from pyspark.sql import functions as F

from textloom.operators.rollup import RollUps

SF = "/root/testdata/sf0.1/events.parquet"


def test_weeks_from_days(spark, tmp_path):
    events = spark.read.parquet(SF)
    ups = RollUps(spark, f"file://{tmp_path}/r")
    ups.put(events)
    got = {(r.week, r.kind): r for r in ups.weekly().collect()}
    rows = events.select(F.date_trunc("week", "ts").cast("date").alias("week"), "event_type", "user_id", "value").toPandas()
    for (week, kind), g in rows.groupby(["week", "event_type"]):
        r = got.pop((week, kind))
        assert r.n == len(g) and abs(r.total - g.value.sum()) < 1e-6 * abs(g.value.sum())
        assert abs(r.n_users / g.user_id.nunique() - 1) < 5 * 1.04 / np.sqrt(2**12)
        values = np.sort(g.value)
        for p, x in ((0.5, r.p50), (0.95, r.p95)):
            low, high = np.searchsorted(values, x, "left") / len(values), np.searchsorted(values, x, "right") / len(values)
            assert low - 0.02 <= p <= high + 0.02
    assert not got


def test_late_days_are_replaced(spark, tmp_path):
    day = lambda d, k, v: (f"2024-01-{d:02d} 10:00:00", k, v % 7, float(v))
    table = lambda rows: spark.createDataFrame(rows, "ts string, event_type string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    ups = RollUps(spark, f"file://{tmp_path}/r")
    ups.put(table([day(1, "a", i) for i in range(10)] + [day(2, "a", 1), day(3, "b", 5)]), ("daily", 1))
    ups.put(table([day(2, "a", 1), day(2, "c", 2), day(2, "c", 3)]), ("daily", 2))  # one late event changed the day's kinds
    ups.put(table([day(2, "z", 1)]), ("daily", 2))  # the same write again
    assert [(str(r.day), r.n, r.n_delta) for r in ups.deltas().orderBy("day").collect()] == [("2024-01-01", 10, None), ("2024-01-02", 3, -7), ("2024-01-03", 1, -2)]
    assert {(r.kind, r.n, r.n_users) for r in ups.weekly().collect()} == {("a", 11, 7), ("b", 1, 1), ("c", 2, 2)}
    assert ups.days("2024-01-02", "2024-01-02").count() == 2
