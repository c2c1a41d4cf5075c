"""Stateful sessions: batches, order, restarts, strict expiry, bounded history."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from textloom.streaming.sessions import rocks_state, session_log

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "user_id long, ts timestamp, event_id long"


def by_hand(rows, gap=3600, keep=5, late=600):
    ended, passed = [], max(t for _, t, _ in rows) - late
    for user in {u for u, _, _ in rows if u is not None}:
        sessions = []
        for t, e in sorted((t, e) for u, t, e in rows if u == user):
            if sessions and t - sessions[-1][-1][0] <= gap:
                sessions[-1].append((t, e))
            else:
                sessions.append([(t, e)])
        ended += [(user, s[0][0], s[-1][0], len(s), ",".join(str(e) for _, e in s[-keep:])) for s in sessions if s[-1][0] + gap < passed]
    return sorted(ended)


def write(spark, folder, rows):
    frame = spark.createDataFrame([(u, START + timedelta(seconds=t), e) for u, t, e in rows], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder):
    """All files that are there, one a batch, from where the checkpoint stands."""
    with rocks_state(spark):
        out = session_log(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), keep=5, late="10 minutes")
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    return sorted((r.user_id, (r.first_ts.astimezone(timezone.utc) - START).total_seconds(), (r.last_ts.astimezone(timezone.utc) - START).total_seconds(), r.n_events, r.recent) for r in got.collect())


def test_batches_out_of_order_and_a_restart(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, 3, None]), t + rnd.randint(-250, 250), i) for i, t in enumerate(range(1000, 90_000, 600))]
    rows += [(7, 1000 + 3600 * k, 1000 + k) for k in range(9)]  # gaps of an hour exactly end nothing
    rows += [(8, 2000, 2000), (8, 5601, 2001)]  # an hour and a second does
    rows.sort(key=lambda r: r[1] + rnd.randint(0, 200))
    folder = str(tmp_path)
    for k in range(0, 90, 30):
        write(spark, f"{folder}/in", rows[k : k + 30])
    first = run(spark, folder)
    assert first and set(first) < set(by_hand(rows))
    for k in range(90, len(rows), 30):
        write(spark, f"{folder}/in", rows[k : k + 30])
    got = run(spark, folder)
    assert got == by_hand(rows)
    assert [r[3] for r in got if r[0] == 7] == [9] and [r[3] for r in got if r[0] == 8] == [1, 1]
    assert max(len(r[4].split(",")) for r in got) == 5
