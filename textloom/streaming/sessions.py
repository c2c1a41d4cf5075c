"""Sessions as keyed state: each user's open session, its last events, and a timer that ends it.

Events wait in a list until the watermark has passed them, so those that arrive out of order are taken in order; they are then folded into
the open session (first and last time, count) and its history, of which the last ``keep`` stay. A gap of more than ``gap`` ends a session, and so
does the watermark when it passes the session's last event by more than that: a timer is set for it. State is what a user's open session needs: the
waiting events of one watermark delay, the history, three numbers; a user whose session ended has none.

Results are those of sorting all events by user and time, whatever batches they come in, but for events later than the watermark, which are
dropped. State lives in the checkpoint, so a query that is started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = "user_id long, first_ts timestamp, last_ts timestamp, n_events long, recent string"


class SessionLog(StatefulProcessor):
    def __init__(self, gap_seconds: float, keep: int):
        self.gap, self.keep = int(gap_seconds * 1_000_000), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, event_id long")
        self.recent = handle.getListState("recent", "event_id long")
        self.open = handle.getValueState("open", "first long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(m), int(e)) for pdf in rows for m, e in zip(pdf["micros"], pdf["event_id"])]
        if new:
            held = list(self.waiting.get()) + new if self.waiting.exists() else new
            self.waiting.put(held)
            self._wake(min(m for m, _ in held))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [x for x in held if x[0] < passed]
        later = held[len(due) :]
        now = list(self.open.get()) if self.open.exists() else None
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        ended = []
        for micros, event in due:
            if now and micros - now[1] > self.gap:
                ended.append((now, recent))
                now, recent = None, []
            now = [now[0], micros, now[2] + 1] if now else [micros, micros, 1]
            recent = [*recent, event][-self.keep :]
        if now and passed - now[1] > self.gap and not (later and later[0][0] - now[1] <= self.gap):
            ended.append((now, recent))
            now, recent = None, []
        if later:
            self.waiting.put(later)
            self._wake(later[0][0])
        else:
            self.waiting.clear()
        if now:
            self.open.update(tuple(now))
            self.recent.put([(e,) for e in recent])
            self._wake(now[1] + self.gap)
        else:
            self.open.clear()
            self.recent.clear()
        time = lambda i: pd.to_datetime([n[i] for n, _ in ended], unit="us", utc=True)
        if ended:
            yield pd.DataFrame({"user_id": [key[0]] * len(ended), "first_ts": time(0), "last_ts": time(1), "n_events": [n[2] for n, _ in ended], "recent": [",".join(map(str, r)) for _, r in ended]})
        else:
            yield pd.DataFrame()

    def _wake(self, micros: int) -> None:
        """A timer for when the watermark has passed a time."""
        self.handle.registerTimer(micros // 1000 + 1)

    def close(self) -> None:
        pass


class rocks_state:  # noqa: N801
    """Queries that are started inside keep their state in RocksDB, which lists and timers need."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(PROVIDER)
        self.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_: object) -> None:
        self.conf.set(PROVIDER, self.before)


def session_log(events: DataFrame, gap_seconds: float = 3600, keep: int = 50, late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """(user_id, first_ts, last_ts, n_events, recent): each session once it has ended, recent being the ids of its last events in order."""
    rows = events.select(F.col(user).cast("long").alias("user_id"), F.col(ts), F.unix_micros(ts).alias("micros"), F.col("event_id").cast("long")).where("user_id is not null and micros is not null")
    watched = rows.withWatermark(ts, late)
    return watched.groupBy("user_id").transformWithStateInPandas(SessionLog(gap_seconds, keep), outputStructType=ENDED, outputMode="Append", timeMode="EventTime")
