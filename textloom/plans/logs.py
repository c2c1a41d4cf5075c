"""Queries: analytics over the event log, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import logs as L
from textloom.operators import reports as R
from textloom.operators.rollup import RollUps
from textloom.operators.running import running_mean
from textloom.plans.base import query
from textloom.shared import new_folder
from textloom.sources.tables import table
from textloom.streaming import jobs as J
from textloom.streaming.sessions import rocks_state, session_log

NOW = "2024-01-25 12:00:00"
_WEEK = f"(SELECT * FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY)"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.window_of_days(_events(spark, sf_dir), NOW)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


@query(f"SELECT {_K} AS k, count(*) AS count FROM {_WEEK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.most_frequent(_week(spark, sf_dir).withColumn("k", _k()), "k")


@query(f"SELECT {_K} AS k, count(*) AS count FROM {_WEEK} WHERE value < 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def zero_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.most_frequent(_week(spark, sf_dir).where("value < 1").withColumn("k", _k()), "k")


@query(f"SELECT event_id, user_id, event_type, value FROM {_WEEK} WHERE value >= 30 ORDER BY value DESC, event_id LIMIT 20")
def slow_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.slowest(_week(spark, sf_dir), "value", "event_id", threshold=30).select("event_id", "user_id", "event_type", "value")


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM {_WEEK} GROUP BY 1")
def by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _week(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH x AS (SELECT unnest([user_id, {_K}]) AS file FROM {_WEEK}) SELECT file, count(*) AS count FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent members of a list column."""
    return L.most_frequent(_week(spark, sf_dir).select(F.explode(F.array("user_id", _k())).alias("file")), "file")


@query(f"SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM {_WEEK})")
def cold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cold(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), _week(spark, sf_dir), "user_id")


@query(f"""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, count(*) FILTER (WHERE value < 1) AS n_zero, count(*) FILTER (WHERE value >= 30) AS n_slow, max(value) AS slowest FROM {_WEEK} GROUP BY 1""")
def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _week(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value") < 1).alias("n_zero"), F.count_if(F.col("value") >= 30).alias("n_slow"), F.max("value").alias("slowest")
    )


_PERCENTILES = """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
 SELECT event_type, max(CASE WHEN k = n // 2 THEN value END) AS p50, max(CASE WHEN k = floor(n * 0.95) THEN value END) AS p95, max(CASE WHEN k = floor(n * 0.99) THEN value END) AS p99 FROM s GROUP BY 1"""


@query(_PERCENTILES)
def percentile_rank_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rank_percentiles(_events(spark, sf_dir), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"WITH p AS ({_PERCENTILES}), a AS (SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value >= 30) AS errors, round(avg(CASE WHEN value >= 30 THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1) SELECT * FROM a JOIN p USING (event_type)")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    sums = e.groupBy("event_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("value") >= 30).alias("errors"), L.share(F.col("value") >= 30).alias("error_rate"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    return sums.join(L.rank_percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "event_type")


@query(f"SELECT CAST(date_trunc('day', ts) AS DATE) AS day, round(avg({_K}), 6) AS avg_results, round(avg(CASE WHEN {_K} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(value), 6) AS avg_latency FROM events WHERE event_type = 'view' GROUP BY 1")
def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'view'").withColumn("k", _k())
    return e.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("k"), 6).alias("avg_results"), L.share(F.col("k") > 0).alias("hit_rate"), F.round(F.avg("value"), 6).alias("avg_latency"))


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS n_{t}" for t in ("click", "error", "view")) + " FROM events GROUP BY 1")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "error", "view"]
    pivoted = _events(spark, sf_dir).groupBy("user_id").pivot("event_type", kinds).count()
    return pivoted.select("user_id", *[F.coalesce(F.col(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds])


@query("SELECT user_id, count(*) AS n, list(event_id ORDER BY event_id)[1:5] AS samples FROM events WHERE event_type = 'error' GROUP BY 1")
def error_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by user with the first five; the samples are cut before they are gathered."""
    errors = _events(spark, sf_dir).where("event_type = 'error'")
    first = L.last_of_each(errors, "user_id", [F.col("event_id")], 5).groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("samples"))
    return errors.groupBy("user_id").agg(F.count("*").alias("n")).join(first, "user_id")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_error, max(value) AS peak FROM events GROUP BY 1),
 s AS (SELECT *, n_error * 5 > n AS many_errors, peak >= 60 AS slow, n < 300 AS quiet FROM d)
 SELECT day, many_errors, slow, quiet, CAST(many_errors::INT + slow::INT + quiet::INT AS BIGINT) AS issues, CASE many_errors::INT + slow::INT + quiet::INT WHEN 0 THEN 'healthy' WHEN 1 THEN 'watch' ELSE 'broken' END AS level FROM s""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_error"), F.max("value").alias("peak"))
    told = L.health(days, {"many_errors": F.col("n_error") * 5 > F.col("n"), "slow": F.col("peak") >= 60, "quiet": F.col("n") < 300})
    return told.select("day", "many_errors", "slow", "quiet", "issues", "level")


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, n - lag(n) OVER (ORDER BY day) AS n_delta FROM d")
def daily_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.daily_delta(_events(spark, sf_dir), "ts", F.count("*"), "n")


_SESSIONS = """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
 s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 1 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)"""


@query(f"{_SESSIONS} SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, session")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sessions(_events(spark, sf_dir))


@query(f"{_SESSIONS}, g AS (SELECT user_id, session, count(*) AS n, epoch(max(ts) - min(ts)) AS seconds FROM s GROUP BY user_id, session) SELECT count(*) AS n_sessions, count(DISTINCT user_id) AS n_users, round(avg(n), 6) AS avg_events, round(avg(seconds), 3) AS avg_seconds FROM g")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.sessions(_events(spark, sf_dir)).withColumn("seconds", (F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1e6)
    return s.agg(F.count("*").alias("n_sessions"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("n_events"), 6).alias("avg_events"), F.round(F.avg("seconds"), 3).alias("avg_seconds"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type FROM r WHERE k <= 50")
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.last_of_each(_events(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("event_id")], 50).select("user_id", "event_id", "event_type")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT event_type, round(avg(value), 6) AS mean FROM r WHERE k <= 1000 GROUP BY 1")
def last_n_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = L.last_of_each(_events(spark, sf_dir), "event_type", [F.desc("ts"), F.desc("event_id")], 1000)
    return kept.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.trailing_count(_events(spark, sf_dir), "user_id", "ts", "n").select("event_id", "n")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 10) AS mean FROM events")
def running_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return running_mean(events, "value", "user_id", ["ts", "event_id"], F.date_trunc("hour", "ts")).select("event_id", F.round("mean", 10).alias("mean"))


@query(r"""WITH r AS (SELECT user_id, 'mode=' || event_type || ' success: ' || event_id || ' RSS ' || CAST(floor(value) AS BIGINT) || ' MB RSS ' || CAST(floor(value) * 2 AS BIGINT) || ' MB' AS text FROM events)
 SELECT user_id, text, regexp_extract(text, 'mode=(\w+)', 1) AS mode, regexp_extract(text, 'success[=: ]+([0-9]+)', 1) AS success, list_max([CAST(x AS BIGINT) for x in regexp_extract_all(text, 'RSS[=: ]+([0-9]+)', 1)]) AS rss_peak FROM r""")
def run_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs written from events, and read again by pattern."""
    mb = F.floor("value")
    text = F.concat(F.lit("mode="), "event_type", F.lit(" success: "), F.col("event_id").cast("string"), F.lit(" RSS "), mb.cast("string"), F.lit(" MB RSS "), (mb * 2).cast("string"), F.lit(" MB"))
    runs = L.parsed_runs(_events(spark, sf_dir).select("user_id", text.alias("text")))
    return runs.select("user_id", "text", "mode", "success", "rss_peak")


@query("""WITH q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'view'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'click')
 SELECT q.user_id, q.event_id, r.value AS result FROM q LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (user_id) WHERE q.k = 1""")
def latest_with_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    results = e.where("event_type = 'click'").withColumnRenamed("value", "result")
    queries = e.where("event_type = 'view'").select("user_id", "event_id", "ts")
    return L.attached_to_latest(queries, results, "user_id", [F.desc("ts"), F.desc("event_id")], ["result"]).select("user_id", "event_id", "result")


@query(f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY")
def metric_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.retained(_events(spark, sf_dir), "ts", NOW, 3).select("event_id", "user_id")


@query(f"""WITH e AS (SELECT event_type, value, {_K} / 100.0::DOUBLE AS g FROM events), s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM e),
 p AS (SELECT event_type, max(CASE WHEN k = floor(n * 0.95) THEN value END) AS p95_latency FROM s GROUP BY 1)
 SELECT event_type, count(*) AS n_answers, round(avg(g), 6) AS avg_grounded, round(avg(value), 6) AS avg_latency, any_value(p95_latency) AS p95_latency FROM e JOIN p USING (event_type) GROUP BY 1""")
def ask_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.asked(_events(spark, sf_dir).withColumn("g", _k() / 100.0), "event_type", "g", "value")


# --- roll-ups ------------------------------------------------------------------------------------------------------------


def _rolled_up(spark: SparkSession, sf_dir: str) -> RollUps:
    """Days without their clicks first, then each day anew with all its events."""
    ups = RollUps(spark, new_folder(spark, "rollups"))
    ups.put(_events(spark, sf_dir).where("event_type <> 'click'"))
    ups.put(_events(spark, sf_dir))
    return ups


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def rollup_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks from stored days."""
    return _rolled_up(spark, sf_dir).weekly().select("week", "kind", "n", F.round("total", 4).alias("total"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS total FROM events GROUP BY 1)
 SELECT day, n, round(total, 4) AS total, n - lag(n) OVER (ORDER BY day) AS n_delta, round(total - lag(total) OVER (ORDER BY day), 4) AS total_delta FROM d""")
def rollup_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day beside the day before, from stored days."""
    return _rolled_up(spark, sf_dir).deltas().withColumns({c: F.round(c, 4) for c in ("total", "total_delta")})


@query()
def rollup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and percentiles of each week, from the days' sketches."""
    return _rolled_up(spark, sf_dir).weekly().select("week", "kind", "n_users", "p50", "p95")


# --- reports ---------------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*)::DOUBLE AS events, count(*) FILTER (WHERE event_type = 'error')::DOUBLE AS errors, count(DISTINCT user_id)::DOUBLE AS users, max(value) AS slowest FROM events GROUP BY 1),
 k AS (UNPIVOT d ON events, errors, users, slowest INTO NAME key VALUE value)
 SELECT k.day, k.key, k.value, b.value AS before, round(k.value - b.value, 4) AS delta FROM k LEFT JOIN k b ON b.key = k.key AND b.day = k.day - INTERVAL 1 DAY""")
def report_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily reports written as files, read again, each day's figures beside the day before."""
    days = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"), F.max("value").alias("slowest")
    )
    folder = new_folder(spark, "reports")
    R.put(days.select("day", R.rendered(F.col("day").cast("string"), {c: F.col(c) for c in ("events", "errors", "users", "slowest")}).alias("text")), folder)
    return R.beside_day_before(R.read(spark, folder)).withColumn("delta", F.round("delta", 4))


@query("SELECT CAST(ts AS DATE) AS day, event_type AS kind, event_type || '_' || strftime(max(ts), '%Y%m%d_%H%M%S') || '.log' AS name FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def latest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's last log of each kind, by the names of logs begun at every event."""
    name = F.concat("event_type", F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".log"))
    return R.latest_logs(_events(spark, sf_dir).select(name.alias("name")), ["click", "error", "purchase", "signup"])


# --- streaming ------------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
 SELECT CAST(window_start AS TIMESTAMPTZ) AS window_start, event_type, n, total FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts as the stream gives them out: the windows that the watermark has closed."""
    return J.run_to_end(J.window_counts(J.stream(spark, sf_dir, "events")), "windows")


@query(f"""{_SESSIONS}, g AS (SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 1 HOUR AS end_ts, count(*) AS n_events FROM s GROUP BY user_id, session)
 SELECT user_id, CAST(first_ts AS TIMESTAMPTZ) AS first_ts, CAST(end_ts AS TIMESTAMPTZ) AS end_ts, n_events FROM g WHERE end_ts <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.run_to_end(J.user_sessions(J.stream(spark, sf_dir, "events")), "sessions")


@query(f"""{_SESSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts DESC, event_id DESC) AS k FROM s),
 g AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events, string_agg(event_id, ',' ORDER BY ts, event_id) FILTER (WHERE k <= 50) AS recent FROM r GROUP BY user_id, session)
 SELECT user_id, CAST(first_ts AS TIMESTAMPTZ) AS first_ts, CAST(last_ts AS TIMESTAMPTZ) AS last_ts, n_events, recent FROM g WHERE last_ts + INTERVAL 2 HOUR < (SELECT date_trunc('millisecond', max(ts)) FROM events)""")
def stream_session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have ended, with their last 50 events, from keyed state with timers."""
    with rocks_state(spark):
        return J.run_to_end(session_log(J.stream(spark, sf_dir, "events")), "session-log")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM r WHERE k = 1")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind, kept up to date batch by batch."""
    rows = J.stream(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return J.merged_to_end(rows, "debounce", ["user_id", "event_type"], lambda old, batch: J.latest_per_key(old, batch, ["user_id", "event_type"], "event_id"))


_LIMITED = """WITH RECURSIVE o AS MATERIALIZED (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 a AS (SELECT event_id, user_id, ts FROM o WHERE k = 1 UNION ALL
  SELECT o.event_id, o.user_id, o.ts FROM (SELECT o.user_id AS u, min(o.k) AS next FROM a JOIN o ON o.user_id = a.user_id AND o.ts >= a.ts + INTERVAL 1 HOUR GROUP BY 1) n JOIN o ON o.user_id = u AND o.k = next)
 SELECT event_id, user_id, event_id IN (SELECT event_id FROM a) AS allowed FROM events"""


@query(_LIMITED)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rate_limited(_events(spark, sf_dir), most=1, seconds=3600)


@query(_LIMITED)
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.rate_limits_to_end(J.stream(spark, sf_dir, "events"), "limits", most=1, seconds=3600)
