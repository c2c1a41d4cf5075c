"""Query-log and request analytics: frequencies, rank-index percentiles, sessions, rates and health."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Into how many brackets a group's values are parted before those that hold a percentile are sorted.
BRACKETS = 64


def window_of_days(log: DataFrame, now: str, days: int = 7, ts: str = "ts") -> DataFrame:
    return log.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def most_frequent(log: DataFrame, column: str, n: int = 20, name: str = "count") -> DataFrame:
    return log.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.col(name).desc(), column).limit(n)


def slowest(log: DataFrame, latency: str, key: str, threshold: float = 5000, n: int = 20) -> DataFrame:
    return log.where(F.col(latency) >= threshold).orderBy(F.col(latency).desc(), key).limit(n)


def cold(known: DataFrame, hit: DataFrame, key: str) -> DataFrame:
    """Known keys that no hit has."""
    return known.select(key).distinct().join(hit.select(key).distinct(), key, "left_anti")


def rank_percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float], brackets: int = BRACKETS) -> DataFrame:
    """For each group the zero-based elements floor(n * share) of its sorted values.

    Rows are counted by value first. Approximate quantiles part each group's values into brackets; the brackets' exact counts tell
    where each place lies, and only the brackets that hold one are sorted, so no task sorts a group.
    """
    rows = df.where(F.col(value).isNotNull())
    keys = [f"__key{k}" for k in range(len(group))]
    same = lambda a, b: reduce(and_, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)), F.lit(True))
    edges = rows.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)]).agg(F.percentile_approx(value, [k / brackets for k in range(1, brackets)], 10 * brackets).alias("__edges"))
    counted = rows.groupBy(*group, value).agg(F.count("*").alias("__n"))
    bracket = F.size(F.filter("__edges", lambda e: e < F.col(value)))
    placed = counted.join(edges, same(group, keys)).select(*group, value, "__n", bracket.alias("__bracket"))
    # at most as many rows a group as there are brackets
    sums = placed.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)], F.col("__bracket").alias("__of")).agg(F.sum("__n").alias("__in"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("__of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("__before", F.sum("__in").over(upto) - F.col("__in")).withColumn("__total", F.sum("__in").over(w))
    at = {k: F.least(F.floor(F.col("__total") * s), F.col("__total") - 1) for k, s in shares.items()}
    holds = reduce(or_, ((x >= F.col("__before")) & (x < F.col("__before") + F.col("__in")) for x in at.values()))
    few = placed.join(sums.where(holds), same([*group, "__bracket"], [*keys, "__of"]))
    running = F.col("__before") + F.sum("__n").over(Window.partitionBy(*group, "__bracket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    few = few.withColumn("__upto", running)
    here = {k: (F.col("__upto") > x) & (F.col("__upto") - F.col("__n") <= x) for k, x in at.items()}
    return few.groupBy(*group).agg(*[F.min(F.when(c, F.col(value))).alias(k) for k, c in here.items()])


def share(condition: Column) -> Column:
    return F.round(F.avg(condition.cast("double")), 6)


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "1 hour") -> DataFrame:
    """Sessions of each user: a gap of more than ``gap`` ends one.

    Each hour of a user is cut by itself, so a user with very many events is spread; the pieces, as many as hours and gaps allow,
    are then joined where no gap lies between them.
    """
    late = F.expr(f"interval {gap}")
    w = Window.partitionBy(user, "__hour").orderBy(ts, "event_id")
    before = F.lag(ts).over(w)
    cut = events.withColumn("__hour", F.date_trunc("hour", ts)).withColumn("__piece", F.sum((before.isNull() | (F.col(ts) > before + late)).cast("int")).over(w))
    pieces = cut.groupBy(user, "__hour", "__piece").agg(F.count("*").alias("__n"), F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    w = Window.partitionBy(user).orderBy("__first", "__piece")
    before = F.lag("__last").over(w)
    numbered = pieces.withColumn("session", F.sum((before.isNull() | (F.col("__first") > before + late)).cast("int")).over(w))
    return numbered.groupBy(user, "session").agg(F.sum("__n").alias("n_events"), F.min("__first").alias("first_ts"), F.max("__last").alias("last_ts"))


def last_of_each(events: DataFrame, key: str, order: list, n: int) -> DataFrame:
    from textloom.operators.search import best_per_key

    return best_per_key(events, key, order, n)


def trailing_count(events: DataFrame, client: str, ts: str, name: str, seconds: int = 60, stretches: int = 60) -> DataFrame:
    """events with how many of the client's events lie in the seconds up to each, the far end left out.

    A client's time is parted into ranges of ``stretches`` times those seconds, so a client with very many events is spread; a
    range counts the last stretch of the range before it too.
    """
    reach = seconds * 1_000_000
    width = reach * stretches
    rows = events.withColumn("__micros", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__range", F.col("__micros") - F.pmod("__micros", F.lit(width)))
    spills = F.col("__micros") > F.col("__range") + width - reach
    shared = rows.withColumn("__later", F.explode(F.when(spills, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    w = Window.partitionBy(client, F.col("__range") + F.col("__later") * width).orderBy("__micros").rangeBetween(-reach + 1, 0)
    return shared.withColumn(name, F.count("*").over(w)).where("__later = 0").select(*events.columns, name)


def daily_delta(df: DataFrame, ts: str, value: Column, name: str) -> DataFrame:
    """A value for each day, and its difference to the day before."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(value.alias(name))
    # as many rows as there are days
    return days.withColumn(f"{name}_delta", F.col(name) - F.lag(name).over(Window.orderBy("day")))


def health(df: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Rows with each signal, the number of issues, and healthy, watch or broken for none, one or more."""
    issues = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in signals.values()), F.lit(0))
    level = F.when(issues == 0, "healthy").when(issues == 1, "watch").otherwise("broken")
    return df.withColumns({**signals, "issues": issues.cast("long"), "level": level})


def attached_to_latest(queries: DataFrame, results: DataFrame, key: str, order: list, fields: list[str]) -> DataFrame:
    """Each key's latest query with the fields of its latest result, null where it has none."""
    from textloom.operators.search import best_per_key

    last = best_per_key(results, key, order).select(key, *fields)
    return best_per_key(queries, key, order).join(last, key, "left")


def retained(df: DataFrame, ts: str, now: str, days: int = 30) -> DataFrame:
    return window_of_days(df, now, days, ts)


def asked(df: DataFrame, group: str, grounded: str, latency: str) -> DataFrame:
    """Answers by group: how many, mean groundedness, mean latency, and the rank-index 95th percentile of latency."""
    sums = df.groupBy(group).agg(F.count("*").alias("n_answers"), F.round(F.avg(grounded), 6).alias("avg_grounded"), F.round(F.avg(latency), 6).alias("avg_latency"))
    return sums.join(rank_percentiles(df, [group], latency, {"p95_latency": 0.95}), group)


RUN_FIELDS = {
    "mode": r"mode=(\w+)",
    "max_files": r"max_files=([0-9]+)",
    "success": r"success[=: ]+([0-9]+)",
    "skipped": r"skip(?:ped)?[=: ]+([0-9]+)",
    "chunks": r"chunks[=: ]+([0-9]+)",
    "exit_code": r"exit(?: code)?[=: ]+(-?[0-9]+)",
}


def parsed_runs(logs: DataFrame, text: str = "text", fields: dict[str, str] = RUN_FIELDS, errors: str = r"ERROR[^\n]*", rss: str = r"RSS[=: ]+([0-9]+)") -> DataFrame:
    """Fields of run logs by pattern (null where absent), the number of errors, and the highest memory sample."""
    found = {k: F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for k, p in fields.items()}
    peak = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(rss), F.lit(1)), lambda x: x.cast("long")))
    return logs.withColumns({**found, "n_errors": F.size(F.regexp_extract_all(text, F.lit(errors), F.lit(0))).cast("long"), "rss_peak": peak})
