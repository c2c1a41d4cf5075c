"""Daily reports as files, read again for their figures, and each day beside the day before.

A report is Markdown for people, with a last line for programs: a comment that lists figures as key=value. Reports lie in a folder a day, so
writing days again replaces those alone, and a range of days reads no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The line that holds a report's figures.
STATS = r"<!-- stats:\s*([^>]+?)\s*-->"


def rendered(title: Column, figures: dict[str, Column]) -> Column:
    """A report: its title, a line for each figure, and the figures' comment. Figures that are null are left out."""
    said = lambda joint: [F.concat(F.lit(k + joint), v.cast("string")) for k, v in figures.items()]
    return F.concat(F.lit("# "), title, F.lit("\n\n- "), F.concat_ws("\n- ", *said(": ")), F.lit("\n\n<!-- stats: "), F.concat_ws(" ", *said("=")), F.lit(" -->"))


def put(reports: DataFrame, folder: str) -> None:
    """Writes reports (day, text), one file a day, in place of those that these days had."""
    rows = reports.where("day is not null").select("day", "text").repartition("day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(day, text) of the reports in a folder."""
    return spark.read.schema("value string, day date").text(folder, wholetext=True).select("day", F.col("value").alias("text"))


def figures(text: Column | str) -> Column:
    """The figures of a report as a map; pieces without a number are left out, of repeated keys the last counts, and a report without figures
    has none (null)."""
    t = F.col(text) if isinstance(text, str) else text
    pairs = F.filter(F.split(F.regexp_extract(t, STATS, 1), r"\s+"), lambda p: p.contains("="))
    cut = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), p.substr(F.instr(p, "=") + 1, F.length(p)).try_cast("double").alias("value")))
    known = F.reverse(F.filter(cut, lambda p: p["value"].isNotNull()))
    keys = F.transform(known, lambda p: p["key"])
    last = F.filter(known, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.when(F.size(last) > 0, F.map_from_entries(last))


def beside_day_before(reports: DataFrame) -> DataFrame:
    """(day, key, value, before, delta) of each figure; before and delta are null where the day before has no report, or not this figure."""
    told = reports.select("day", F.explode(figures("text")).alias("key", "value"))
    before = told.select(F.date_add("day", 1).alias("day"), "key", F.col("value").alias("before"))
    return told.join(before, ["day", "key"], "left").withColumn("delta", F.col("value") - F.col("before"))


def latest_logs(names: DataFrame, kinds: list[str], name: str = "name") -> DataFrame:
    """(day, kind, name): the last log by name of each day and kind, names being kind_yyyymmdd_time.log."""
    pattern = f"^({'|'.join(kinds)})_([0-9]{{8}})_.*[.]log$"
    found = names.select(F.regexp_extract(name, pattern, 1).alias("kind"), F.try_to_timestamp(F.regexp_extract(name, pattern, 2), F.lit("yyyyMMdd")).cast("date").alias("day"), F.col(name).alias("name"))
    return found.where("kind <> '' and day is not null").groupBy("day", "kind").agg(F.max("name").alias("name"))
