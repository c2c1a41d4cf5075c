"""Running sums, means and places within a key, however many rows the key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, key: str, order: list[str], stretch: Column, sums: dict[str, Column]) -> DataFrame:
    """rows with the running sum of each of ``sums``, up to and with the row, in its key's order.

    ``stretch`` parts a key's rows into ranges and must rise with ``order``: an hour of the time, or a thousand row numbers. The sums
    of all stretches, as few rows as there are stretches, are added up first; a stretch then starts from what lies before it, as one row
    ahead of its own. So a task sorts one stretch, never a key, and rows are shuffled once. Null keys are a key of their own, rows with
    a null order come first, null values add nothing.
    """
    parts = {f"__add{i}": c for i, c in enumerate(sums.values())}
    cut = rows.withColumns({"__stretch": stretch, **parts})
    whole = cut.groupBy(key, "__stretch").agg(*[F.sum(p).alias(p) for p in parts])
    ahead = Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(key, "__stretch", *[F.sum(p).over(ahead).alias(p) for p in parts], F.lit(0).alias("__own"))
    both = cut.withColumn("__own", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    upto = Window.partitionBy(key, "__stretch").orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumns({name: F.sum(p).over(upto) for name, p in zip(sums, parts)})
    return told.where("__own = 1").select(*[c for c in rows.columns if c not in sums], *sums)


def running_mean(rows: DataFrame, value: str, key: str, order: list[str], stretch: Column, name: str = "mean") -> DataFrame:
    """rows with the mean of the key's values up to each, null before the first."""
    known = F.col(value).isNotNull().cast("long")
    told = running_sums(rows, key, order, stretch, {"__sum": F.col(value).cast("double"), "__known": known})
    return told.withColumn(name, F.when(F.col("__known") > 0, F.col("__sum") / F.col("__known"))).select(*[c for c in rows.columns if c != name], name)
