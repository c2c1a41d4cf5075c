"""Upserts and deletes as plans, backups and exports; ``snapshot`` has the tables that keep versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return old.join(gone.select(*key).distinct(), key, "left_anti")


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Backups and reports: JSON lines, CSV with a header, or Parquet."""
    writer = df.write.mode("overwrite")
    {"json": writer.json, "parquet": writer.parquet, "csv": writer.option("header", "true").csv}[kind](path)


def newest(names: DataFrame, name: str = "name", keep: int = 5) -> DataFrame:
    """The newest ``keep`` backups by name."""
    return names.orderBy(F.col(name).desc()).limit(keep)
