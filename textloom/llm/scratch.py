"""Tables written between stages, in the folder that the cluster's nodes share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.shared import new_folder, shared_root

__all__ = ["free_name", "new_folder", "numbered", "shared_root", "written"]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it (Spark's names don't differ by case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df with its rows numbered, written, and the name of the numbers' column, which no column of df has. Spark splits files by the
    cores it has when it plans a scan, so the numbers of two scans need not agree; nothing joins them to another scan."""
    row = free_name(df, "__row")
    return written(df.withColumn(row, F.monotonically_increasing_id()), name), row
