"""Reading tables: the engine's own Parquet tables, and files, logs and reports as tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X

QUERY_LOG = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("tool", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("n_requested", T.LongType()),
        T.StructField("n_returned", T.LongType()),
        T.StructField("top_files", T.ArrayType(T.StringType())),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_files(spark: SparkSession, roots: list[str], extensions: list[str], recursive: bool = True, least: int = 50, most: int | None = None) -> DataFrame:
    """Files under roots: path, name, ext, length, modificationTime, content. Excluded paths, other extensions and sizes out
    of bounds are dropped before any content is read; roots may overlap."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(roots).where(F.col("length") >= least)
    if most is not None:
        files = files.where(F.col("length") <= most)
    ext = X.extension("path")
    files = files.where(ext.isin(extensions) & ~X.is_excluded_path("path") & ~X.is_low_value_file("path"))
    return files.select("path", X.basename("path").alias("name"), ext.alias("ext"), "length", "modificationTime", "content").dropDuplicates(["path"])


def _not_utf8(contents: pd.Series) -> pd.Series:
    def read(x: bytes | None) -> str | None:
        if x is None:
            return None
        try:
            return bytes(x).decode("gbk")
        except UnicodeDecodeError:
            return bytes(x).decode("latin-1")

    return contents.map(read)


def decoded(files: DataFrame) -> DataFrame:
    """files with text: UTF-8 where the bytes are, else as GBK, else byte by byte."""
    is_utf8 = F.expr("is_valid_utf8(content)")
    # Python gets only what is not UTF-8
    other = F.pandas_udf(_not_utf8, "string")(F.when(~is_utf8, F.col("content")))
    return files.withColumn("text", F.when(is_utf8, F.decode("content", "UTF-8")).otherwise(other)).withColumn("is_text", F.locate("\x00", F.decode(F.substring("content", 1, 1024), "ISO-8859-1")) == 0)


def query_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as rows; blank and malformed lines are dropped, times without a zone are taken as they are."""
    log = spark.read.schema(QUERY_LOG).option("mode", "DROPMALFORMED").json(path)
    return log.withColumn("at", F.expr("try_to_timestamp(ts)")).where("at is not null")


def json_vectors(spark: SparkSession, path: str, field: str = "vectors") -> DataFrame:
    """A JSON document with a list of rows in one field."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode(field).alias("x")).select("x.*")


def delimited(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", str(header).lower()).csv(path)
