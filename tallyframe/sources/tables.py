"""Reading tables and describing their columns; writing frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cells as text; a byte order mark before the first name goes."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.removeprefix("﻿").strip() for c in df.columns))


def read_parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def inline_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows given in the program, every cell text."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], schema)


def list_tables(spark: SparkSession, path: str, suffix: str = ".csv") -> list[str]:
    """Names of a folder's tables, through Spark's file system, so any store does."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(n.removesuffix(suffix) for n in (f.getPath().getName() for f in files) if n.endswith(suffix))


def profile(df: DataFrame, order_by: str) -> DataFrame:
    """``column, sample, cardinality``: first non-blank cell and distinct non-blank cells.

    One pass over all columns: cells become rows, pre-aggregated by column and value.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns))
    rows = df.select(F.col(f"`{order_by}`").alias("__at"), F.explode(cells).alias("c")).select("__at", "c.column", "c.value").where(F.trim("value") != "")
    values = rows.groupBy("column", "value").agg(F.min("__at").alias("at"))
    return values.groupBy("column").agg(F.min_by("value", "at").alias("sample"), F.count("*").alias("cardinality"))


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    if form not in ("parquet", "json", "csv", "orc"):
        raise ValueError(f"form: parquet, json, csv or orc, not '{form}'")
    writer = df.write.option("header", True) if form == "csv" else df.write
    writer.format(form).save(path)


def stream_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, be it one file or a folder of them; what is added later follows."""
    schema = read_parquet(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parque[t]")  # a pattern: a plain path must be a folder
