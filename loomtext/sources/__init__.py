"""Texts in and out: the engine's inputs are text columns of any Spark source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(df: DataFrame) -> DataFrame:
    """Narrow rows over more tasks than run at once: short texts make small files of few splits, whatever work each row is."""
    return df.repartition(max(24, 2 * df.sparkSession.sparkContext.defaultParallelism))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (text) of text files; files are split where they allow it, so a line has no number over a whole file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, text of small text files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def write(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Matches to parquet, partitioned by columns of few values."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
