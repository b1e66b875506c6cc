"""A bounded run of the chunk scan: a table of chunks is streamed to its end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import scan_chunks


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; one of this machine only where there is no cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomtext-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`work` over a table that is streamed to its end from the shared folder, and the rows that it appends."""
    at = shared_dir(spark, "stream")
    rows.write.parquet(f"{at}/in")
    out = work(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
    query = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def scan_table(spark: SparkSession, chunks: DataFrame, pattern: str) -> DataFrame:
    """stream_id, value, n: matches of a pattern over each stream's joined chunks. Files go to the shared folder of the session."""
    return stream_table(spark, chunks, lambda s: scan_chunks(s, pattern)).groupBy("stream_id", "value").agg(F.count("*").alias("n"))
