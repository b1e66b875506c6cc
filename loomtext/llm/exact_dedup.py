"""Exact deduplication by a stream with disk-backed keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, spread_join

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def _children(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(s.getPath()) for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _written(spark: SparkSession, path: str) -> bool:
    return any(p.endswith("/_SUCCESS") for p in _children(spark, path))


class State:
    """Keyed state in a folder that all executors share, for one stream of documents that comes in named batches.

    The state is a streaming aggregate in RocksDB without a watermark and so without expiry. A digest keeps the identifier of the row that
    stays, the number of rows, and the locator (batch and row) of the content that it was first met with. A batch is taken once,
    whatever the number of calls: one that failed or was stopped goes on from the stream's checkpoint. Map-side partial aggregation sends one
    row a digest and task, so a hot group is no hot task. `contents`: also keep the texts, so that later batches can be compared with them
    by locator."""

    def __init__(self, spark: SparkSession, path: str, contents: bool = True):
        self.spark, self.path, self.contents = spark, path.rstrip("/"), contents

    def add(self, name: str, docs: DataFrame) -> DataFrame:
        """Takes a batch (doc_id, digest, text, row) into the stream's source; returns its narrow rows."""
        source = f"{self.path}/in/{name}"
        if not _written(self.spark, source):
            narrow = docs.select("doc_id", "digest", F.octet_length("text").alias("bytes"), F.struct(F.lit(name).alias("batch"), "row").alias("locator"))
            if self.contents:
                docs.select("row", "text", "digest", "doc_id").write.mode("overwrite").parquet(f"{self.path}/content/{name}")
            narrow.write.mode("overwrite").parquet(source)
        rows = self.spark.read.parquet(source)
        self.schema = rows.schema
        return rows

    def run(self) -> None:
        """Streams what is new in the source into the state."""
        own = {
            "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            # Else every partition of the state reserves some MB of disk before it holds a row.
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        }
        conf, out = self.spark.conf, f"{self.path}/updates"
        before = {n: conf.get(n, None) for n in own}
        try:
            for n, v in own.items():
                conf.set(n, v)
            stays = F.max(F.struct("doc_id", "locator")).alias("keeper")
            rows = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in/*")
            state = rows.groupBy("digest").agg(stays, F.min("locator").alias("first"), F.count("*").alias("group_size"))
            query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{self.path}/checkpoint").foreachBatch(
                lambda batch, number: batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{out}/number-{number}")
            ).start()
            query.awaitTermination()
        finally:
            for n, v in before.items():
                conf.unset(n) if v is None else conf.set(n, v)

    def table(self) -> DataFrame:
        """digest, keeper, first, group_size: what the state holds now. A later update of a digest replaces the earlier ones."""
        updates = _children(self.spark, f"{self.path}/updates")
        rows = self.spark.read.parquet(*updates)
        if len(updates) > 1:
            rows = rows.groupBy("digest").agg(F.max_by(F.struct("keeper", "first", "group_size"), "number").alias("s")).select("digest", "s.*")
        return rows.select("digest", "keeper", "first", "group_size")

    def content(self, name: str) -> DataFrame | None:
        """locator, text, digest, doc_id of all batches but `name`."""
        names = [p.rsplit("/", 1)[1] for p in _children(self.spark, f"{self.path}/in")]
        out = None
        for other in names:
            if other != name and _children(self.spark, f"{self.path}/content/{other}"):
                own = self.spark.read.parquet(f"{self.path}/content/{other}").select(F.struct(F.lit(other).alias("batch"), "row").alias("locator"), "text", "digest", "doc_id")
                out = own if out is None else out.union(own)
        return out


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", state: str | None = None, batch: str = "batch", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator: one row for each row of `docs`.

    Null texts count as empty; nothing is normalised; very long texts are taken whole. The row with the largest key stays (nulls are
    smallest; of rows with the same key and text one, the last read). Keys may be of any ordered type. With a folder as `state`, documents
    are a further batch of what it has seen: group_size counts all batches, keep_id is the largest key so far, and a row is kept if it is
    that one. A batch has a name and is taken once; without `state`, a new state is made for this call.

    A digest met twice is a hit, and on hits the full bytes are compared: the rows of those digests are grouped by digest and whole text,
    with map-side partial aggregation, so that copies travel once a task, and with the content that the locator of an earlier batch leads
    to. Should two texts share a digest, their groups are split by that comparison. An empty table gives no rows."""
    spark = docs.sparkSession
    body = F.coalesce(docs[text], F.lit(""))
    full = docs.select(docs[key].alias("doc_id"), body.alias("text"), digest(body.cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    kept = State(spark, state or shared_dir(spark, "dedup-state"), contents=state is not None)
    rows = kept.add(batch, full)
    columns = ["doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"), "locator"]
    if rows.isEmpty():
        return rows.withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(0).cast("long")).withColumn("kept", F.lit(False)).select(*columns)
    kept.run()
    table = kept.table()
    hits = table.where("group_size > 1")
    met = spread_join(full, hits, "digest", "group_size", F.col("row")).where("own IS NOT NULL")
    whole = met.groupBy("digest", "text").agg(F.count("*").alias("n")).select("digest", "text")
    earlier = kept.content(batch)
    if earlier is not None:
        there = earlier.join(hits.where(F.col("first.batch") != batch).select(F.col("first").alias("locator")), "locator", "left_semi")
        whole = whole.union(there.select("digest", "text")).distinct()
    clashes = materialise(whole.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1"), "clashes")
    out = spread_join(rows, table, "digest", "group_size", F.col("locator.row"))
    out = out.select("doc_id", F.col("own.keeper.doc_id").alias("keep_id"), "own.group_size", F.col("own.keeper.locator").eqNullSafe(F.col("locator")).alias("kept"), "digest", "locator")
    if clashes.isEmpty():
        return out.select(*columns)
    own = full.select(F.struct(F.lit(batch).alias("batch"), "row").alias("locator"), "text", "digest", "doc_id")
    every = (own if earlier is None else own.union(earlier)).join(clashes, "digest", "left_semi")
    truth = every.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))
    apart = own.join(clashes, "digest", "left_semi").join(truth, ["digest", "text"])
    apart = apart.select("doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size", F.col("keeper.locator").eqNullSafe(F.col("locator")).alias("kept"), "digest", "locator")
    return out.join(clashes, "digest", "left_anti").unionByName(apart).select(*columns)


def unique(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, unchanged, that stay: one for each text. Of rows that share key and text any one stays."""
    out = groups(docs, key=key, text=text, **options)
    kept = out.where("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("sha"))
    digest = options.get("digest", sha256)
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs[key].alias("key"), digest(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("own"))
    rows = packed.join(kept, (F.col("own") == F.col("sha")) & F.col("key").eqNullSafe(F.col("keep")), "left_semi")
    if not out.where("NOT kept AND doc_id <=> keep_id").isEmpty():  # only then is there more than one row of a kept key and text
        number = F.row_number().over(Window.partitionBy("own", "key").orderBy(F.lit(0)))
        rows = rows.withColumn("number", number).where("number = 1")
    return rows.select("doc.*")


def oracle() -> str:
    return """
SELECT d.doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents d WINDOW w AS (PARTITION BY coalesce(text, ''))"""
