"""New assertions as a stream: watermark, one row per assertion, merged into an edge table batch by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.operators.reconcile import increment_triples, upsert

SCHEMA = "assertion_id string, subject string, predicate string, object string, pmid string, polarity string, confidence double, status string, seen_at timestamp"
EDGE = "subject string, predicate string, object string, pmids array<string>, support_count bigint, confidence double, polarity string"


def merge_batch(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """The edge table after one batch, in its own columns: known triples gain the evidence, new ones are added."""
    merged = upsert(edges, increment_triples(batch))
    return merged.select("subject", "predicate", "object", "pmids", F.col("support").alias("support_count"), "confidence", "polarity")


def _versions(spark: SparkSession, table: str) -> list[int]:
    """The versions under a folder of any file system that Spark knows; none if it isn't there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [(f.getPath().getName(), fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) for f in fs.listStatus(path)]
    return sorted(int(n.removeprefix("batch=")) for n, whole in names if n.startswith("batch=") and whole)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("subject", "predicate", "object"), F.lit(buckets)).cast("int")


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The edge table after the last batch (before batch ``before``): of each bucket its latest version, in one scan."""
    done = [v for v in _versions(spark, table) if before is None or v < before]
    if not done:
        return spark.createDataFrame([], f"{EDGE}, bucket int")
    rows = spark.read.schema(f"{EDGE}, batch bigint, bucket int").parquet(table).where(F.col("batch").isin(done))
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["bucket", "batch"], "left_semi").drop("batch")  # one row per bucket


def intake(spark: SparkSession, source: str, table: str, checkpoint: str, lateness: str = "7 days", buckets: int = 64) -> StreamingQuery:
    """Read JSON files as they arrive, drop repeated assertion ids within the watermark, and merge each micro-batch.

    The edge table is kept in ``buckets`` by triple. A batch rewrites the buckets that it touches, under a folder with its
    number; the others stay as the batch that wrote them left them. A batch that is replayed after a failure overwrites its own folder,
    so that the result is the same as with one delivery. Reads all files that are there, then stops.
    """
    stream = spark.readStream.schema(SCHEMA).json(source).withWatermark("seen_at", lateness).dropDuplicatesWithinWatermark(["assertion_id"])

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        new = batch.withColumn("bucket", _bucket(buckets))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        old = current(s, table, number).where(F.col("bucket").isin(touched))
        merged = merge_batch(old.drop("bucket"), new.drop("bucket")).withColumn("bucket", _bucket(buckets))
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
