"""Streaming ingest: windows over events, and idempotent upserts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their values by tumbling window and type, of a table or a stream; rows later
    than ``late`` behind the newest are dropped by the watermark of a stream. Null times fall
    in no window."""
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.where("ts is not null").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def upsert_documents(spark: SparkSession, batch: DataFrame, target: str, batch_id: int, key: str = "document_id") -> None:
    """One micro-batch into its own folder of ``target``: writing the same batch again
    overwrites it, so a replay changes nothing. Rows carry the digest of their content."""
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(batch.columns) if c != key])), 256)
    batch.dropDuplicates([key]).withColumn("revision", content).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def current(spark: SparkSession, target: str, key: str = "document_id") -> DataFrame:
    """The latest row of every key in a target of upserts."""
    rows = spark.read.parquet(target)
    latest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(latest, [key, "batch"])


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "document_id"):
    """A file stream of documents into ``target``, all files there are."""
    stream = spark.readStream.schema(schema).parquet(source)
    write = stream.writeStream.foreachBatch(lambda b, n: upsert_documents(spark, b, target, n, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return write.start()
