"""Incremental indexing with Structured Streaming.

Files or rows arrive as a stream; each micro-batch is hashed against the registry, changed
documents are chunked anew, and a snapshot of chunks and registry is promoted together.
Checkpoints take the place of leases: a batch that was interrupted runs again, and equal
hashes make the second run a no-op.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, store
from ..sources import loaders


def apply_batch(snapshots: store.Snapshots, batch: DataFrame, options: chunking.Options = chunking.Options()) -> dict[str, int]:
    """Bring one batch (document_name, content) into the tables; the counts by action."""
    batch = batch.filter("document_name IS NOT NULL").groupBy("document_name").agg(F.max("content").alias("content"))
    chunks, registry = snapshots.read("embeddings"), snapshots.read("documents")
    counts = {r["action"]: r["count"] for r in store.sync_actions(registry, batch).groupBy("action").count().collect() if r["action"] != "missing"}
    if not (counts.get("added") or counts.get("updated")):
        return counts
    new_chunks, new_registry = store.sync(chunks, registry, batch, lambda d: loaders.load_texts(d, "document_name", "content", options))
    snapshots.stage("embeddings", new_chunks)
    snapshots.stage("documents", new_registry)
    snapshots.promote("embeddings")
    snapshots.promote("documents")
    return counts


def index_stream(stream: DataFrame, snapshots: store.Snapshots, checkpoint: str, options: chunking.Options = chunking.Options(), on_batch: Callable[[int, dict[str, int]], None] | None = None, every: str | None = None) -> StreamingQuery:
    """Index a stream (document_name, content); once over what is there, or ``every`` interval as a refresher."""

    def run(batch: DataFrame, number: int) -> None:
        counts = apply_batch(snapshots, batch, options)
        if on_batch:
            on_batch(number, counts)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (document_name, content), a document a file."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return raw.select(F.col("path").alias("document_name"), F.decode("content", "UTF-8").alias("content"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) of a stream (ts, event_type, value) in tumbling event-time windows.

    An extension: events later than the watermark are dropped.
    """
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
