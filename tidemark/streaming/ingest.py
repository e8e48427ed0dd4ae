"""An extension: incremental ingest as a stream of memo files, and event rates with late data.

The stream reads new Parquet or JSON files of memos; each micro-batch keeps only those whose fingerprint is new,
cuts them into chunks and appends them to the generation folder. Replayed batches write the same chunk ids again,
so readers keep one row for each (``current_chunks``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.chunking import chunk

MEMO = "file string, text string, indexed_at timestamp"


def stream_memos(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(MEMO).json(folder)


def ingest(memos: DataFrame, out: str, checkpoint: str):
    """Start the query; returns it. Available files are read, then it ends (``availableNow``)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("fingerprint", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["file", "fingerprint"])
        pieces = chunk(keyed, "file").join(keyed.select("file", "fingerprint", "indexed_at"), "file")
        pieces.write.mode("append").parquet(out)

    return memos.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks of each file's newest version, each once."""
    newest = chunks.groupBy("file").agg(F.max_by("fingerprint", F.struct("indexed_at", "fingerprint")).alias("fingerprint"))
    return chunks.join(newest, ["file", "fingerprint"]).dropDuplicates(["file", "chunk_id"])


def event_rates(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events in tumbling windows; events later than ``late`` are let go, as watermarks do."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
