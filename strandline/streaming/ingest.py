"""Micro-batches: events arrive as files and each is taken up once, by the same functions as in a batch job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.merge import insert_ignore
from strandline.stored import StoredBatches


def run_available(spark: SparkSession, schema, source: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None], files_per_batch: int = 1) -> None:
    """Hands all files that the checkpoint hasn't seen to on_batch, in micro-batches, and returns."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def insert_ignore_into(spark: SparkSession, target: str, key: Sequence[str], ordinal: str, buckets: int = 8) -> Callable[[DataFrame, int], None]:
    """A batch function that appends the first row of each new key to ``target/rows``, in buckets of the key.

    A micro-batch is met with the buckets that its own keys fall in, not with all that was ever accepted. A batch that is run
    again after a failure overwrites its own rows and doesn't count itself as known; a complete one changes nothing.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        table = StoredBatches(spark, target, buckets)
        table.SCHEMAS = {"rows": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema)}
        before = table.new_batch(batch_id)
        if before is None:
            return
        hashed = lambda df: df.withColumn("key_hash", F.xxhash64(*key))
        old = table.read("rows", before, table.touched(hashed(batch), "key_hash") if before else None)
        table.write("rows", batch_id, hashed(insert_ignore(old, batch, key, ordinal)), "key_hash")
        table.finish(batch_id)

    return on_batch


def watermarked_counts(spark: SparkSession, schema, source: str, event_time: str, key: str, lateness: str = "4 days") -> DataFrame:
    """A streaming DataFrame of counts per key and day of event time; later rows than the watermark allows are left out."""
    rows = spark.readStream.schema(schema).parquet(source).withWatermark(event_time, lateness)
    return rows.groupBy(key, F.window(event_time, "1 day").alias("day")).count()
