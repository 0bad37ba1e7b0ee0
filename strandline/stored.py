"""Tables in a shared folder that grow batch by batch and are read by the buckets of what is looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import exists


class StoredBatches:
    """Tables ``folder/name/batch=i/bucket=b`` of the schemas in SCHEMAS.

    ``done`` names the batches that are complete and is written last: what a batch that broke off has left is not read and
    is overwritten when it runs again. The number of buckets is that of the folder's first batch.
    """

    SCHEMAS: dict[str, str] = {}

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        if held := self._done():
            self.buckets = held[0]["buckets"]  # those it was written with

    def _done(self) -> list:
        """A row per complete batch."""
        if not exists(self.spark, f"{self.folder}/done"):
            return []
        return self.spark.read.parquet(f"{self.folder}/done").collect()

    def batches(self) -> list[int]:
        return sorted(r["batch"] for r in self._done())

    def new_batch(self, batch_id: int) -> list[int] | None:
        """The batches before a new one; None where it is complete already."""
        before = self.batches()
        if batch_id in before:
            return None
        if before and batch_id < before[-1]:
            raise ValueError(f"batch {batch_id} comes after {before[-1]}")
        return before

    def _columns(self, name: str) -> list[str]:
        return [c.split()[0] for c in self.SCHEMAS[name].split(", ")]

    def read(self, name: str, batches: list[int], buckets: list[int] | None = None, with_batch: bool = False) -> DataFrame:
        """The rows of some batches, of some buckets or all."""
        schema, cols = self.SCHEMAS[name], self._columns(name) + ["batch"] * with_batch
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch int").select(*cols)
        rows = self.spark.read.schema(f"{schema}, batch int, bucket int").parquet(f"{self.folder}/{name}").where(F.col("batch").isin(batches))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(*cols)

    def write(self, name: str, batch_id: int, rows: DataFrame, by: str) -> None:
        """A batch's rows in buckets of ``by``; large buckets are several files, small ones share a task."""
        to = rows.select(*self._columns(name), self.bucket(by).alias("bucket"))
        to.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}")

    def bucket(self, by: str) -> Column:
        return F.pmod(F.xxhash64(by), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, by: str) -> list[int]:
        """The buckets of the rows' keys, at most as many as there are."""
        return sorted(r[0] for r in rows.where(F.col(by).isNotNull()).select(self.bucket(by)).distinct().collect())

    def finish(self, batch_id: int) -> None:
        self.spark.createDataFrame([(batch_id, self.buckets)], "batch int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/done/part={batch_id}")
