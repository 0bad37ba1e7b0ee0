"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.session import share_library


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
