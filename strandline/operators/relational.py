"""Pages, queues, counts and look-ups over the platform's tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_MIN, PAGE_MAX, PAGE_DEFAULT = 1, 100, 20
# Words by which a statement writes.
WRITES = re.compile(r"\b(?:insert|update|delete|merge|create|drop|alter|truncate|replace|load|cache|uncache|set|reset|refresh|grant|revoke|call|overwrite)\b", re.I)


def keyset_page(rows: DataFrame, size: int | None = None, after: tuple | None = None, by: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """One page in descending order of ``by`` after a cursor of the same columns, and one row more that tells of a next page.

    The size is clamped to 1..100. The comparison is one of structs, so it's pushed to the scan per column where possible,
    and the order with its limit is a bounded top-k per task.
    """
    n = max(PAGE_MIN, min(PAGE_MAX, size if size is not None else PAGE_DEFAULT))
    if after is not None:
        rows = rows.where(F.struct(*by) < F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(by, after))))
    return rows.orderBy(*(F.col(c).desc() for c in by)).limit(n + 1)


def cascading_page(rows: DataFrame, page: int, size: int, first: str | None = None, descending: bool = False, cascade: Sequence[tuple[str, bool]] = (("collect_status", False), ("used_by", True), ("name", False))) -> DataFrame:
    """An offset page sorted by one column, then by the rest of the cascade; unknown columns sort by name. Nulls go last
    in descending and first in ascending order."""
    known = dict(cascade)
    order = [(first, descending)] if first in known else [("name", False)]
    order += [(c, d) for c, d in cascade if c != order[0][0]]
    keys = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in order]
    return rows.orderBy(*keys).offset(page * size).limit(size)


def with_counts(rows: DataFrame, other: DataFrame, key: str, foreign: str, name: str) -> DataFrame:
    """rows with the number of rows of other that refer to them, 0 if none; other is counted before the join."""
    counts = other.groupBy(F.col(foreign).alias(key)).agg(F.count("*").alias(name))
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint"))


def waiting(rows: DataFrame, done: DataFrame | None, needed: DataFrame | None, done_on: tuple[str, str] | None = None, needed_on: tuple[str, str] | None = None) -> DataFrame:
    """A work queue: rows without a row in done and with one in needed; (own column, other's column) name the keys."""
    if needed is not None and needed_on is not None:
        rows = rows.join(needed.select(F.col(needed_on[1]).alias(needed_on[0])).distinct(), needed_on[0], "left_semi")
    if done is not None and done_on is not None:
        rows = rows.join(done.select(F.col(done_on[1]).alias(done_on[0])).distinct(), done_on[0], "left_anti")
    return rows


def reached_counts(status: str, order: Sequence[str]) -> list[Column]:
    """Counts per stage of an ordered status that include all later stages; other states and nulls count in none."""
    return [F.count_if(F.col(status).isin(list(order[i:]))).alias(s) for i, s in enumerate(order)]


def newest_per_key(rows: DataFrame, key: Sequence[str], by: str, keep: int, tie: str) -> DataFrame:
    """The ``keep`` newest rows of each key; Spark cuts each group to that rank before it shuffles it."""
    w = Window.partitionBy(*key).orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def evicted_by_pressure(rows: DataFrame, used: int, capacity: int, high: float = 0.8, low: float = 0.7, by: str = "last_accessed_at", size: str = "size_bytes", bucket: str = "month") -> DataFrame:
    """The least recently used rows to drop when used exceeds high * capacity until low * capacity is left.

    The running size is that of the earlier buckets of time plus that within the bucket, so no single task sorts all rows.
    """
    if used <= high * capacity:
        return rows.limit(0)
    over = used - low * capacity
    r = rows.withColumn("bucket", F.date_trunc(bucket, by))
    sums = r.groupBy("bucket").agg(F.sum(size).alias("s"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    sums = sums.select("bucket", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("start"))
    own = Window.partitionBy("bucket").orderBy(F.col(by).asc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum(size).over(own), F.lit(0))
    return r.join(F.broadcast(sums), "bucket").withColumn("before", before).where(F.col("before") < over).drop("bucket", "start", "before")


def until_sentinel(rows: DataFrame, key: Sequence[str], ordinal: str, is_sentinel: Column) -> DataFrame:
    """Of each key the rows before its first sentinel in order of the ordinal; all rows where there is none."""
    stop = rows.where(is_sentinel).groupBy(*key).agg(F.min(ordinal).alias("stop"))
    return rows.join(stop, list(key), "left").where(F.col("stop").isNull() | (F.col(ordinal) < F.col("stop"))).drop("stop")


def in_chunks(rows: DataFrame, key: Sequence[str], by: Sequence[str], size: int = 10_000) -> DataFrame:
    """Adds chunk: the rows of a key spread by the hash of ``by`` over groups of about ``size`` rows, so that no group grows
    with its key."""
    counts = rows.groupBy(*key).agg(F.ceil(F.count("*") / size).alias("chunks"))
    return rows.join(counts, list(key)).withColumn("chunk", F.pmod(F.xxhash64(*by), F.col("chunks")).cast("int")).drop("chunks")


def page_meta(rows: DataFrame, page: int, size: int) -> DataFrame:
    """(total, total_pages, has_more) of an offset page, counted from 0."""
    pages = F.ceil(F.count("*") / F.lit(size)).cast("bigint")
    return rows.agg(F.count("*").alias("total"), pages.alias("total_pages")).withColumn("has_more", F.lit(page) < F.col("total_pages") - 1)


def looked_back(rows: DataFrame, key: Sequence[str], at: str, tie: str, days: int, most: int) -> DataFrame:
    """The rows of each key within the days before its newest one, at most the ``most`` newest: a first look at a long past."""
    newest = rows.groupBy(*key).agg(F.max(at).alias("newest"))
    near = rows.join(newest, list(key)).where(F.col(at) >= F.col("newest") - F.expr(f"interval {days} days")).drop("newest")
    order = Window.partitionBy(*key).orderBy(F.col(at).desc(), F.col(tie).desc())
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def read_only(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """The answer to a question in SQL over named DataFrames; one with a word that writes is refused, in any case and place."""
    if found := WRITES.search(sql):
        raise ValueError(f"only questions are allowed, not {found.group().upper()}")
    return spark.sql(sql, args, **tables) if args else spark.sql(sql, **tables)
