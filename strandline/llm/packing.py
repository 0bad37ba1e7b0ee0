"""Problem 7: filling containers of a fixed capacity, shortest pack first over the histogram of lengths.

Sizes in tokens are counted once per document; a document larger than a container is cut into full pieces and a rest,
no other is. Only the histogram (container, length, count) reaches the driver: at most one row per length up to the
capacity, whatever the number of documents. There the lengths are placed longest first, each into the pack with the most
room (the shortest pack) of those it fits, all packs of one pattern at a time; else new packs are opened. The best of a few
numbers of packs to begin with is kept (from the number that the total size needs). The patterns say for each length which ranks go to which packs, and each piece looks up its own rank in them.

Ranks within a length are made without one task per length: rows are numbered per (container, length, salt) and moved by
the counts of the smaller salts.

Defined cases: null and empty texts have no tokens and no container; a null or non-positive capacity is no container;
documents of equal size are told apart by doc_id (repeated rows too: each row is placed); an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which the rows of one length are numbered.
SALTS = 256


def pieces(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, doc_id, piece, size): sized has (doc_id, tokens), containers are few and broadcast by Spark's own check."""
    c = containers.where("capacity_tokens > 0").select("container_id", "capacity_tokens").dropDuplicates(["container_id"])
    d = sized.where("tokens > 0")
    # each document goes into every kind of container, so the kinds are unrolled within the row
    kinds = [(r[0], r[1]) for r in c.orderBy("container_id").collect()]  # one row per kind of container
    if not kinds:
        return d.limit(0).selectExpr("cast(0 as bigint) container_id", "doc_id", "0 piece", "cast(0 as bigint) size")
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("container_id"), F.lit(cap).cast("bigint").alias("cap")) for i, cap in kinds)))
    d = d.select("doc_id", "tokens", each.alias("c")).select("doc_id", "tokens", "c.*")
    d = d.withColumn("piece", F.explode(F.expr("sequence(0, cast((tokens - 1) div cap as int))")))
    return d.select("container_id", "doc_id", "piece", F.least(F.col("cap"), F.col("tokens") - F.col("piece") * F.col("cap")).cast("bigint").alias("size"))


def fewest_packs(histogram: dict[int, int], capacity: int, tries: int = 9) -> list[tuple[int, tuple[int, ...]]]:
    """The best patterns of a few starts: from no pack, and from about as many empty packs as the total size needs.

    With the packs open from the start, the shortest pack first keeps them level, so that little room is left in any.
    """
    least = max(-(-sum(k * n for k, n in histogram.items()) // capacity), sum(n for k, n in histogram.items() if 2 * k > capacity))
    starts = [0, *(least + j * max(1, least // 400) for j in range(tries - 1))]
    return min((shortest_pack_first(histogram, capacity, s) for s in starts), key=lambda found: sum(n for n, _ in found))


def shortest_pack_first(histogram: dict[int, int], capacity: int, start: int = 0) -> list[tuple[int, tuple[int, ...]]]:
    """(packs, lengths in a pack): the patterns for a histogram {length: count}, with start packs open from the first."""
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    heap: list[int] = []

    def put(free: int, count: int, pattern: tuple[int, ...]) -> None:
        if free not in room:
            room[free] = []
            heapq.heappush(heap, -free)
        room[free].append((count, pattern))

    if start:
        put(capacity, start, ())
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and -heap[0] >= length:
            free = -heap[0]
            count, pattern = room[free].pop()
            if not room[free]:
                del room[free]
                heapq.heappop(heap)
            used = min(count, left)
            if count > used:
                put(free, count - used, pattern)
            put(free - length, used, (*pattern, length))
            left -= used
        if left:
            put(capacity - length, left, (length,))
    return [(n, p) for f in sorted(room) for n, p in room[f] if p]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, first pack, places per pack) in order of rank."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    pack = 0
    for count, pattern in patterns:
        for length in dict.fromkeys(pattern):
            k = pattern.count(length)
            out.setdefault(length, []).append((ranks.get(length, 0), pack, k))
            ranks[length] = ranks.get(length, 0) + k * count
        pack += count
    return {n: np.array(v, dtype=np.int64) for n, v in out.items()}


def ranked(rows: DataFrame, group: list[str], order: list[str], salts: int = SALTS) -> DataFrame:
    """Adds rank, counting from 0 within the group in an order of its own; no group is gathered in one task."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*group, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy(*group, "salt").orderBy(*order))
    return salted.withColumn("own", own).join(offsets, [*group, "salt"]).withColumn("rank", F.col("own") - 1 + F.col("offset")).drop("salt", "own", "offset")


def packed(sized: DataFrame, containers: DataFrame, salts: int = SALTS) -> DataFrame:
    """(container_id, doc_id, piece, size, pack): pack counts the containers of a kind from 0."""
    spark = sized.sparkSession
    all_pieces = pieces(sized, containers)
    caps = {r[0]: r[1] for r in containers.where("capacity_tokens > 0").select("container_id", "capacity_tokens").collect()}
    histogram: dict[int, dict[int, int]] = {}
    for c, size, n in all_pieces.groupBy("container_id", "size").count().collect():  # at most one row per length
        histogram.setdefault(c, {})[size] = n
    plan = spark.sparkContext.broadcast({c: slots(fewest_packs(h, caps[c])) for c, h in histogram.items()})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            pack = np.zeros(len(p), np.int64)
            for (c, size), at in p.groupby(["container_id", "size"]).indices.items():
                s = plan.value[c][size]
                rank = p["rank"].to_numpy()[at]
                i = np.searchsorted(s[:, 0], rank, side="right") - 1
                pack[at] = s[i, 1] + (rank - s[i, 0]) // s[i, 2]
            yield p.drop(columns="rank").assign(pack=pack)

    return ranked(all_pieces, ["container_id", "size"], ["doc_id", "piece"], salts).select("container_id", "doc_id", "piece", "size", "rank").mapInPandas(run, "container_id bigint, doc_id bigint, piece int, size bigint, pack bigint")


def unused(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, container_kind, capacity_tokens, containers, tokens, unused, unused_share)."""
    used = placed.groupBy("container_id").agg(F.sum("size").alias("tokens"), (F.max("pack") + 1).alias("containers"))
    space = F.col("containers") * F.col("capacity_tokens")
    return containers.dropDuplicates(["container_id"]).join(used, "container_id").select("container_id", "container_kind", "capacity_tokens", "containers", "tokens", (space - F.col("tokens")).alias("unused"), ((space - F.col("tokens")) / space).alias("unused_share"))
