"""Problem 4: counts by event time that late arrivals correct until a cut-off.

Events are first counted per (key, UTC day of the event time, UTC day of arrival): additive cells, so one key with a
third of all rows costs no more than any other, and a key has at most cutoff_days + 2 cells a day. :class:`Ledger` keeps
the ordered state of each key in a shared folder: its days with their counts, and a snapshot of the running total before
each block of ``every_days`` days. A batch restores, of its own keys only, the last snapshot at or before their first
touched day, applies its cells in order of arrival, replays the sorted suffix of days from there and writes these days and
snapshots anew; they replace the outputs of earlier batches. A cell that arrives after its day's cut-off is refused by the
replay and its day is closed from that arrival on; the events in it come out by ``too_late``.

Defined cases: events without an event time or without an arrival have no cell; an arrival before the event (clocks)
counts as on the event's day; repeated rows of an event count once, at the earliest arrival; a null key is a key of
its own; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import checkpointed, discard, scratch_path
from strandline.stored import StoredBatches

#: Whole days after the end of an event's day in which it may still arrive (72 hours).
CUTOFF_DAYS = 3
#: Days of a block, before each of which a key's state has a snapshot.
EVERY_DAYS = 16
#: Batches in which a whole table is taken up, in order of arrival.
BATCHES = 3

NO_KEY = "\0"
STATE = "key string, what int, day int, n_events bigint, running_total bigint, revisions bigint, n_refused bigint, closed_from int"
DAY, SNAPSHOT = 0, 1


def arrivals(events: DataFrame, fallback: DataFrame) -> DataFrame:
    """(id, key, event_time, arrived): one row per event, the event time from the fallback rows where null.

    fallback has (library_id, type, ref, event_at); its earliest non-null event_at of the same three counts.
    """
    e = events.select("id", "library_id", "type", "ref", "event_at", "created_at")
    first = e.where("id is not null").groupBy("id").agg(F.min("created_at").alias("arrived"), F.min("event_at").alias("event_at"), F.min(F.struct("library_id", "type", "ref")).alias("r"))
    first = first.select("id", F.col("r.library_id").alias("library_id"), F.col("r.type").alias("type"), F.col("r.ref").alias("ref"), "event_at", "arrived")
    known, open_ = first.where("event_at is not null"), first.where("event_at is null").drop("event_at")
    times = fallback.where("event_at is not null").groupBy("library_id", "type", "ref").agg(F.min("event_at").alias("event_at"))
    found = open_.join(times, ["library_id", "type", "ref"])
    cols = ["id", F.col("library_id").alias("key"), F.col("event_at").alias("event_time"), "arrived"]
    return known.select(*cols).unionByName(found.select(*cols)).where("arrived is not null")


def with_days(events: DataFrame) -> DataFrame:
    """Adds day and arrival as days since 1970. An arrival at a midnight still counts to the day before it, so that the
    cut-off is exact."""
    day = F.unix_date(F.to_date("event_time"))
    last = F.unix_date(F.to_date(F.col("arrived") - F.expr("interval 1 microsecond")))
    return events.where("event_time is not null and arrived is not null").withColumn("day", day).withColumn("arrival", F.greatest(last, day)).withColumn("key", F.coalesce("key", F.lit(NO_KEY)))


def _replayed(every: int, cutoff_days: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One key's batch: the state from its snapshot on, with the cells applied and the suffix replayed."""

    def run(cells: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if cells.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in STATE.split(", ")])
        key, total, days = cells["key"].iloc[0], 0, {}
        for what, day, n, running, revisions, refused, closed in state.drop(columns="key").itertuples(index=False):
            if what == SNAPSHOT:
                total = int(running)
            else:
                days[int(day)] = [int(n), int(revisions), int(refused), None if pd.isna(closed) else int(closed)]
        for arrival, day, n in cells[["arrival", "day", "n"]].sort_values(["arrival", "day"]).itertuples(index=False):
            if day not in days:
                days[day] = [0, -1, 0, None]
            row = days[day]
            if row[3] is not None or arrival > day + cutoff_days:
                row[2], row[3] = row[2] + n, arrival if row[3] is None else row[3]
            else:
                row[0], row[1] = row[0] + n, row[1] + 1
        out, block = [], None
        for day in sorted(days):
            if day // every != block:
                block = day // every
                out.append((key, SNAPSHOT, block * every, 0, total, 0, 0, None))
            n, revisions, refused, closed = days[day]
            total += n
            out.append((key, DAY, day, n, total, revisions, refused, closed))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STATE.split(", ")]).astype({"closed_from": "Int32"})

    return run


class Ledger(StoredBatches):
    """The days of all keys in a shared folder, corrected by each batch of events.

    A batch reads the buckets of its own keys, of these the days from the restored snapshot on. Batches come in order of
    arrival and hold no event that an earlier one held; one that is handed in again changes nothing.
    """

    SCHEMAS = {"state": STATE}

    def __init__(self, spark: SparkSession, folder: str, cutoff_days: int = CUTOFF_DAYS, every_days: int = EVERY_DAYS, buckets: int = 8):
        super().__init__(spark, folder, buckets)
        self.cutoff_days, self.every_days = cutoff_days, every_days

    def _latest(self, rows: DataFrame) -> DataFrame:
        """Of each day and snapshot the row of the last batch that wrote it."""
        rest = [c for c in self._columns("state") if c not in ("key", "what", "day")]
        return rows.groupBy("key", "what", "day").agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("key", "what", "day", "r.*")

    def ingest(self, events: DataFrame, batch_id: int) -> None:
        """Takes up (key, event_time, arrived) rows, one per event."""
        before = self.new_batch(batch_id)
        if before is None:
            return
        # arrivals after the cut-off are one cell of the day, at the first of them
        cells = with_days(events).groupBy("key", "day", F.least("arrival", F.col("day") + self.cutoff_days + 1).alias("cell")).agg(F.count("*").alias("n"), F.min("arrival").alias("arrival"))
        cells = checkpointed(cells.select("key", "day", "arrival", "n"))
        held = self.read("state", before, self.touched(cells, "key") if before else None, with_batch=True)
        first = cells.groupBy("key").agg((F.floor(F.min("day") / self.every_days) * self.every_days).cast("int").alias("first"))
        snaps = held.where(F.col("what") == SNAPSHOT).join(first, "key").where("day <= first").groupBy("key").agg(F.max("day").alias("start"))
        held = held.join(first, "key").join(snaps, "key", "left")
        start = F.coalesce("start", "first")
        suffix = held.where(((F.col("what") == DAY) & (F.col("day") >= start)) | ((F.col("what") == SNAPSHOT) & (F.col("day") == F.col("start"))))
        suffix = self._latest(suffix.drop("first", "start"))
        # a fixed number of partitions, as the adaptive planner would put small cells into one task
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = cells.repartition(tasks, "key").groupBy("key").cogroup(suffix.repartition(tasks, "key").groupBy("key"))
        self.write("state", batch_id, both.applyInPandas(_replayed(self.every_days, self.cutoff_days), STATE), "key")
        self.finish(batch_id)

    def days(self) -> DataFrame:
        """(key, day, n_events, running_total, revisions, n_refused, closed_from) by all that has arrived; closed_from is the
        first arrival that was refused."""
        rows = self._latest(self.read("state", self.batches(), with_batch=True).where(F.col("what") == DAY))
        rows = rows.withColumn("revisions", F.greatest("revisions", F.lit(0)))  # -1 where all events of the day came too late
        return rows.select(F.nullif(F.col("key"), F.lit(NO_KEY)).alias("key"), *[c for c in self._columns("state") if c not in ("key", "what")])


def _days(events: DataFrame, cutoff_days: int, every_days: int, batches: int) -> DataFrame:
    """The days of a whole table, taken up in batches in order of arrival."""
    spark = events.sparkSession
    at = scratch_path(spark, "ledger")
    ledger = Ledger(spark, at, cutoff_days, every_days)
    rows = with_days(events)
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    part = F.lit(0) if low is None else F.floor((F.col("arrival") - low) * batches / (high - low + 1))
    for i in range(batches):
        ledger.ingest(rows.where(part == i).select(F.nullif(F.col("key"), F.lit(NO_KEY)).alias("key"), "event_time", "arrived"), i)
    out = checkpointed(ledger.days())
    discard(spark, at)
    return out


def daily(events: DataFrame, cutoff_days: int = CUTOFF_DAYS, every_days: int = EVERY_DAYS, batches: int = BATCHES) -> DataFrame:
    """(key, day, n_events, running_total, revisions, n_refused) after all arrivals; events as of ``arrivals``."""
    return _days(checkpointed(events), cutoff_days, every_days, batches).drop("closed_from")


def too_late(events: DataFrame, cutoff_days: int = CUTOFF_DAYS, every_days: int = EVERY_DAYS, batches: int = BATCHES) -> DataFrame:
    """The events that the replay refused: those of a closed day, from the arrival on that closed it."""
    events = checkpointed(events)
    closed = _days(events, cutoff_days, every_days, batches).where("closed_from is not null").select(F.coalesce("key", F.lit(NO_KEY)).alias("key"), "day", "closed_from")
    late = with_days(events).join(closed, ["key", "day"]).where("arrival >= closed_from")
    return late.select("id", F.nullif(F.col("key"), F.lit(NO_KEY)).alias("key"), "event_time", "arrived")
