"""Queries of the problems tagged llm, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import batch_dedup, mixing, packing, pii, reading, residue, source_files, tokens
from strandline.session import checkpointed, scratch_path
from strandline.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "event_details"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.with_placeholders(table(spark, d, "event_details")).select("id", "created_at", "message", "author")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "event_details")).select("id").distinct()


def p3_real_messages(spark: SparkSession, d: str) -> DataFrame:
    """The events with a message that somebody wrote, one row each."""
    events = table(spark, d, "event_details").where("trim(message) <> ''").groupBy("id").agg(F.min("created_at").alias("created_at"), F.min_by("message", "created_at").alias("message"))
    return events.join(residue.residue(table(spark, d, "event_details")), "id", "left_anti")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return batch_dedup.repeats(table(spark, d, "collected_events"))


def p5_inserted(spark: SparkSession, d: str) -> DataFrame:
    """The right value of collect_results.inserted for each run."""
    rows = table(spark, d, "collected_events")
    firsts = batch_dedup.first_rows(rows)
    runs = rows.select("seq", "run_id").join(firsts, "seq").groupBy("run_id").agg(F.count("*").alias("fetched"), F.count_if(F.col("seq") == F.col("first")).alias("inserted"))
    said = table(spark, d, "collect_results").groupBy("run_id").agg(F.max("inserted").alias("reported"))
    return said.join(runs, "run_id", "full").select("run_id", F.coalesce("fetched", F.lit(0)).cast("bigint").alias("fetched"), F.coalesce("inserted", F.lit(0)).cast("bigint").alias("inserted"), "reported")


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    """What each batch of runs brings, in order of arrival, as checked against the stored history of those before."""
    history = batch_dedup.History(spark, scratch_path(spark, "history"))
    batch_dedup.ingest_in_batches(history, table(spark, d, "collected_events"))
    return history.told().select("seq", "first", "batch")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return source_files.not_hand_written(table(spark, d, "function_records"), table(spark, d, "libraries")).select("snapshot_id", "file_path")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files by library and kind; hand_written are the files that remain."""
    files = source_files.judged_files(table(spark, d, "function_records"), table(spark, d, "libraries"))
    return files.groupBy("library_id", F.coalesce("kind", F.lit("hand_written")).alias("kind")).agg(F.count("*").alias("files"))


def _sized(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return checkpointed(tokens.with_tokens(table(spark, d, "documents"), ["doc_id", *keep]))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(_sized(spark, d), table(spark, d, "containers"))


def p7_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused(p7_packed(spark, d), table(spark, d, "containers"))


def p8_repeats(spark: SparkSession, d: str) -> DataFrame:
    return mixing.repeats(_sized(spark, d, "source"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = _sized(spark, d, "source"), table(spark, d, "mix_targets")
    return mixing.shares(mixing.repeats(sized, targets), sized, targets)


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(p9_levels(spark, d))


def queries() -> dict:
    more = {"p9_levels": p9_levels, "p9_profile": p9_profile, "p7_packed": p7_packed, "p7_unused": p7_unused, "p8_repeats": p8_repeats, "p8_shares": p8_shares}
    return more | {"p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_real_messages": p3_real_messages, "p5_found": p5_found, "p5_inserted": p5_inserted, "p5_history": p5_history, "p6_found": p6_found, "p6_kinds": p6_kinds}


def oracle_sql() -> dict[str, str]:
    return {}
