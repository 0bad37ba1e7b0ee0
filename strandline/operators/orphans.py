"""Problem 1: references to records that do not exist.

References are first aggregated per key and period (partial aggregation on the map side), so a key that holds a
third of all rows is a few rows before anything is shuffled. The cells of heavy keys are checked against a broadcast
of those keys' targets (at most ``MAX_HEAVY`` rows), the remaining cells by a shuffled outer join, and both verdicts
are united. Only cells with an orphan go back to their records, split in the same way.

Defined cases: a null or blank reference is none; a reference in no known spelling has no target; a null created_at of
the reference or of the target can't be "too early", so only absence or deletion makes it an orphan; repeated rows of a
record count once; a record whose rows carry different references is an orphan when one of them is. An empty target
table makes every reference an orphan, an empty reference table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.ids import uuid_key
from strandline.session import checkpointed

#: Rows from which a key counts as heavy, and how many heavy keys are broadcast at most (the largest; others shuffle).
HEAVY_ROWS = 200_000
MAX_HEAVY = 1_000

KEY = ["ref_field", "key"]


def references(df: DataFrame, ref_field: str, record_id: Column, key: Column, period: Column, created_at: Column) -> DataFrame:
    """One row per record and reference, without null or blank references."""
    return df.select(F.lit(ref_field).alias("ref_field"), record_id.alias("record_id"), key.alias("key"), period.alias("period"), created_at.alias("created_at")).where("key is not null")


def table_targets(df: DataFrame, deletions: DataFrame, table: str, ref_field: str) -> DataFrame:
    """(ref_field, key, gone, first_at) of the records of a table: gone when deleted at or after its earliest row."""
    rows = df.select(uuid_key("id").alias("key"), F.col("created_at").alias("at")).where("key is not null").groupBy("key").agg(F.min("at").alias("first_at"))
    log = deletions.where(F.col("table_name") == table).select(uuid_key("record_id").alias("key"), F.col("deleted_at").alias("at")).groupBy("key").agg(F.max("at").alias("deleted_at"))
    return rows.join(log, "key", "left").select(F.lit(ref_field).alias("ref_field"), "key", F.coalesce(F.col("deleted_at") >= F.col("first_at"), F.lit(False)).alias("gone"), "first_at")


def _split(rows: DataFrame, heavy: DataFrame | None, targets: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined to targets: heavy keys by broadcast, all others by shuffle."""
    if heavy is None:
        return rows.join(targets, on, how)
    few = F.broadcast(targets.join(F.broadcast(heavy), on, "left_semi"))
    return rows.join(F.broadcast(heavy), on, "left_semi").join(few, on, how).unionByName(rows.join(F.broadcast(heavy), on, "left_anti").join(targets, on, how))


def _heavy(cells: DataFrame, on: list[str], heavy_rows: int, max_heavy: int) -> DataFrame | None:
    """The heavy keys, at most max_heavy rows; None if there are none."""
    keys = checkpointed(cells.groupBy(*on).agg(F.sum("n").alias("n")).where(F.col("n") >= heavy_rows).orderBy(F.desc("n"), *on).limit(max_heavy).select(*on))
    return None if keys.isEmpty() else keys


def judged_cells(refs: DataFrame, targets: DataFrame, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """(ref_field, key, period, n, verdict, first_at); verdict is 'all', 'none' or 'mixed' of the cell's rows.

    refs has (ref_field, record_id, key, period, created_at), targets one row (ref_field, key, gone, first_at) a key.
    """
    cells = checkpointed(refs.groupBy(*KEY, "period").agg(F.count("*").alias("n"), F.min("created_at").alias("lo"), F.max("created_at").alias("hi"), F.count("created_at").alias("dated")))
    known = targets.withColumn("known", F.lit(True))
    both = _split(cells, _heavy(cells, KEY, heavy_rows, max_heavy), known, KEY, "left")
    verdict = (
        F.when(F.col("known").isNull() | F.col("gone"), "all")
        .when((F.col("hi") < F.col("first_at")) & (F.col("dated") == F.col("n")), "all")
        .when(F.col("lo") < F.col("first_at"), "mixed")
        .otherwise("none")
    )
    return both.select(*KEY, "period", "n", verdict.alias("verdict"), "first_at")


def orphan_records(refs: DataFrame, targets: DataFrame, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """The references (ref_field, record_id, key, period) without a target, one row each."""
    bad = checkpointed(judged_cells(refs, targets, heavy_rows, max_heavy).where("verdict <> 'none'"))
    on = [*KEY, "period"]
    # a null period is a period of its own
    refs, bad = (x.withColumn("period", F.coalesce("period", F.lit("unknown"))) for x in (refs, bad))
    rows = _split(refs, _heavy(bad, on, heavy_rows, max_heavy), bad.select(*on, "verdict", "first_at"), on, "inner")
    return rows.where((F.col("verdict") == "all") | (F.col("created_at") < F.col("first_at"))).select("ref_field", "record_id", "key", "period").distinct()


def orphan_counts(refs: DataFrame, targets: DataFrame, heavy_rows: int = HEAVY_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """(ref_field, period, n_references, n_orphans): records with a reference, and those without its target."""
    whole = refs.withColumn("period", F.coalesce("period", F.lit("unknown"))).select("ref_field", "period", "record_id").distinct().groupBy("ref_field", "period").agg(F.count("*").alias("n_references"))
    lost = orphan_records(refs, targets, heavy_rows, max_heavy).select("ref_field", "period", "record_id").distinct().groupBy("ref_field", "period").agg(F.count("*").alias("n_orphans"))
    return whole.join(lost, ["ref_field", "period"], "left").select("ref_field", "period", "n_references", F.coalesce("n_orphans", F.lit(0)).cast("bigint").alias("n_orphans"))


def security_references(vulns: DataFrame, impacts: DataFrame, edges: DataFrame, functions: DataFrame, events: DataFrame, libraries: DataFrame, projects: DataFrame, deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The references and targets of the vulnerability tables and the call graph."""
    month = F.date_format("created_at", "yyyy-MM")

    def of(df: DataFrame, name: str, field: str) -> DataFrame:
        return references(df, f"{name}.{field}", F.col("id"), uuid_key(field), month, F.col("created_at"))

    def part(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    any_file, sep = F.lit(""), F.lit("\x1f")
    blank = F.trim(part("callee_file")) == ""
    callee = F.when(F.trim("callee") != "", F.concat(part("snapshot_id"), sep, F.col("callee"), sep, F.when(blank, any_file).otherwise(F.col("callee_file"))))
    refs = [
        of(vulns, "upstream_vulns", "event_id"),
        of(vulns, "upstream_vulns", "library_id"),
        of(impacts, "client_impacts", "project_id"),
        references(edges, "call_edges.callee", F.col("edge_id").cast("string"), callee, F.col("snapshot_id"), F.lit(None).cast("timestamp_ntz")),
    ]
    names = (
        functions.where("name is not null")
        .select(F.explode(F.array(any_file, part("file_path"))).alias("file"), "snapshot_id", "name")
        .select(F.lit("call_edges.callee").alias("ref_field"), F.concat(part("snapshot_id"), sep, F.col("name"), sep, F.col("file")).alias("key"))
        .distinct()
        .select("ref_field", "key", F.lit(False).alias("gone"), F.lit(None).cast("timestamp_ntz").alias("first_at"))
    )
    targets = [
        table_targets(events, deletions, "event_details", "upstream_vulns.event_id"),
        table_targets(libraries, deletions, "libraries", "upstream_vulns.library_id"),
        table_targets(projects, deletions, "projects", "client_impacts.project_id"),
        names,
    ]
    return reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, targets)
