"""Queries of the general problems 1 and 4, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.ids import uuid_key_sql
from strandline.operators import late_events, orphans
from strandline.sources.tables import table


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = ("upstream_vulns", "client_impacts", "call_edges", "function_records", "event_details", "libraries", "projects", "deletion_log")
    return orphans.security_references(*(table(spark, d, n) for n in names))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_records(*_references(spark, d)).select("ref_field", "record_id").distinct()


def p1_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, d))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return late_events.arrivals(table(spark, d, "event_details"), table(spark, d, "collected_events"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.too_late(_arrivals(spark, d)).select("id").distinct()


def p4_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    days = late_events.daily(_arrivals(spark, d))
    return days.select(F.col("key").alias("library_id"), F.date_from_unix_date("day").alias("day"), "n_events", "running_total", "revisions", "n_refused")


def _sql_orphans() -> str:
    def target(name: str, field: str) -> str:
        return f"""select '{field}' as ref_field, t.key, first_at, coalesce(deleted_at >= first_at, false) as gone from
(select {uuid_key_sql("id")} as key, min(created_at) as first_at from {name} group by 1) t left join
(select {uuid_key_sql("record_id")} as key, max(deleted_at) as deleted_at from deletion_log where table_name = '{name}' group by 1) l on l.key = t.key
where t.key is not null"""

    def ref(name: str, field: str) -> str:
        return f"select '{name}.{field}' as ref_field, id as record_id, {uuid_key_sql(field)} as key, strftime(created_at, '%Y-%m') as period, created_at from {name}"

    return f"""refs as ({ref("upstream_vulns", "event_id")} union all {ref("upstream_vulns", "library_id")} union all {ref("client_impacts", "project_id")}),
targets as ({target("event_details", "upstream_vulns.event_id")} union all {target("libraries", "upstream_vulns.library_id")} union all {target("projects", "client_impacts.project_id")}),
judged as (
select r.ref_field, r.record_id, coalesce(r.period, 'unknown') as period, t.key is null or t.gone or coalesce(r.created_at < t.first_at, false) as lost
from refs r left join targets t on t.ref_field = r.ref_field and t.key = r.key where r.key is not null
union all
select 'call_edges.callee', cast(edge_id as varchar), coalesce(snapshot_id, 'unknown'), case when trim(coalesce(callee_file, '')) = ''
 then not exists (select 1 from function_records f where coalesce(f.snapshot_id, '') = coalesce(e.snapshot_id, '') and f.name = e.callee)
 else not exists (select 1 from function_records f where coalesce(f.snapshot_id, '') = coalesce(e.snapshot_id, '') and f.name = e.callee and coalesce(f.file_path, '') = e.callee_file) end
from call_edges e where trim(coalesce(callee, '')) <> '')"""


_ARRIVALS = """times as (select library_id, type, ref, min(event_at) as event_at from collected_events where event_at is not null group by all),
firsts as (select id, min(library_id) as library_id, min(type) as type, min(ref) as ref, min(event_at) as event_at, min(created_at) as arrived from event_details where id is not null group by id),
arrived as (select f.id, f.library_id, coalesce(f.event_at, t.event_at) as event_time, f.arrived from firsts f left join times t on t.library_id = f.library_id and t.type = f.type and t.ref = f.ref
where coalesce(f.event_at, t.event_at) is not null and f.arrived is not null),
dated as (select *, cast(event_time as date) as day, arrived > cast(event_time as date) + interval 4 day as late,
greatest(cast(event_time as date), cast(arrived - interval 1 microsecond as date)) as arrival from arrived)"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_orphans_by_period": p1_orphans_by_period, "p4_found": p4_found, "p4_daily_counts": p4_daily_counts}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_sql_orphans()} select distinct ref_field, record_id from judged where lost",
        "p1_orphans_by_period": f"""with {_sql_orphans()}
select ref_field, period, count(distinct record_id) as n_references, count(distinct case when lost then record_id end) as n_orphans from judged group by 1, 2""",
        "p4_found": f"with {_ARRIVALS} select id from dated where late",
        "p4_daily_counts": f"""with {_ARRIVALS},
cells as (select library_id, day, count(*) filter (where not late) as n_events, greatest(count(distinct case when not late then arrival end) - 1, 0) as revisions, count(*) filter (where late) as n_refused from dated group by 1, 2)
select library_id, day, n_events, cast(sum(n_events) over (partition by library_id order by day) as bigint) as running_total, revisions, n_refused from cells""",
    }
