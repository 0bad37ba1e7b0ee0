"""Further queries on records: due and pending work, details, merges, cascades, classes of events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.functions.ids import uuid_key, uuid_key_sql
from strandline.operators import merge, relational
from strandline.plans.proxies import view
from strandline.plans.registry import Registry
from strandline.session import scratch_path
from strandline.sources.tables import table
from strandline.streaming import ingest

query = Registry()
NOW = dt.datetime(2025, 12, 30, 9, 30)  # the moment at which work is due in the queries below


def _lit(at: dt.datetime):
    return F.lit(at).cast("timestamp_ntz")


# ---- what is due ----
@query("select id, name from libraries where platform = 'forge' and (last_scanned_at is null or last_scanned_at < timestamp '2025-12-30 09:20:00')")
def libraries_due(spark: SparkSession, d: str) -> DataFrame:
    """Never scanned, or not within the last ten minutes."""
    rows = table(spark, d, "libraries").where("platform = 'forge'")
    return rows.where(F.col("last_scanned_at").isNull() | (F.col("last_scanned_at") < _lit(NOW - dt.timedelta(minutes=10)))).select("id", "name")


@query("select id, name, scan_status from projects where auto_sync_deps and (scan_status is null or scan_status <> 'healthy' or updated_at < timestamp '2025-12-30 08:30:00')")
def projects_due(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "projects").where("auto_sync_deps")
    return rows.where(F.col("scan_status").isNull() | (F.col("scan_status") != "healthy") | (F.col("updated_at") < _lit(NOW - dt.timedelta(hours=1)))).select("id", "name", "scan_status")


@query("select id, upstream_vuln_id, created_at from (select id, min(upstream_vuln_id) as upstream_vuln_id, min(created_at) as created_at from client_impacts where pipeline_status in ('pending', 'path_searching', 'poc_generating') group by id) order by created_at nulls first, id nulls first limit 20")
def impacts_pending(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 20 impacts that the pipeline still works on: a poll, so the limit is the feature."""
    rows = table(spark, d, "client_impacts").where(F.col("pipeline_status").isin("pending", "path_searching", "poc_generating"))
    return rows.groupBy("id").agg(F.min("upstream_vuln_id").alias("upstream_vuln_id"), F.min("created_at").alias("created_at")).orderBy("created_at", "id").limit(20)


@query("select project_id, count(distinct id) as active from client_impacts where status not in ('fixed', 'not_affect') or status is null group by 1")
def active_vulns_by_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "client_impacts").where("status is null or status not in ('fixed', 'not_affect')").groupBy("project_id").agg(F.countDistinct("id").alias("active"))


@query("select l.id, max(c.seq) as newest, count(c.seq) as merged, count(*) filter (where c.event_at is null) - count(*) filter (where c.seq is null) as undated from libraries l left join collected_events c on c.library_id = l.id and c.type = 'pr_merge' and (c.event_at is null or c.event_at >= l.created_at + interval 1000 day) group by l.id")
def merges_since_mark(spark: SparkSession, d: str) -> DataFrame:
    """Merges at or after each library's mark; those without a time are kept, earlier ones skipped wherever they stand."""
    marks = table(spark, d, "libraries").select("id", (F.col("created_at") + F.expr("interval 1000 days")).alias("since"))
    rows = table(spark, d, "collected_events").where("type = 'pr_merge'").select(F.col("library_id").alias("id"), "seq", "event_at")
    kept = rows.join(marks, "id").where("event_at is null or event_at >= since").groupBy("id").agg(F.max("seq").alias("newest"), F.count("*").alias("merged"), F.count_if(F.col("event_at").isNull()).alias("undated"))
    return marks.select("id").join(kept, "id", "left").fillna(0, ["merged", "undated"])


@query("""with m as (select library_id, ref as mark from (select library_id, ref, row_number() over (partition by library_id order by created_at desc, id) as rn from event_details where type = 'commit' and ref is not null and library_id is not null and created_at is not null and id is not null) where rn = 1),
c as (select c.*, -epoch_us(event_at) as place, m.mark from collected_events c left join m on m.library_id = c.library_id where type = 'commit' and event_at is not null and c.library_id is not null),
s as (select library_id, min(place) as stop from c where ref = mark group by 1)
select c.seq, split_part(c.title, chr(10), 1) as headline, nullif(c.message, c.title) as body from c left join s on s.library_id = c.library_id where s.stop is null or c.place < s.stop""")
def commits_until_known(spark: SparkSession, d: str) -> DataFrame:
    """Commits newer than the one accepted last, all where that wasn't met; a message that repeats the title is null."""
    last = table(spark, d, "event_details").where("type = 'commit' and ref is not null and library_id is not null and created_at is not null and id is not null").groupBy("library_id").agg(F.min_by("ref", F.struct(-F.unix_micros(F.col("created_at").cast("timestamp")), "id")).alias("mark"))
    rows = table(spark, d, "collected_events").where("type = 'commit' and event_at is not null and library_id is not null").withColumn("place", -F.unix_micros(F.col("event_at").cast("timestamp"))).join(last, "library_id", "left")
    new = relational.until_sentinel(rows, ["library_id"], "place", F.col("ref") == F.col("mark"))
    return new.select("seq", F.split_part("title", F.lit("\n"), F.lit(1)).alias("headline"), F.nullif(F.col("message"), F.col("title")).alias("body"))


# ---- details ----
@query("select u.id, u.severity, c.project_id, coalesce(p.name, '') as project_name, d.resolved_version as version_used from p_upstream u left join p_client c on c.upstream_vuln_id = u.id left join p_projects p on p.id = c.project_id left join p_deps d on d.project_id = c.project_id and d.library_id = u.library_id where u.severity = 'critical'")
def upstream_impact_detail(spark: SparkSession, d: str) -> DataFrame:
    u = view(spark, d, "p_upstream").where("severity = 'critical'").select("id", "severity", "library_id")
    c = view(spark, d, "p_client").select(F.col("upstream_vuln_id").alias("id"), "project_id")
    p = view(spark, d, "p_projects").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    got = u.join(c, "id", "left").join(p, "project_id", "left").join(view(spark, d, "p_deps").select("project_id", "library_id", F.col("resolved_version").alias("version_used")), ["project_id", "library_id"], "left")
    return got.select("id", "severity", "project_id", F.coalesce("project_name", F.lit("")).alias("project_name"), "version_used")


@query("select d.library_id, l.name as library_name, d.project_id, p.name as project_name, d.constraint_source from p_deps d left join p_libraries l on l.id = d.library_id left join p_projects p on p.id = d.project_id")
def dependencies_named(spark: SparkSession, d: str) -> DataFrame:
    """Every dependency with both names, null where one is missing."""
    deps = view(spark, d, "p_deps").select("library_id", "project_id", "constraint_source")
    names = lambda v, k, n: view(spark, d, v).select(F.col("id").alias(k), F.col("name").alias(n))
    return deps.join(names("p_libraries", "library_id", "library_name"), "library_id", "left").join(names("p_projects", "project_id", "project_name"), "project_id", "left")


@query(f"with e as (select id, bool_or(coalesce(is_bugfix, false)) as is_bugfix from event_details group by id), u as (select {uuid_key_sql('event_id')} as k, count(distinct id) as vulns, min(id) as first_vuln from upstream_vulns group by 1) select e.id, e.is_bugfix, coalesce(u.vulns, 0) as vulns, u.first_vuln from e left join u on e.is_bugfix and u.k = {uuid_key_sql('e.id')}")
def event_vulns(spark: SparkSession, d: str) -> DataFrame:
    """Events with the vulnerabilities that name them, looked up for bug fixes only."""
    e = table(spark, d, "event_details").groupBy("id").agg(F.bool_or(F.coalesce("is_bugfix", F.lit(False))).alias("is_bugfix")).withColumn("k", F.when(F.col("is_bugfix"), uuid_key("id")))
    u = table(spark, d, "upstream_vulns").select(uuid_key("event_id").alias("k"), "id").where("k is not null").groupBy("k").agg(F.countDistinct("id").alias("vulns"), F.min("id").alias("first_vuln"))
    return e.join(u, "k", "left").select("id", "is_bugfix", F.coalesce("vulns", F.lit(0)).cast("bigint").alias("vulns"), "first_vuln")


# ---- classes of events and vulnerabilities ----
_SECURITY = text.SECURITY_WORDS.replace("'", "''")
_PREFIX = r"lower(regexp_extract(trim(title), '^(\w+)(?:\([^)]*\))?!?:\s', 1))"


def _rule_sql(what: int) -> str:
    show = lambda v: repr(v) if isinstance(v, str) else str(v)
    cases = " ".join(f"when '{p}' then {show(v[what])}" for p, v in text.PREFIXES.items())
    words = f"regexp_matches(concat(coalesce(title, ''), ' ', coalesce(message, '')), '(?i)\\b(?:{_SECURITY})\\b')"
    return f"case when type = 'tag' then {show(('other', 0.95)[what])} when regexp_matches(coalesce(author, ''), '(?i)\\b({text.BOTS})\\b') then {show(('other', 0.9)[what])} when {words} then null else case {_PREFIX} {cases} end end"


@query(f"select seq, {_rule_sql(0)} as classification, cast({_rule_sql(1)} as double) as confidence from collected_events")
def text_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_events").select("seq", text.rule_class("type", "author", "title", "message").alias("r")).select("seq", "r.*")


@query(f"select doc_id, cast(len(regexp_extract_all(text, '(?i)\\b(?:{_SECURITY})\\b')) as int) as words from documents")
def text_security_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.security_words("text")).alias("words"))


_CLASS_SQL = "case lower(label) " + " ".join(f"when '{a}' then '{c}'" for a, c in text.CLASSES.items()) + " else 'other' end"


@query(rf"select seq, {_CLASS_SQL} as classification, case when label is null then 0.5 else least(1.0, cast(seq % 150 as double) / 100) end as confidence from (select seq, nullif(regexp_extract(title, '^(\w+)(?:\([^)]*\))?!?:\s', 1), '') as label from collected_events)")
def text_reply_class(spark: SparkSession, d: str) -> DataFrame:
    """A scorer's replies are written from each event's title and read back: labels folded, confidences cut to 0..1."""
    label = text.title_prefix("title")
    json = F.to_json(F.struct(F.upper(label).alias("label"), F.when(label.isNotNull(), F.col("seq") % 150 / 100).alias("confidence")))
    rows = table(spark, d, "collected_events").select("seq", F.concat(F.lit("The change reads as follows.\n"), json, F.lit(" That is all {sure}.")).alias("reply"))
    return rows.select("seq", text.reply_class("reply").alias("r")).select("seq", "r.*")


def _folded_sql(c: str, spellings: dict, default: str) -> str:
    return f"case {' '.join(f'''when lower(trim({c})) in ({', '.join(map(repr, known))}) then '{name}' ''' for name, known in spellings.items())} else '{default}' end"


@query(f"select {_folded_sql('vuln_type', text.VULN_TYPES, 'other')} as vuln_type, {_folded_sql('severity', text.SEVERITIES, 'unknown')} as severity, count(distinct id) as vulns, count(*) as deliveries from upstream_vulns group by 1, 2")
def vuln_types_folded(spark: SparkSession, d: str) -> DataFrame:
    keys = text.folded("vuln_type", text.VULN_TYPES, "other").alias("vuln_type"), text.folded("severity", text.SEVERITIES, "unknown").alias("severity")
    return table(spark, d, "upstream_vulns").groupBy(*keys).agg(F.countDistinct("id").alias("vulns"), F.count("*").alias("deliveries"))


# ---- runs and registries ----
@query("select library_id, count(*) as runs, cast(sum(fetched) as bigint) as fetched, cast(sum(inserted) as bigint) as inserted, cast(sum(len(errors)) as bigint) as errors, cast(sum(coalesce(by_type['commit'], 0)) as bigint) as commits from (select distinct * from collect_results) group by 1")
def collection_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collect_results").groupBy("run_id", "library_id", "started_at", "fetched", "inserted", F.to_json("by_type").alias("types"), F.coalesce(F.try_element_at("by_type", F.lit("commit")), F.lit(0)).alias("commits"), F.to_json("errors").alias("said"), F.size("errors").alias("errors")).agg(F.lit(1).alias("one"))
    errors = F.when(F.col("errors") >= 0, F.col("errors"))
    return rows.groupBy("library_id").agg(F.count("*").alias("runs"), F.sum("fetched").alias("fetched"), F.sum("inserted").alias("inserted"), F.sum(errors).alias("errors"), F.sum("commits").alias("commits"))


@query(r"""select ecosystem, count(*) as total, count(*) filter (where notes = '') as ok, count(*) filter (where notes <> '') as problems, max(nullif(notes, '')) as sample_notes from (select ecosystem, concat_ws('; ', case when regexp_matches(repo_url, '(/|\.git)$') then 'url redirects' end, case when collect_status <> 'healthy' then concat('collect: ', coalesce(collect_error, 'unknown')) end, case when last_scanned_at is null then 'never scanned' end) as notes from libraries) group by 1""")
def registry_health(spark: SparkSession, d: str) -> DataFrame:
    notes = F.concat_ws("; ", F.when(F.col("repo_url").rlike(r"(/|\.git)$"), "url redirects"), F.when(F.col("collect_status") != "healthy", F.concat(F.lit("collect: "), F.coalesce("collect_error", F.lit("unknown")))), F.when(F.col("last_scanned_at").isNull(), "never scanned"))
    rows = table(spark, d, "libraries").select("ecosystem", notes.alias("notes"))
    return rows.groupBy("ecosystem").agg(F.count("*").alias("total"), F.count_if(F.col("notes") == "").alias("ok"), F.count_if(F.col("notes") != "").alias("problems"), F.max(F.nullif(F.col("notes"), F.lit(""))).alias("sample_notes"))


@query("""with a as (select lower(name) as name, id as library_id, 0 as part from libraries where name is not null union all select lower(library_name), library_id, 1 from event_details where library_name is not null)
select name, library_id, part from (select *, row_number() over (partition by name order by part, library_id nulls first) as rn from a) where rn = 1""")
def libraries_known_first(spark: SparkSession, d: str) -> DataFrame:
    """Libraries by name, the registered ones before those that events alone name."""
    own = table(spark, d, "libraries").where("name is not null").select(F.lower("name").alias("name"), F.col("id").alias("library_id"))
    told = table(spark, d, "event_details").where("library_name is not null").select(F.lower("library_name").alias("name"), "library_id").distinct()
    return merge.first_of_sources([own, told], "name")


_TOLD = r"select library_name as name, min(lower(regexp_extract(source_url, '^(https://[^/]+/[^/]+/[^/]+)/', 1))) as repo_url from event_details where library_name is not null and regexp_matches(source_url, '^https://[^/]+/[^/]+/[^/]+/') group by 1"
_OWN = r"select name, min(lower(regexp_replace(regexp_replace(trim(repo_url), '/+$', ''), '\.git$', ''))) as repo_url from libraries where name is not null group by 1"


def _told_libraries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, d, "libraries").where("name is not null").groupBy("name").agg(F.min(F.lower(F.regexp_replace(F.regexp_replace(F.trim("repo_url"), r"/+$", ""), r"\.git$", ""))).alias("repo_url"))
    told = table(spark, d, "event_details").where(F.col("library_name").isNotNull() & F.col("source_url").rlike(r"^https://[^/]+/[^/]+/[^/]+/"))
    return merge.upsert_by_name(own, told.groupBy(F.col("library_name").alias("name")).agg(F.min(F.lower(F.regexp_extract("source_url", r"^(https://[^/]+/[^/]+/[^/]+)/", 1))).alias("repo_url")), "name", "repo_url")


@query(f"with t as ({_TOLD}), o as ({_OWN}) select t.name, t.repo_url, o.repo_url as known from t join o on o.name = t.name where t.repo_url is distinct from o.repo_url")
def library_upsert_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _told_libraries(spark, d)[1]


@query(f"with t as ({_TOLD}), o as ({_OWN}) select t.name, t.repo_url from t where not exists (select 1 from o where o.name = t.name)")
def library_upsert_new(spark: SparkSession, d: str) -> DataFrame:
    return _told_libraries(spark, d)[0]


# ---- deletes ----
@query(f"""with g as (select distinct {uuid_key_sql('record_id')} as k from deletion_log where table_name = 'event_details'), u as (select *, {uuid_key_sql('event_id')} as k, {uuid_key_sql('id')} as own from upstream_vulns where id is not null),
lost as (select distinct u.own from u where k in (select k from g where k is not null))
select 'upstream_vulns' as table_name, count(*) as kept from u where k is null or k not in (select k from g where k is not null)
union all select 'client_impacts', count(*) from client_impacts c where {uuid_key_sql('c.upstream_vuln_id')} is null or {uuid_key_sql('c.upstream_vuln_id')} not in (select own from lost where own is not null)""")
def delete_cascades(spark: SparkSession, d: str) -> DataFrame:
    """What stays of vulnerabilities and their impacts once the deleted events are gone."""
    gone = table(spark, d, "deletion_log").where("table_name = 'event_details'").select(uuid_key("record_id").alias("event"))
    u = table(spark, d, "upstream_vulns").where("id is not null").select(uuid_key("event_id").alias("event"), uuid_key("id").alias("vuln"))
    c = table(spark, d, "client_impacts").select(uuid_key("upstream_vuln_id").alias("vuln"))
    kept = merge.delete_cascade(gone, {"events": (gone, "event", None, None), "upstream_vulns": (u, "vuln", "events", "event"), "client_impacts": (c, "vuln", "upstream_vulns", "vuln")}, "event")
    counts = [kept[n].agg(F.lit(n).alias("table_name"), F.count("*").alias("kept")) for n in ("upstream_vulns", "client_impacts")]
    return counts[0].unionByName(counts[1])


@query("select o_orderkey as id from orders where o_orderdate < (select max(o_orderdate) from orders) - interval 90 day")
def snapshot_ttl(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    newest = rows.agg(F.max("o_orderdate").alias("newest"))
    return rows.join(F.broadcast(newest), F.col("o_orderdate") < F.col("newest") - F.expr("interval 90 days")).select("id")  # one row is broadcast


# ---- micro-batches ----
@query("select distinct library_id, type, ref from collected_events where library_id is not null and type is not null and ref is not null")
def stream_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Events taken up file by file as a stream; each (library, type, ref) is accepted once, whatever batch brings it.

    The path is a pattern, as a stream takes a table of one file only so."""
    at, rows = scratch_path(spark, "accepted"), table(spark, d, "collected_events")
    known = ["library_id", "type", "ref"]
    accept = ingest.insert_ignore_into(spark, f"{at}/table", known, "seq")
    ingest.run_available(spark, rows.schema, f"{d.rstrip('/')}/collected_events.parque[t]", f"{at}/state", lambda batch, i: accept(batch.select(*known, "seq").dropna(subset=known), i))
    return spark.read.parquet(f"{at}/table/rows").select(*known)


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
