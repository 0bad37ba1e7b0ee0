"""The platform's queries on the operators, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.functions.ids import uuid_key, uuid_key_sql
from strandline.operators import graph, merge, relational
from strandline.plans.proxies import view
from strandline.plans.registry import Registry
from strandline.session import checkpointed
from strandline.sources import dot, manifests
from strandline.sources.tables import table

STAGES = ["recorded", "reported", "confirmed", "fixed"]
CUT = dt.datetime(2025, 6, 1)
HOPS = 50  # a search from entry points goes no deeper
SEEN = dt.datetime(1999, 1, 1)  # dependencies seen before are those of an earlier scan
query = Registry()


# the latest state of each record of the platform's own tables
_LATEST = "{t}_l as (select * from (select *, row_number() over (partition by id order by created_at desc nulls last) as rn from {t}) where rn = 1)"


@query("select project_id, " + ", ".join(f"count(*) filter (where status in ({', '.join(map(repr, STAGES[i:]))})) as {s}" for i, s in enumerate(STAGES)) + " from p_client group by project_id")
def vuln_stats_by_project(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "p_client").groupBy("project_id").agg(*relational.reached_counts("status", STAGES))


@query("select count(*) filter (where status in ('recorded', 'reported', 'confirmed', 'fixed')) as recorded, count(*) filter (where status in ('reported', 'confirmed', 'fixed')) as reported, count(*) filter (where status in ('confirmed', 'fixed')) as confirmed, count(*) filter (where status = 'fixed') as fixed from client_impacts")
def impact_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "client_impacts").agg(*relational.reached_counts("status", STAGES))


@query("select c.id, c.status, u.severity, l.name as library_name, coalesce(p.name, '') as project_name from p_client c join p_upstream u on u.id = c.upstream_vuln_id left join p_libraries l on l.id = u.library_id left join p_projects p on p.id = c.project_id where u.severity in ('critical', 'high') and c.created_at <= timestamp '2024-06-30 00:00:00'")
def client_vulns_enriched(spark: SparkSession, d: str) -> DataFrame:
    c, u = view(spark, d, "p_client"), view(spark, d, "p_upstream").select(F.col("id").alias("upstream_vuln_id"), "severity", "library_id")
    c = c.where(F.col("created_at") <= F.lit("2024-06-30 00:00:00").cast("timestamp_ntz")).join(u.where(F.col("severity").isin("critical", "high")), "upstream_vuln_id")
    names = lambda v, k, n: view(spark, d, v).select(F.col("id").alias(k), F.col("name").alias(n))
    got = c.join(names("p_libraries", "library_id", "library_name"), "library_id", "left").join(names("p_projects", "project_id", "project_name"), "project_id", "left")
    return got.select("id", "status", "severity", "library_name", F.coalesce("project_name", F.lit("")).alias("project_name"))


@query("select id, library_id, created_at from p_events e where classification is null and exists (select 1 from p_deps d where d.library_id = e.library_id)")
def events_unclassified_used(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "p_events").where("classification is null").select("id", "library_id", "created_at")
    return relational.waiting(e, None, view(spark, d, "p_deps"), needed_on=("library_id", "library_id"))


@query(f"select id, library_id from (select id, min(library_id) as library_id from event_details where is_bugfix group by id) e where not exists (select 1 from upstream_vulns u where {uuid_key_sql('u.event_id')} = {uuid_key_sql('e.id')})")
def bugfix_without_vuln(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "event_details").where("is_bugfix").groupBy("id").agg(F.min("library_id").alias("library_id")).withColumn("k", uuid_key("id"))
    done = table(spark, d, "upstream_vulns").select(uuid_key("event_id").alias("k")).where("k is not null")
    return relational.waiting(e, done, None, done_on=("k", "k")).select("id", "library_id")


@query("select id, library_id, published_at from p_upstream u where status = 'published' and not exists (select 1 from p_client c where c.upstream_vuln_id = u.id) and exists (select 1 from p_deps d where d.library_id = u.library_id)")
def published_without_impact(spark: SparkSession, d: str) -> DataFrame:
    u = view(spark, d, "p_upstream").where("status = 'published'").select("id", "library_id", "published_at")
    return relational.waiting(u, view(spark, d, "p_client"), view(spark, d, "p_deps"), ("id", "upstream_vuln_id"), ("library_id", "library_id"))


@query("select l.id, l.name, count(d.project_id) as used_by from p_libraries l left join p_deps d on d.library_id = l.id group by l.id, l.name")
def used_by_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.with_counts(view(spark, d, "p_libraries").select("id", "name"), view(spark, d, "p_deps"), "id", "library_id", "used_by")


@query("select l.id, l.name, l.collect_status, count(d.project_id) as used_by from p_libraries l left join p_deps d on d.library_id = l.id group by all order by l.collect_status desc nulls last, used_by desc nulls last, l.name asc nulls first limit 20 offset 20")
def libraries_cascade_page(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.with_counts(view(spark, d, "p_libraries").select("id", "name", "collect_status"), view(spark, d, "p_deps"), "id", "library_id", "used_by")
    return relational.cascading_page(rows, 1, 20, "collect_status", True)


@query("select ecosystem, count(*) filter (where collect_status = 'healthy') as healthy, count(*) filter (where collect_status = 'unhealthy') as unhealthy from libraries group by ecosystem")
def library_health_pivot(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "libraries").groupBy("ecosystem").pivot("collect_status", ["healthy", "unhealthy"]).count().fillna(0, ["healthy", "unhealthy"])


@query("select used, count(*) as libraries from (select l.id, count(d.project_id) > 0 as used from p_libraries l left join p_deps d on d.library_id = l.id where l.collect_status <> 'healthy' group by l.id) group by used")
def library_unhealthy_clients(spark: SparkSession, d: str) -> DataFrame:
    rows = relational.with_counts(view(spark, d, "p_libraries").where("collect_status <> 'healthy'").select("id"), view(spark, d, "p_deps"), "id", "library_id", "used_by")
    return rows.groupBy((F.col("used_by") > 0).alias("used")).agg(F.count("*").alias("libraries"))


@query("select p.id, coalesce(n.deps, 0) as deps_count, coalesce(v.vulns, 0) as vuln_count from p_projects p left join (select project_id, count(*) as deps from p_deps group by 1) n on n.project_id = p.id left join (select project_id, count(*) as vulns from p_client where status not in ('fixed', 'not_affect') or status is null group by 1) v on v.project_id = p.id")
def project_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    p = relational.with_counts(view(spark, d, "p_projects").select("id"), view(spark, d, "p_deps"), "id", "project_id", "deps_count")
    open_ = view(spark, d, "p_client").where("status is null or status not in ('fixed', 'not_affect')")
    return relational.with_counts(p, open_, "id", "project_id", "vuln_count")


@query("select id, library_id, created_at from p_events order by created_at desc, id desc limit 21")
def events_keyset_page1(spark: SparkSession, d: str) -> DataFrame:
    return relational.keyset_page(view(spark, d, "p_events").select("id", "library_id", "created_at"))


@query("select id, library_id, created_at from p_events where created_at < timestamp '2024-03-01 00:00:00' or (created_at = timestamp '2024-03-01 00:00:00' and id < 1000000) order by created_at desc, id desc limit 51")
def events_keyset_page2(spark: SparkSession, d: str) -> DataFrame:
    return relational.keyset_page(view(spark, d, "p_events").select("id", "library_id", "created_at"), 50, (dt.datetime(2024, 3, 1), 1_000_000))


@query("select u.id as upstream_vuln_id, d.project_id, d.constraint_source, d.resolved_version from p_upstream u join p_deps d on d.library_id = u.library_id where u.status = 'published' and not exists (select 1 from p_client c where c.upstream_vuln_id = u.id and c.project_id = d.project_id)")
def impact_fanout(spark: SparkSession, d: str) -> DataFrame:
    u = view(spark, d, "p_upstream").where("status = 'published'").select(F.col("id").alias("upstream_vuln_id"), "library_id")
    pairs = u.join(view(spark, d, "p_deps"), "library_id").select("upstream_vuln_id", "project_id", "constraint_source", "resolved_version")
    return pairs.join(view(spark, d, "p_client").select("upstream_vuln_id", "project_id"), ["upstream_vuln_id", "project_id"], "left_anti")


@query("select (select count(*) from projects) as projects, (select count(*) from libraries) as libraries, (select count(distinct id) from event_details) as events, (select count(distinct id) from upstream_vulns) as vulns, (select count(distinct id) from client_impacts) as impacts, (select count(*) from call_edges) as edges")
def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    count = lambda t, c, name: table(spark, d, t).agg((F.countDistinct("id") if c else F.count("*")).alias(name)).withColumn("k", F.lit(1))
    out = count("projects", False, "projects")
    for t, c, n in (("libraries", False, "libraries"), ("event_details", True, "events"), ("upstream_vulns", True, "vulns"), ("client_impacts", True, "impacts"), ("call_edges", False, "edges")):
        out = out.join(count(t, c, n), "k")
    return out.drop("k")


@query("select library_id, type, ref, min(seq) as seq from collected_events c where event_at >= timestamp '2025-06-01 00:00:00' and not exists (select 1 from collected_events o where (o.event_at < timestamp '2025-06-01 00:00:00') and o.library_id is not distinct from c.library_id and o.type is not distinct from c.type and o.ref is not distinct from c.ref) group by 1, 2, 3")
def events_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collected_events").withColumns({c: F.coalesce(c, F.lit("\0")) for c in ("library_id", "type", "ref")})
    cut = F.lit(CUT).cast("timestamp_ntz")
    new = merge.insert_ignore(rows.where(F.col("event_at") < cut), rows.where(F.col("event_at") >= cut), ["library_id", "type", "ref"], "seq")
    return new.select(*(F.nullif(F.col(c), F.lit("\0")).alias(c) for c in ("library_id", "type", "ref")), "seq")


_OLD = "o as (select project_id, library_id, constraint_source, resolved_version from p_deps where first_seen < timestamp '1999-01-01 00:00:00'), n as (select project_id, library_id, 'go.mod' as constraint_source, resolved_version + 1 as resolved_version from p_deps where last_seen >= timestamp '1999-01-01 00:00:00')"
_UPSERTED = "select coalesce(o.project_id, n.project_id) as project_id, coalesce(o.library_id, n.library_id) as library_id, case when o.constraint_source = 'manual' then 'manual' else coalesce(n.constraint_source, o.constraint_source) end as constraint_source, coalesce(n.resolved_version, o.resolved_version) as resolved_version, n.project_id is not null as found from o full join n on n.project_id = o.project_id and n.library_id = o.library_id"


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The dependencies known before a scan, and those that the scan finds."""
    deps, at = view(spark, d, "p_deps"), F.lit(SEEN).cast("timestamp_ntz")
    old = deps.where(F.col("first_seen").cast("timestamp_ntz") < at).select("project_id", "library_id", "constraint_source", "resolved_version")
    return old, deps.where(F.col("last_seen").cast("timestamp_ntz") >= at).select("project_id", "library_id", F.lit("go.mod").alias("constraint_source"), (F.col("resolved_version") + 1).alias("resolved_version"))


def _upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    return merge.upsert(old, new, ["project_id", "library_id"], {"constraint_source": merge.keep_value("constraint_source", "manual"), "resolved_version": merge.keep_known("resolved_version")})


@query(f"with {_OLD} select project_id, library_id, constraint_source, resolved_version from ({_UPSERTED})")
def deps_upsert_preserve_manual(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(*_scans(spark, d))


@query(f"with {_OLD} select o.* from o where not (constraint_source <> 'manual' and exists (select 1 from n where n.project_id = o.project_id) and not exists (select 1 from n where n.project_id = o.project_id and n.library_id = o.library_id))")
def deps_delete_stale(spark: SparkSession, d: str) -> DataFrame:
    old, new = _scans(spark, d)
    return merge.without_stale(old, new, new, "project_id", ["project_id", "library_id"], F.col("constraint_source") == "manual")


@query(f"with {_OLD}, u as ({_UPSERTED}), s as (select *, constraint_source <> 'manual' and not found and exists (select 1 from n where n.project_id = u.project_id) as stale from u) select project_id, count(*) filter (where found) as upserted, count(*) filter (where stale) as deleted, count(*) filter (where not stale) as kept from s group by 1")
def deps_synced(spark: SparkSession, d: str) -> DataFrame:
    """One scan of every project as a whole: its finds upserted, then what it didn't find deleted, with the counts of both."""
    old, new = _scans(spark, d)
    all_, key = _upserted(old, new), ["project_id", "library_id"]
    left = merge.without_stale(all_, new, new, "project_id", key, F.col("constraint_source") == "manual").groupBy("project_id").agg(F.count("*").alias("kept"))
    counts = all_.groupBy("project_id").agg(F.count("*").alias("all")).join(left, "project_id", "left").join(new.groupBy("project_id").agg(F.count("*").alias("upserted")), "project_id", "left").fillna(0)
    return counts.select("project_id", "upserted", (F.col("all") - F.col("kept")).alias("deleted"), "kept")


@query("select project_id, constraint_source, count(*) as dependencies, count(*) filter (where resolved_version is not null) as pinned, min(library_id) as first_library, max(last_seen) as last_seen from p_deps group by 1, 2")
def deps_report(spark: SparkSession, d: str) -> DataFrame:
    """Each project's dependencies by the kind of file that names them."""
    return view(spark, d, "p_deps").groupBy("project_id", "constraint_source").agg(F.count("*").alias("dependencies"), F.count("resolved_version").alias("pinned"), F.min("library_id").alias("first_library"), F.max("last_seen").alias("last_seen"))


@query("""select l.id, coalesce(c.ref, l.latest_commit_sha) as latest_commit_sha, coalesce(t.ref, l.latest_tag_version) as latest_tag_version from libraries l
left join (select library_id, arg_max(ref, (event_at, seq)) as ref from collected_events where type = 'commit' and event_at is not null group by 1) c on c.library_id = l.id
left join (select library_id, arg_max(ref, (event_at, seq)) as ref from collected_events where type = 'tag' and event_at is not null group by 1) t on t.library_id = l.id""")
def pointers_coalesce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "collected_events").where("event_at is not null")
    newest = e.groupBy(F.col("library_id").alias("id")).agg(*(F.max_by(F.when(F.col("type") == t, F.col("ref")), F.when(F.col("type") == t, F.struct("event_at", "seq"))).alias(c) for t, c in (("commit", "latest_commit_sha"), ("tag", "latest_tag_version"))))
    old = table(spark, d, "libraries").select("id", "latest_commit_sha", "latest_tag_version")
    new = newest.join(old.select("id"), "id", "left_semi")
    return merge.upsert(old, new, ["id"], {c: merge.keep_known(c) for c in ("latest_commit_sha", "latest_tag_version")})


@query(f"with {_LATEST.format(t='event_details')} select id, classification, confidence, created_at from event_details_l where id is not null")
def events_latest_state(spark: SparkSession, d: str) -> DataFrame:
    return relational.newest_per_key(table(spark, d, "event_details").where("id is not null"), ["id"], "created_at", 1, "id").select("id", "classification", "confidence", "created_at")


@query("select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn <= 5")
def snapshot_top5_per_repo(spark: SparkSession, d: str) -> DataFrame:
    return relational.newest_per_key(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", 5, "o_orderkey").select("o_custkey", "o_orderkey")


@query("select o_orderkey as id from (select o_orderkey, sum(o_custkey) over (order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as before, sum(o_custkey) over () as used from orders) where coalesce(before, 0) < used - 0.7 * used / 0.9")
def eviction_by_pressure(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_accessed_at"), F.col("o_custkey").alias("size_bytes"))
    used = rows.agg(F.sum("size_bytes")).first()[0]
    return relational.evicted_by_pressure(rows, used, used / 0.9).select("id")


@query(r"""select id, regexp_extract(u, '^(?:[a-z+]+://(?:[^/@]+@)?[^/]+/|[^/@]+@[^/:]+:)(?:.*/)?([^/]+/[^/]+)$', 1) as path, regexp_replace(regexp_replace(trim(repo_url), '/+$', ''), '^.*/', '') as raw_name, regexp_replace(regexp_replace(u, '^.*/', ''), '\.git$', '') as name from (select id, repo_url, regexp_replace(regexp_replace(trim(repo_url), '/+$', ''), '\.git$', '') as u from libraries)""")
def text_url_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "libraries").select("id", text.repo_path("repo_url").alias("path"), F.substring_index(F.regexp_replace(F.trim("repo_url"), r"/+$", ""), "/", -1).alias("raw_name"), text.repo_name("repo_url").alias("name"))


@query(r"""select seq, try_cast(nullif(regexp_extract(concat_ws(chr(10), title, message), '(?i)\b(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?)\s+#(\d+)\b', 1), '') as bigint) as issue, try_cast(nullif(regexp_extract(title, '\(#(\d+)\)', 1), '') as bigint) as merge, nullif(lower(regexp_extract(title, '^(\w+)(?:\([^)]*\))?!?:\s', 1)), '') as prefix from collected_events""")
def text_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_events").select("seq", text.issue_number("title", "message").alias("issue"), text.merge_number("title").alias("merge"), text.title_prefix("title").alias("prefix"))


@query("select prefix, type, count(*) as events from (select type, nullif(lower(regexp_extract(title, '^(\\w+)(?:\\([^)]*\\))?!?:\\s', 1)), '') as prefix from event_details) group by 1, 2".replace("\\\\", "\\"))
def events_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_details").groupBy(text.title_prefix("title").alias("prefix"), "type").agg(F.count("*").alias("events"))


@query("""select doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as escaped from documents""")
def text_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.html_escaped("text")).alias("escaped"))


@query("select type, count(*) as events, count(distinct library_id) as libraries from collected_events group by type")
def events_count_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collected_events").groupBy("type").agg(F.count("*").alias("events"), F.countDistinct("library_id").alias("libraries"))


@query("select function_id, snapshot_id, name from function_records where regexp_full_match(name, '.*_(open|close)_.*', 'i') and file_path like 'src/%'")
def functions_by_glob(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "function_records").where(F.col("name").rlike(text.glob_pattern("*_open_*")) | F.col("name").rlike(text.glob_pattern("*_close_*")))
    return f.where(F.col("file_path").rlike(text.glob_pattern("src/*")) & F.col("file_path").startswith("src/")).select("function_id", "snapshot_id", "name")


@query("select snapshot_id, language, count(*) as files, sum(functions) as functions, sum(line_count) as line_count from (select snapshot_id, file_path, max(language) as language, count(distinct function_id) as functions, cast(sum(end_line - start_line + 1) as bigint) as line_count from (select distinct snapshot_id, file_path, function_id, language, start_line, end_line from function_records where trim(file_path) <> '') group by 1, 2) group by 1, 2".replace("sum(functions)", "cast(sum(functions) as bigint)").replace("sum(line_count) as", "cast(sum(line_count) as bigint) as"))
def lang_profile(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "function_records").where("trim(file_path) <> ''").select("snapshot_id", "file_path", "function_id", "language", "start_line", "end_line").distinct()
    files = f.groupBy("snapshot_id", "file_path").agg(F.max("language").alias("language"), F.countDistinct("function_id").alias("functions"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("line_count"))
    return files.groupBy("snapshot_id", "language").agg(F.count("*").alias("files"), F.sum("functions").alias("functions"), F.sum("line_count").alias("line_count"))


# ---- call graphs ----
_FUNCTIONS = "f as (select distinct snapshot_id, name, coalesce(file_path, '') as file from function_records where snapshot_id is not null and name is not null)"
_RESOLVED = f"""{_FUNCTIONS}, k as (select snapshot_id, name, file as wanted, file from f where file <> '' union all select snapshot_id, name, '' as wanted, min(file) as file from f group by 1, 2),
x as (select e.edge_id, e.snapshot_id, e.caller, a.file as caller_file, e.callee, b.file as callee_file, e.call_type, e.confidence, e.source_backend as backend from call_edges e
join k a on a.snapshot_id = e.snapshot_id and a.name = e.caller and a.wanted = coalesce(trim(e.caller_file), '') join k b on b.snapshot_id = e.snapshot_id and b.name = e.callee and b.wanted = coalesce(trim(e.callee_file), '')),
c as (select snapshot_id, caller, caller_file, callee, callee_file, call_type, confidence, backend from (select *, row_number() over (partition by snapshot_id, caller, caller_file, callee, callee_file order by confidence desc nulls last, edge_id) as rn from x) where rn = 1)"""
_EDGES = f"{_RESOLVED}, e as (select snapshot_id as graph, caller || chr(31) || caller_file as src, callee || chr(31) || callee_file as dst, call_type from c)"
_STARTS = "s as (select distinct snapshot_id as graph, name || chr(31) || coalesce(file_path, '') as vertex from function_records where is_entry_point and snapshot_id is not null and name is not null)"
_REACH = f"{_EDGES}, {_STARTS}, r as (select graph, vertex, 0 as depth from s union select r.graph, e.dst, r.depth + 1 from r join e on e.graph = r.graph and e.src = r.vertex where r.depth < {HOPS}), m as (select graph, vertex, min(depth) as depth from r group by 1, 2)"


def _name(v: str, name: str = "name", file: str = "file") -> str:
    return f"split_part({v}, chr(31), 1) as {name}, split_part({v}, chr(31), 2) as {file}"


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return graph.resolved_edges(table(spark, d, "call_edges"), table(spark, d, "function_records"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.vertex_edges(_resolved(spark, d))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """The edges for a search, repeated ones too."""
    return graph.call_steps(table(spark, d, "call_edges"), table(spark, d, "function_records"))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """All entry points of all snapshots (graph, vertex)."""
    f = table(spark, d, "function_records").where("is_entry_point and snapshot_id is not null and name is not null")
    return f.select(F.col("snapshot_id").alias("graph"), graph.vertex("name", "file_path").alias("vertex")).distinct()


@query(f"with {_RESOLVED} select * from c")
def calls_resolved(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


_ASKED = "h as (select a.snapshot_id, a.name, count(f.file) as found, min(f.file) as first_file from a left join f on f.snapshot_id = a.snapshot_id and f.name = a.name group by 1, 2), g as (select *, case when found = 0 then 'missing' when found = 1 then 'found' else 'ambiguous' end as status from h)"


@query(f"with {_FUNCTIONS}, a as (select distinct snapshot_id, callee as name from call_edges where snapshot_id is not null and callee is not null), {_ASKED} select snapshot_id, name, found, first_file, status from g")
def functions_resolved(spark: SparkSession, d: str) -> DataFrame:
    """What each called name stands for without a file: one function, none, or several among which a file must choose."""
    asked = table(spark, d, "call_edges").where("snapshot_id is not null and callee is not null").select("snapshot_id", F.col("callee").alias("name"), F.lit(None).cast("string").alias("file"))
    return graph.asked_functions(table(spark, d, "function_records"), asked).select("snapshot_id", "name", "found", "first_file", "status")


@query(f"with {_RESOLVED}, a as (select distinct snapshot_id, name from function_records where is_entry_point and snapshot_id is not null and name is not null), {_ASKED} select c.snapshot_id, c.caller, c.callee as name, c.callee_file as file_path, c.call_type, c.callee_file = '' as is_external, c.confidence, c.backend from c join g on g.status = 'found' and g.snapshot_id = c.snapshot_id and g.name = c.caller and g.first_file = c.caller_file")
def calls_callees(spark: SparkSession, d: str) -> DataFrame:
    """What the entry points call, asked by name alone; ambiguous names have no answer."""
    f = table(spark, d, "function_records")
    asked = f.where("is_entry_point and snapshot_id is not null and name is not null").select("snapshot_id", "name", F.lit("").alias("file"))
    got = graph.callees(_resolved(spark, d), graph.asked_functions(f, asked))
    return got.select("snapshot_id", "caller", F.col("callee").alias("name"), F.col("callee_file").alias("file_path"), "call_type", (F.col("callee_file") == "").alias("is_external"), "confidence", "backend")


@query(f"with {_RESOLVED} select snapshot_id, callee, callee_file, caller as name, caller_file as file_path, call_type, caller_file = '' as is_external, confidence, backend from c")
def calls_callers(spark: SparkSession, d: str) -> DataFrame:
    """Who calls each function, asked by name and file."""
    f = table(spark, d, "function_records")
    asked = f.where("snapshot_id is not null and name is not null").select("snapshot_id", "name", F.coalesce("file_path", F.lit("")).alias("file"))
    answers = graph.asked_functions(f, asked).withColumn("first_file", F.col("file")).withColumn("status", F.lit("found"))  # a blank file is that of an external function here
    got = graph.callers(_resolved(spark, d), answers)
    return got.select("snapshot_id", "callee", "callee_file", F.col("caller").alias("name"), F.col("caller_file").alias("file_path"), "call_type", (F.col("caller_file") == "").alias("is_external"), "confidence", "backend")


@query(f"with recursive {_REACH} select graph, {_name('vertex')}, depth from m")
def graph_bfs_reaches(spark: SparkSession, d: str) -> DataFrame:
    """The least depth of every function from any entry point of its snapshot."""
    return graph.named(graph.reach(_steps(spark, d), _entries(spark, d), HOPS), "vertex", "name", "file")


@query(f"with recursive {_REACH.replace(f'r.depth < {HOPS}', 'r.depth < 3')} select e.graph, {_name('e.src', 'caller', 'caller_file')}, {_name('e.dst', 'callee', 'callee_file')}, e.call_type from e join m a on a.graph = e.graph and a.vertex = e.src join m b on b.graph = e.graph and b.vertex = e.dst")
def graph_subtree(spark: SparkSession, d: str) -> DataFrame:
    """The edges between the functions within three steps of the entry points."""
    e = _edges(spark, d)
    got = graph.induced(e, graph.reach(e, _entries(spark, d), 3))
    return graph.named(graph.named(got, "src", "caller", "caller_file"), "dst", "callee", "callee_file").select("graph", "caller", "caller_file", "callee", "callee_file", "call_type")


@query(f"with recursive {_REACH} select f.snapshot_id as graph, f.name, f.file from f left join m on m.graph = f.snapshot_id and m.vertex = f.name || chr(31) || f.file where trim(f.file) <> '' and m.vertex is null")
def graph_unreached(spark: SparkSession, d: str) -> DataFrame:
    """Functions with a source that no entry point of their snapshot reaches."""
    f = table(spark, d, "function_records").where("snapshot_id is not null and name is not null and trim(file_path) <> ''").select(F.col("snapshot_id").alias("graph"), graph.vertex("name", "file_path").alias("vertex")).distinct()
    return graph.named(f.join(graph.reach(_steps(spark, d), _entries(spark, d), HOPS), ["graph", "vertex"], "left_anti"), "vertex", "name", "file")


@query()
def graph_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """The first ten shortest paths, of at most ten steps, from each entry point to each function that a flaw's summary
    names, in the flaw's library."""
    snapshots = table(spark, d, "function_records").where("library_id is not null and snapshot_id is not null and name is not null").select("library_id", F.col("snapshot_id").alias("graph"), "name", "file_path").distinct()
    named = table(spark, d, "upstream_vulns").select("library_id", text.named_function("summary").alias("name")).where("name is not null").distinct()
    targets = snapshots.join(named, ["library_id", "name"]).select("graph", graph.vertex("name", "file_path").alias("vertex"))
    got = graph.paths_to(checkpointed(_edges(spark, d)), _entries(spark, d), targets)
    return got.withColumn("path", F.array_join(F.transform("path", lambda v: F.split_part(v, F.lit(graph.SEP), F.lit(1))), ">"))


@query(f"""with recursive {_EDGES}, {_STARTS}, t as (select graph, vertex as start, vertex, 0 as length, [vertex] as path, cast([] as varchar[]) as used from s
union all select t.graph, t.start, e.dst, t.length + 1, list_append(t.path, e.dst), list_append(t.used, t.vertex || '>' || e.dst) from t join e on e.graph = t.graph and e.src = t.vertex where t.length < 3 and not list_contains(t.used, t.vertex || '>' || e.dst)),
o as (select *, row_number() over (partition by graph, start, vertex order by length, path) as rn from t where length > 0)
select graph, {_name('start', 'start', 'start_file')}, {_name('vertex')}, length, md5(array_to_string(path, '>')) as path from o where rn <= 100""")
def graph_trails(spark: SparkSession, d: str) -> DataFrame:
    """The walks of up to three steps from the entry points, of each pair at most the 100 shortest; paths as digests."""
    got = graph.trails(_edges(spark, d), _entries(spark, d), 3).withColumn("path", F.md5(F.concat_ws(">", "path")))
    return graph.named(graph.named(got, "start", "start", "start_file"), "vertex", "name", "file").select("graph", "start", "start_file", "name", "file", "length", "path")


_ENTRIES = "s as (select distinct snapshot_id as graph, name || chr(31) || coalesce(file_path, '') as entry from function_records where is_entry_point and snapshot_id is not null and name is not null)"
_REACHED = f"{_EDGES}, {_ENTRIES}, r as (select graph, entry, entry as vertex, 0 as depth from s union select r.graph, r.entry, e.dst, r.depth + 1 from r join e on e.graph = r.graph and e.src = r.vertex where r.depth < {HOPS}), m as (select graph, entry, vertex, min(depth) as depth from r group by 1, 2, 3 having min(depth) > 0)"


def _reached(spark: SparkSession, d: str) -> DataFrame:
    """(graph, entry, vertex, depth) of every function that an entry point reaches."""
    return graph.reach(_steps(spark, d), _entries(spark, d).withColumn("entry", F.col("vertex")), HOPS, "entry").where("depth > 0")


@query(f"""with recursive {_REACHED}, v as (select snapshot_id as graph, count(*) as functions, count(*) filter (where trim(file) = '') as externals from f group by 1),
n as (select graph, count(*) as edges from e group by 1), q as (select graph, count(*) as fuzzers from s group by 1), y as (select graph, count(*) as reaches, round(avg(depth), 1) as avg_depth, max(depth) as max_depth from m group by 1),
u as (select f.snapshot_id as graph, count(*) as unreached from f where trim(f.file) <> '' and not exists (select 1 from s where s.graph = f.snapshot_id and s.entry = f.name || chr(31) || f.file) and not exists (select 1 from m where m.graph = f.snapshot_id and m.vertex = f.name || chr(31) || f.file) group by 1)
select v.graph, v.functions, v.externals, coalesce(n.edges, 0) as edges, coalesce(q.fuzzers, 0) as fuzzers, coalesce(y.reaches, 0) as reaches, coalesce(y.avg_depth, 0.0) as avg_depth, coalesce(y.max_depth, 0) as max_depth, coalesce(u.unreached, 0) as unreached, 1200 * v.functions + 150 * coalesce(n.edges, 0) as size_estimate
from v left join n on n.graph = v.graph left join q on q.graph = v.graph left join y on y.graph = v.graph left join u on u.graph = v.graph""")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each snapshot's graph, and the size in bytes that is booked for it where none is known."""
    f = table(spark, d, "function_records").where("snapshot_id is not null and name is not null").select(F.col("snapshot_id").alias("graph"), graph.vertex("name", "file_path").alias("vertex"), F.trim(F.coalesce("file_path", F.lit(""))).alias("file")).distinct()
    e, entries = checkpointed(_edges(spark, d)), _entries(spark, d)
    reached = checkpointed(graph.reach(e, entries.withColumn("entry", F.col("vertex")), HOPS, "entry"))
    count = lambda df, name, *more: df.groupBy("graph").agg(F.count("*").alias(name), *more)
    lone = f.where("file <> ''").select("graph", "vertex").distinct().join(reached, ["graph", "vertex"], "left_anti")
    got = count(f, "functions", F.count_if(F.col("file") == "").alias("externals"))
    for part in (count(e, "edges"), count(entries, "fuzzers"), count(reached.where("depth > 0"), "reaches", F.round(F.avg("depth"), 1).alias("avg_depth"), F.max("depth").alias("max_depth")), count(lone, "unreached")):
        got = got.join(part, "graph", "left")
    got = got.fillna(0, ["edges", "fuzzers", "reaches", "avg_depth", "max_depth", "unreached"])
    return got.select("graph", "functions", "externals", "edges", "fuzzers", "reaches", "avg_depth", "max_depth", "unreached", (1200 * F.col("functions") + 150 * F.col("edges")).alias("size_estimate"))


@query(f"""with {_RESOLVED}, z as (select distinct snapshot_id, name, coalesce(file_path, '') as file from function_records where is_entry_point and snapshot_id is not null and name is not null),
w as (select distinct z.snapshot_id, z.name as fuzzer, z.file as entry_file, e.callee from z join call_edges e on e.snapshot_id = z.snapshot_id and e.caller = z.name where e.callee is not null)
select w.snapshot_id, w.fuzzer, w.fuzzer as entry, w.entry_file, w.callee, k.file as callee_file, 'direct' as call_type, 1.0 as confidence, 'fuzzer_parser' as backend from w join k on k.snapshot_id = w.snapshot_id and k.name = w.callee and k.wanted = ''""".replace(" 1.0 as", " cast(1.0 as double) as"))
def fuzzer_edges(spark: SparkSession, d: str) -> DataFrame:
    """Entry points as fuzzers: the edges to the library functions that they name, whatever file those are in."""
    f = table(spark, d, "function_records")
    z = f.where("is_entry_point and snapshot_id is not null and name is not null").select("snapshot_id", F.col("name").alias("fuzzer"), F.coalesce("file_path", F.lit("")).alias("entry_file")).distinct()
    called = table(spark, d, "call_edges").where("callee is not null").groupBy("snapshot_id", F.col("caller").alias("fuzzer")).agg(F.collect_set("callee").alias("called"))  # a function's distinct calls
    return graph.entry_edges(z.join(called, ["snapshot_id", "fuzzer"]).withColumn("entry", F.col("fuzzer")), f)


@query("""select snapshot_id, file_path, name, coalesce(start_line, 0) as start_line, coalesce(end_line, 0) as end_line, coalesce(cyclomatic_complexity, 0) as cyclomatic_complexity, coalesce(return_type, '') as return_type, coalesce(language, '') as language, coalesce(len(parameters), 0) as parameters,
row_number() over (partition by snapshot_id, file_path order by start_line nulls first, name, function_id) as place from (select distinct function_id, snapshot_id, file_path, name, start_line, end_line, cyclomatic_complexity, return_type, language, parameters from function_records where snapshot_id is not null and trim(file_path) <> '')""")
def functions_by_file(spark: SparkSession, d: str) -> DataFrame:
    """The functions of each file in order of line, what a record doesn't say by its default."""
    f = table(spark, d, "function_records").where("snapshot_id is not null and trim(file_path) <> ''").select("function_id", "snapshot_id", "file_path", "name", "start_line", "end_line", "cyclomatic_complexity", "return_type", "language", "parameters").distinct()
    place = F.row_number().over(Window.partitionBy("snapshot_id", "file_path").orderBy(F.col("start_line").asc_nulls_first(), "name", "function_id"))
    f = f.withColumn("place", place).withColumn("parameters", F.greatest(F.size("parameters"), F.lit(0)))
    return f.fillna(0, ["start_line", "end_line", "cyclomatic_complexity", "parameters"]).fillna("", ["return_type", "language"]).drop("function_id")


@query("with f as (select snapshot_id, name, coalesce(file_path, '') as file, function_id, cyclomatic_complexity, row_number() over (partition by snapshot_id, name, coalesce(file_path, '') order by function_id desc) as rn from function_records where snapshot_id is not null), x as (select distinct snapshot_id, name, coalesce(file_path, '') as file from function_records where is_entry_point) select f.snapshot_id, f.name, f.file, f.function_id, f.cyclomatic_complexity, x.name is not null as is_entry_point from f left join x on x.snapshot_id = f.snapshot_id and x.name = f.name and x.file = f.file where rn = 1")
def functions_last_write(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "function_records").where("snapshot_id is not null").select("snapshot_id", "name", F.coalesce("file_path", F.lit("")).alias("file"), "function_id", "cyclomatic_complexity", F.coalesce("is_entry_point", F.lit(False)).alias("is_entry_point"))
    return merge.last_write_wins(f, ["snapshot_id", "name", "file"], "function_id", ["is_entry_point"])


@query("with e as (select distinct snapshot_id as graph, caller as src, callee as dst from call_edges where snapshot_id is not null and trim(caller) <> '' and trim(callee) <> '' and caller <> callee), i as (select distinct snapshot_id as graph, caller as src, callee as dst from call_edges where call_type = 'direct') select e.graph, e.src as caller, e.dst as callee, case when i.src is not null then 'direct' else 'fptr' end as call_type from e left join i on i.graph = e.graph and i.src = e.src and i.dst = e.dst")
def dot_typed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot's graph is written as DOT and read back, the final one and that of its direct calls."""
    rows = table(spark, d, "call_edges")
    named = lambda e: graph.plain_edges(e).select("graph", F.col("src").alias("caller"), F.col("dst").alias("callee"))
    read = lambda e: dot.dot_edges(dot.dot_text(named(e), "graph"), "graph", "text")
    return dot.typed_edges(read(rows), read(rows.where("call_type = 'direct'")), "graph")


@query("select project_id, concat('lib', cast(library_id as varchar)) as library_name, concat('==', cast(resolved_version as varchar)) as constraint_expr, cast(resolved_version as varchar) as resolved_version from p_deps")
def manifest_pip(spark: SparkSession, d: str) -> DataFrame:
    """Each project's dependencies are written as a requirements file and read back."""
    line = F.concat(F.lit("lib"), F.col("library_id").cast("string"), F.lit("=="), F.col("resolved_version").cast("string"))
    files = relational.in_chunks(view(spark, d, "p_deps"), ["project_id"], ["library_id"]).groupBy("project_id", "chunk").agg(F.concat_ws("\n", F.lit("# pinned"), F.collect_list(line)).alias("content"))
    got = manifests.dependencies(files.select(F.concat_ws("/", "project_id", "chunk", F.lit("requirements.txt")).alias("path"), "content"))
    return got.select(F.substring_index("path", "/", 1).cast("bigint").alias("project_id"), "library_name", "constraint_expr", "resolved_version")


@query("select project_id, concat('github.com/org/lib', cast(library_id as varchar)) as library_name, concat('https://github.com/org/lib', cast(library_id as varchar)) as library_repo_url, cast(resolved_version as varchar) as resolved_version from p_deps where constraint_source = 'go.mod'")
def manifest_go(spark: SparkSession, d: str) -> DataFrame:
    """Each project's scanned dependencies are written as a go.mod and read back; manual ones are marked indirect."""
    line = F.concat(F.lit("\tgithub.com/org/lib"), F.col("library_id").cast("string"), F.lit(" v"), F.col("resolved_version").cast("string"), F.when(F.col("constraint_source") == "manual", " // indirect").otherwise(""))
    files = relational.in_chunks(view(spark, d, "p_deps"), ["project_id"], ["library_id"]).groupBy("project_id", "chunk").agg(F.concat(F.lit("module x\n\nrequire (\n"), F.concat_ws("\n", F.collect_list(line)), F.lit("\n)\n")).alias("content"))
    got = manifests.dependencies(files.select(F.concat_ws("/", "project_id", "chunk", F.lit("go.mod")).alias("path"), "content"))
    return got.select(F.substring_index("path", "/", 1).cast("bigint").alias("project_id"), "library_name", "library_repo_url", "resolved_version")


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
