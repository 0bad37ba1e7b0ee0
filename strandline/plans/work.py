"""Further queries: collection in parts, classes that are written back, pages, evictions, backends, ends of bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import graph, merge, relational
from strandline.plans.code import BACKENDS
from strandline.plans.records import _rule_sql
from strandline.plans.registry import Registry
from strandline.sources import debug_info, dot
from strandline.sources.tables import table

query = Registry()
PARTS = {"commit": "commits", "pr_merge": "prs", "tag": "tags", "bug_issue": "issues"}


# ---- what is polled ----
@query("select id, project_id, created_at from (select id, min(project_id) as project_id, min(created_at) as created_at from client_impacts where pipeline_status = 'verified' and status = 'recorded' group by id) order by created_at nulls first, id nulls first limit 20")
def impacts_unnotified(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 20 impacts that are verified and not yet told: a poll, so the limit is the feature."""
    rows = table(spark, d, "client_impacts").where("pipeline_status = 'verified' and status = 'recorded'")
    return rows.groupBy("id").agg(F.min("project_id").alias("project_id"), F.min("created_at").alias("created_at")).orderBy("created_at", "id").limit(20)


@query("select id, severity, published_at from (select u.id, min(u.severity) as severity, min(u.published_at) as published_at from upstream_vulns u where u.id is not null and status = 'published' and not exists (select 1 from client_impacts c where c.upstream_vuln_id = u.id) group by u.id) order by published_at nulls first, id limit 20")
def vulns_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The 20 oldest published vulnerabilities that no project has an impact of: a poll, so the limit is the feature."""
    u = table(spark, d, "upstream_vulns").where("id is not null and status = 'published'")
    open_ = relational.waiting(u, table(spark, d, "client_impacts"), None, ("id", "upstream_vuln_id"))
    return open_.groupBy("id").agg(F.min("severity").alias("severity"), F.min("published_at").alias("published_at")).orderBy(F.col("published_at").asc_nulls_first(), "id").limit(20)


# ---- collection in parts ----
_LABEL = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in PARTS.items()) + " end"


@query(f"""with p as (select {_LABEL} as part, count(*) as n from collected_events where library_id is not null group by 1 union all select 'advisories', count(*) from upstream_vulns where library_id is not null),
x as (select regexp_extract(e, 'collect_(\\w+) failed', 1) as part, count(*) as errors from (select unnest(errors) as e from (select distinct run_id, errors from collect_results)) group by 1)
select p.part, p.n as events, coalesce(x.errors, 0) as errors from p left join x on x.part = p.part where p.part is not null""")
def events_by_part(spark: SparkSession, d: str) -> DataFrame:
    """The five parts of a collection as one bag, with what failed in each; a part that fails adds an error and no rows."""
    c = table(spark, d, "collected_events").where("library_id is not null")
    parts = {label: c.where(F.col("type") == kind).select("library_id") for kind, label in PARTS.items()}
    parts["advisories"] = table(spark, d, "upstream_vulns").where("library_id is not null").select("library_id")
    rows, _ = merge.union_of_parts({k: lambda p=p: p for k, p in parts.items()})
    said = table(spark, d, "collect_results").select("run_id", "errors").distinct().select(F.explode("errors").alias("e"))
    errors = said.groupBy(F.regexp_extract("e", r"collect_(\w+) failed", 1).alias("part")).agg(F.count("*").alias("errors"))
    return rows.groupBy("part").agg(F.count("*").alias("events")).join(errors, "part", "left").fillna(0, ["errors"])


@query("select seq, library_id, ref from collected_events where type = 'bug_issue' and not coalesce(source_url like '%/pull/%', false)")
def issues_without_merges(spark: SparkSession, d: str) -> DataFrame:
    """Issues, without the merge requests that are listed among them."""
    return table(spark, d, "collected_events").where("type = 'bug_issue' and not coalesce(source_url like '%/pull/%', false)").select("seq", "library_id", "ref")


@query("""with n as (select library_id, type, max(event_at) as newest from collected_events where event_at is not null and library_id is not null group by 1, 2),
r as (select c.seq, row_number() over (partition by c.library_id, c.type order by c.event_at desc, c.seq desc) as place from collected_events c join n on n.library_id = c.library_id and n.type = c.type where c.event_at >= n.newest - interval 30 day)
select seq from r where place <= 300""")
def events_first_lookback(spark: SparkSession, d: str) -> DataFrame:
    """What the first run of a library takes up: 30 days back, at most three pages of 100 of each type."""
    rows = table(spark, d, "collected_events").where("event_at is not null and library_id is not null and type is not null")
    return relational.looked_back(rows, ["library_id", "type"], "event_at", "seq", 30, 300).select("seq")


# ---- classes ----
@query(f"""with l as (select * from (select *, row_number() over (partition by id order by created_at desc nulls last) as rn from event_details where id is not null) where rn = 1),
r as (select id, {_rule_sql(0)} as rule, cast({_rule_sql(1)} as double) as sure, classification, confidence from l),
c as (select id, coalesce(rule, classification, 'other') as classification, case when rule is not null then sure when classification is not null then confidence else 0.3 end as confidence from r)
select id, classification, confidence, classification = 'security_bugfix' as is_bugfix from c""")
def events_reclassified(spark: SparkSession, d: str) -> DataFrame:
    """Each event's class by the rules, else the scorer's, else "other" at 0.3; the flag follows from the class."""
    rows = relational.newest_per_key(table(spark, d, "event_details").where("id is not null"), ["id"], "created_at", 1, "id")
    rule = text.rule_class("type", "author", "title", "message")
    got = rows.select("id", rule.alias("r"), "classification", "confidence")
    sure = F.when(F.col("r").isNotNull(), F.col("r.confidence")).when(F.col("classification").isNotNull(), F.col("confidence")).otherwise(F.lit(0.3))
    got = got.select("id", F.coalesce("r.classification", "classification", F.lit("other")).alias("classification"), sure.alias("confidence"))
    return got.withColumn("is_bugfix", F.col("classification") == "security_bugfix")


# ---- pages ----
@query("select total, pages as total_pages, 1 < pages - 1 as has_more from (select count(*) as total, cast(ceil(count(*) / 20.0) as bigint) as pages from libraries)")
def libraries_page_meta(spark: SparkSession, d: str) -> DataFrame:
    """What goes with page 1 (from 0) of 20 libraries."""
    return relational.page_meta(table(spark, d, "libraries"), 1, 20)


@query(r"""with t as (select library_id, min(lower(regexp_extract(source_url, '^(https://[^/]+/[^/]+/[^/]+)/', 1))) as told from event_details where regexp_matches(source_url, '^https://[^/]+/[^/]+/[^/]+/') group by 1)
select l.id, case when t.told is null then 'unknown' when t.told <> lower(regexp_replace(regexp_replace(trim(l.repo_url), '/+$', ''), '\.git$', '')) then 'redirects' else 'same' end as note from libraries l left join t on t.library_id = l.id""")
def libraries_moved(spark: SparkSession, d: str) -> DataFrame:
    """Whether events of a library come from the repository that is registered for it, whatever its case."""
    told = table(spark, d, "event_details").where(F.col("source_url").rlike(r"^https://[^/]+/[^/]+/[^/]+/")).groupBy(F.col("library_id").alias("id")).agg(F.min(F.lower(F.regexp_extract("source_url", r"^(https://[^/]+/[^/]+/[^/]+)/", 1))).alias("told"))
    rows = table(spark, d, "libraries").select("id", "repo_url").join(told, "id", "left")
    return rows.select("id", F.coalesce(text.moved("repo_url", "told"), F.lit("unknown")).alias("note"))


# ---- snapshots ----
@query("""with s as (select library_id, snapshot_id, max(function_id) as newest from function_records where library_id is not null and snapshot_id is not null group by 1, 2),
g as (select snapshot_id from (select snapshot_id, row_number() over (partition by library_id order by newest desc, snapshot_id) as place from s) where place > 2)
select 'snapshots' as table_name, count(*) as kept from s where snapshot_id not in (select snapshot_id from g) union all select 'functions', count(*) from function_records where snapshot_id is null or snapshot_id not in (select snapshot_id from g)
union all select 'edges', count(*) from call_edges where snapshot_id is null or snapshot_id not in (select snapshot_id from g)""")
def snapshots_evicted(spark: SparkSession, d: str) -> DataFrame:
    """What stays when each library keeps its two newest snapshots, and functions and edges go with the others."""
    f, e = table(spark, d, "function_records"), table(spark, d, "call_edges").select("snapshot_id")
    s = f.where("library_id is not null and snapshot_id is not null").groupBy("library_id", "snapshot_id").agg(F.max("function_id").alias("newest"))
    place = F.row_number().over(Window.partitionBy("library_id").orderBy(F.desc("newest"), "snapshot_id"))
    gone = s.withColumn("place", place).where("place > 2").select("snapshot_id")
    left = merge.delete_cascade(gone, {"snapshots": (s, "snapshot_id", None, None), "functions": (f.select("snapshot_id"), "snapshot_id", "snapshots", "snapshot_id"), "edges": (e, "snapshot_id", "snapshots", "snapshot_id")}, "snapshot_id")
    counts = [left[n].agg(F.lit(n).alias("table_name"), F.count("*").alias("kept")) for n in ("snapshots", "functions", "edges")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


_RANK = "case source_backend " + " ".join(f"when '{b}' then {i}" for i, b in enumerate(BACKENDS, 1)) + f" else {len(BACKENDS) + 1} end"


@query(f"select language, arg_min(source_backend, ({_RANK}, source_backend)) as backend, count(distinct source_backend) as backends, count(*) as records from function_records where language <> '' and source_backend is not null group by 1")
def backend_by_language(spark: SparkSession, d: str) -> DataFrame:
    """The most precise backend that knows a language."""
    f = table(spark, d, "function_records").where("language <> '' and source_backend is not null")
    rank = F.coalesce(F.nullif(F.array_position(F.lit(BACKENDS), F.col("source_backend")), F.lit(0)), F.lit(len(BACKENDS) + 1))
    per = f.groupBy("language", "source_backend").agg(F.count("*").alias("n"))
    return per.groupBy("language").agg(F.min_by("source_backend", F.struct(rank, "source_backend")).alias("backend"), F.count("*").alias("backends"), F.sum("n").alias("records"))


# ---- sources ----
@query()
def source_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where the body of each C and C++ function ends by its braces, and whether the record says the same."""
    f = table(spark, d, "function_records").where("snapshot_id is not null and content <> '' and language in ('c', 'cpp')")
    f = f.select("snapshot_id", "file_path", "name", "start_line", "end_line", "content").distinct()
    lines = text.body_lines("content")
    return f.select("snapshot_id", "file_path", "name", "start_line", (F.col("start_line") + lines - 1).alias("end_by_braces"), "end_line")


@query("select ecosystem, collect_status, count(*) as libraries from libraries where name is not null group by 1, 2")
def libraries_asked(spark: SparkSession, d: str) -> DataFrame:
    """A question in SQL that may only read."""
    return relational.read_only(spark, "select ecosystem, collect_status, count(*) as libraries from {libraries} where name is not null group by 1, 2", libraries=table(spark, d, "libraries"))


@query("""select snapshot_id, name, start_line, md5(array_to_string(list_slice(string_split(content, chr(10)), 1, end_line - start_line + 1), chr(10))) as source
from (select distinct snapshot_id, file_path, name, start_line, end_line, content from function_records where content <> '' and snapshot_id is not null and end_line >= start_line)""")
def source_slices(spark: SparkSession, d: str) -> DataFrame:
    """The lines that each record claims for its function, cut from its text."""
    f = table(spark, d, "function_records").where("content <> '' and snapshot_id is not null and end_line >= start_line")
    f = f.select("snapshot_id", "file_path", "name", "start_line", "end_line", "content").distinct()
    return f.select("snapshot_id", "name", "start_line", F.md5(text.line_slice("content", F.lit(1), F.col("end_line") - F.col("start_line") + 1)).alias("source"))


@query("""with f as (select distinct snapshot_id, name, file_path, start_line, function_id from function_records where snapshot_id is not null and trim(file_path) <> '' and name <> ''),
u as (select snapshot_id, name, file_path, start_line, function_id from f union all select snapshot_id, concat('_Z', cast(length(name) as varchar), name, 'v'), file_path, start_line, function_id from f),
l as (select * from (select *, row_number() over (partition by snapshot_id, name order by function_id desc, file_path desc, start_line desc nulls last) as rn from u) where rn = 1),
a as (select distinct snapshot_id, callee as name from call_edges where snapshot_id is not null and callee <> '' union select distinct snapshot_id, concat('_Z', cast(length(caller) as varchar), caller, 'v') from call_edges where snapshot_id is not null and caller <> '')
select a.snapshot_id, a.name, l.file_path, l.start_line, l.name is null as is_external from a left join l on l.snapshot_id = a.snapshot_id and l.name = a.name""")
def functions_debugged(spark: SparkSession, d: str) -> DataFrame:
    """Called functions by their names in the source and callers by those in the module, with the last debug record of each."""
    f = table(spark, d, "function_records").where("snapshot_id is not null and trim(file_path) <> '' and name <> ''").select("snapshot_id", "name", "file_path", "start_line", "function_id").distinct()
    mangled = lambda c: F.concat(F.lit("_Z"), F.length(c).cast("string"), F.col(c), F.lit("v"))
    metas = f.select("snapshot_id", mangled("name").alias("ir_name"), F.col("name").alias("original_name"), "file_path", "start_line", F.struct("function_id", "file_path", "start_line").alias("ordinal"))
    e = table(spark, d, "call_edges").where("snapshot_id is not null")
    asked = e.where("callee <> ''").select("snapshot_id", F.col("callee").alias("name")).unionByName(e.where("caller <> ''").select("snapshot_id", mangled("caller").alias("name"))).distinct()
    return debug_info.with_debug(asked, metas, "snapshot_id", "ordinal")


@query("with x as (select snapshot_id, caller, callee from call_edges where snapshot_id is not null and trim(caller) <> '' and trim(callee) <> '' and caller <> callee) select snapshot_id, caller as name from x union select snapshot_id, callee from x")
def dot_function_names(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot's graph is written as DOT and the names of its functions are read back."""
    e = graph.plain_edges(table(spark, d, "call_edges")).select(F.col("graph").alias("snapshot_id"), F.col("src").alias("caller"), F.col("dst").alias("callee"))
    return dot.dot_names(dot.dot_text(e, "snapshot_id"), "snapshot_id", "text")


# ---- lists and patches ----
@query("select id, name, ecosystem, repo_url from libraries order by name, id")
def libraries_in_order(spark: SparkSession, d: str) -> DataFrame:
    """All libraries in order of name."""
    return table(spark, d, "libraries").select("id", "name", "ecosystem", "repo_url").orderBy("name", "id")


@query("select snapshot_id, name, string_agg(distinct file_path, ',' order by file_path) as files, count(distinct file_path) as file_count from function_records where is_entry_point and snapshot_id is not null and name is not null and trim(file_path) <> '' group by 1, 2")
def fuzzers_listed(spark: SparkSession, d: str) -> DataFrame:
    """The entry points of each snapshot, standing for fuzzers, with their files, in order of name."""
    f = table(spark, d, "function_records").where("is_entry_point and snapshot_id is not null and name is not null and trim(file_path) <> ''").select("snapshot_id", "name", "file_path").distinct()
    got = f.groupBy("snapshot_id", "name").agg(F.array_sort(F.collect_list("file_path")).alias("files"))  # the files of one name in one snapshot
    return got.select("snapshot_id", "name", F.array_join("files", ",").alias("files"), F.size("files").cast("bigint").alias("file_count")).orderBy("snapshot_id", "name")


@query("""with s as (select distinct library_id, snapshot_id from function_records where library_id is not null and snapshot_id is not null and source_backend = 'svf'),
r as (select library_id, max(started_at) as last_accessed from collect_results group by 1)
select s.snapshot_id, s.library_id, r.last_accessed from s left join r on r.library_id = s.library_id order by r.last_accessed desc nulls last, s.snapshot_id""")
def snapshots_listed(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of one backend, those of the libraries that were visited last first."""
    s = table(spark, d, "function_records").where("library_id is not null and snapshot_id is not null and source_backend = 'svf'").select("library_id", "snapshot_id").distinct()
    r = table(spark, d, "collect_results").groupBy("library_id").agg(F.max("started_at").alias("last_accessed"))
    return s.join(r, "library_id", "left").select("snapshot_id", "library_id", "last_accessed").orderBy(F.desc_nulls_last("last_accessed"), "snapshot_id")


@query("""with c as (select project_id, version_used, is_affected, row_number() over (partition by project_id order by created_at desc, id desc, coalesce(version_used, '') desc, coalesce(is_affected, false) desc) as rn from client_impacts where project_id is not null and id is not null and created_at is not null),
o as (select distinct id, organization, default_branch, current_version from projects where id is not null)
select o.id, case when c.is_affected then null else o.organization end as organization, o.default_branch, coalesce(c.version_used, o.current_version) as current_version from o left join c on c.project_id = o.id and c.rn = 1""")
def projects_patched(spark: SparkSession, d: str) -> DataFrame:
    """Projects after a patch of each from its newest impact: the version, and for affected ones the organization is emptied
    and the branch, which can't be emptied, stays."""
    c = table(spark, d, "client_impacts").where("project_id is not null and id is not null and created_at is not null")
    order = F.struct("created_at", "id", F.coalesce("version_used", F.lit("")), F.coalesce("is_affected", F.lit(False)))
    c = c.groupBy(F.col("project_id").alias("id")).agg(F.max_by(F.struct("version_used", "is_affected"), order).alias("r")).select("id", "r.*")
    none = F.lit(None).cast("string")
    fields = F.when(F.col("is_affected"), F.array(*map(F.lit, ("current_version", "organization", "default_branch")))).otherwise(F.array(F.lit("current_version")))
    patches = c.select("id", F.col("version_used").alias("current_version"), none.alias("organization"), none.alias("default_branch"), fields.alias("fields"))
    old = table(spark, d, "projects").where("id is not null").select("id", "organization", "default_branch", "current_version").distinct()
    return merge.patched(old, patches, ["id"], ["organization"])


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
