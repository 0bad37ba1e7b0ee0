"""Views of the star schema as the platform's dependency, event and impact tables.

Every view is of whole tables. The text is plain SQL for Spark and for DuckDB alike; ``with_views`` puts the views a query needs before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "p_libraries": "select s_suppkey as id, s_name as name, concat('https://github.com/org', cast(s_nationkey as string), '/', s_name) as repo_url, concat('eco', cast(s_nationkey % 6 as string)) as ecosystem, case when s_acctbal < 0 then 'unhealthy' else 'healthy' end as collect_status from supplier",
    "p_projects": "select c_custkey as id, c_name as name, c_mktsegment as organization, c_custkey % 3 <> 0 as auto_sync_deps from customer",
    "p_deps": "select o_custkey as project_id, l_suppkey as library_id, case when max(l_linenumber) = 1 then 'manual' else 'go.mod' end as constraint_source, cast(min(l_quantity) as int) as resolved_version, min(o_orderdate) as first_seen, max(o_orderdate) as last_seen from orders join lineitem on l_orderkey = o_orderkey group by o_custkey, l_suppkey",
    "p_events": "select event_id as id, user_id as library_id, case event_type when 'click' then 'commit' when 'view' then 'pr_merge' when 'purchase' then 'tag' else 'bug_issue' end as type, ts as created_at, case when value < 5 then null when event_type = 'error' then 'security_bugfix' when event_type = 'signup' then 'normal_bugfix' else 'other' end as classification, event_type = 'error' and value >= 5 as is_bugfix from events",
    "p_upstream": "select id, id as event_id, library_id, case id % 8 when 0 then 'critical' when 2 then 'high' when 4 then 'medium' else 'low' end as severity, case when id % 5 = 0 then 'analyzing' else 'published' end as status, created_at as published_at from p_events where is_bugfix",
    "p_client": "select u.id as upstream_vuln_id, d.project_id, u.id * 1000000 + d.project_id as id, case (u.id + d.project_id) % 6 when 0 then 'recorded' when 1 then 'reported' when 2 then 'confirmed' when 3 then 'fixed' when 4 then 'not_affect' else null end as status, u.published_at as created_at from p_upstream u join p_deps d on d.library_id = u.library_id where u.status = 'published' and u.severity <> 'low'",
}


def with_views(sql: str) -> str:
    """The query behind a WITH clause of the views it names, in order."""
    need: set[str] = set()

    def add(text: str) -> None:
        for v in set(re.findall(r"\bp_\w+", text)) & VIEWS.keys() - need:
            need.add(v)
            add(VIEWS[v])

    add(sql)
    if not need:
        return sql
    views = ", ".join(f"{v} as ({VIEWS[v]})" for v in VIEWS if v in need)
    body = sql.strip()
    return f"with {views}, {body[5:]}" if body[:5].lower() == "with " else f"with {views} {body}"


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the views as a DataFrame over the tables of a folder."""
    sql = with_views(f"select * from {name}")
    tables = {t: spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "customer", "orders", "lineitem", "events") if re.search(rf"\b(?:from|join) {t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)
