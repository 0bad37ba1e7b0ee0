"""Further queries on code: call graphs of several analyses, reachability of flaws, calls in sources, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import graph, relational
from strandline.plans.proxies import view
from strandline.plans.reference import _ENTRIES, _EDGES, _REACHED, HOPS, _entries, _name, _reached, _steps
from strandline.plans.registry import Registry
from strandline.session import checkpointed
from strandline.sources import debug_info, manifests
from strandline.sources.tables import table

query = Registry()
BACKENDS = ["svf", "joern", "introspector", "prebuild"]  # from the most precise on


@query("""with o as (select snapshot_id, caller, callee, source_backend, max(confidence) as confidence, min(call_type) as call_type from call_edges where snapshot_id is not null and caller is not null and callee is not null and source_backend is not null group by 1, 2, 3, 4)
select snapshot_id, caller, callee, string_agg(source_backend, '+' order by source_backend) as backends, arg_min(call_type, case source_backend when 'svf' then 1 when 'joern' then 2 when 'introspector' then 3 when 'prebuild' then 4 else 5 end) as call_type,
least(1.0, min(confidence) + case count(*) when 1 then 0.0 when 2 then 0.1 else 0.2 end) as confidence from o group by 1, 2, 3""")
def calls_merged_backends(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "call_edges").where("snapshot_id is not null and caller is not null and callee is not null and source_backend is not null")
    return graph.merged_backends(e, ["snapshot_id", "caller", "callee"], "source_backend", BACKENDS)


@query("select snapshot_id, count(*) as edges, count(*) filter (where call_type = 'fptr') as fptr, count(distinct caller) as callers, count(distinct callee) as callees from (select distinct snapshot_id, caller, callee, call_type from call_edges) group by 1")
def calls_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "call_edges").select("snapshot_id", "caller", "callee", "call_type").distinct()
    per = e.groupBy("snapshot_id", "callee").agg(F.count("*").alias("n"), F.count_if(F.col("call_type") == "fptr").alias("f"))
    ends = per.groupBy("snapshot_id").agg(F.sum("n").alias("edges"), F.sum("f").alias("fptr"), F.count("callee").alias("callees"))
    callers = e.where("caller is not null").select("snapshot_id", "caller").distinct().groupBy(F.coalesce("snapshot_id", F.lit("\0")).alias("k")).agg(F.count("*").alias("callers"))
    got = ends.withColumn("k", F.coalesce("snapshot_id", F.lit("\0"))).join(callers, "k", "left")
    return got.select("snapshot_id", "edges", "fptr", F.coalesce("callers", F.lit(0)).cast("bigint").alias("callers"), "callees")


@query("select library_id, arg_min(snapshot_id, (rank, snapshot_id)) as snapshot_id, min(rank) as rank from (select library_id, snapshot_id, case source_backend when 'svf' then 1 when 'joern' then 2 when 'introspector' then 3 when 'prebuild' then 4 else 5 end as rank from function_records where library_id is not null and snapshot_id is not null) group by 1")
def snapshot_preferred(spark: SparkSession, d: str) -> DataFrame:
    """Each library's snapshot of the most precise backend."""
    f = table(spark, d, "function_records").where("library_id is not null and snapshot_id is not null")
    rank = F.coalesce(F.nullif(F.array_position(F.lit(BACKENDS), F.col("source_backend")), F.lit(0)), F.lit(len(BACKENDS) + 1)).cast("int")
    return f.select("library_id", "snapshot_id", rank.alias("rank")).groupBy("library_id").agg(F.min_by("snapshot_id", F.struct("rank", "snapshot_id")).alias("snapshot_id"), F.min("rank").alias("rank"))


@query("select snapshot_id, name, count(distinct file_path) as files, min(file_path) as first_file from function_records where trim(file_path) <> '' group by 1, 2 having count(distinct file_path) > 1")
def functions_ambiguous(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "function_records").where("trim(file_path) <> ''").groupBy("snapshot_id", "name")
    return f.agg(F.countDistinct("file_path").alias("files"), F.min("file_path").alias("first_file")).where("files > 1")


@query("select distinct snapshot_id, name from function_records where trim(coalesce(file_path, '')) = ''")
def functions_external(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "function_records").where("trim(coalesce(file_path, '')) = ''").select("snapshot_id", "name").distinct()


# Languages by a file's ending.
LANGUAGES = {"c": (".c", ".h"), "cpp": (".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"), "go": (".go",), "python": (".py",), "javascript": (".js",), "java": (".java",), "rust": (".rs",)}
_LANG = "case " + " ".join(f"when ext in ({', '.join(map(repr, e))}) then '{n}'" for n, e in LANGUAGES.items()) + " end"


@query(rf"""with f as (select distinct snapshot_id, file_path, lower(regexp_extract(file_path, '\.[^./]*$')) as ext from function_records where trim(file_path) <> ''),
n as (select snapshot_id, {_LANG} as language, ext, count(*) as files from f group by 1, 2, 3 having {_LANG} is not null),
s as (select snapshot_id, sum(files) filter (where ext in ('.cc', '.cpp', '.cxx')) > coalesce(sum(files) filter (where ext = '.c'), 0) as mostly_cpp from n group by 1),
m as (select n.snapshot_id, case when ext = '.h' and mostly_cpp then 'cpp' else language end as language, sum(files) as files from n join s on s.snapshot_id = n.snapshot_id group by 1, 2)
select snapshot_id, arg_max(language, (files, language)) as language, cast(max(files) as bigint) as files, cast(sum(files) as bigint) as all_files from m group by 1""")
def lang_primary(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot's main language by files; headers count as C++ where C++ sources outnumber those in C."""
    ext = F.lower(F.regexp_extract("file_path", r"\.[^./]*$", 0))
    language = F.lit(None).cast("string")
    for name, ends in LANGUAGES.items():
        language = F.when(F.col("ext").isin(*ends), name).otherwise(language)
    f = table(spark, d, "function_records").where("trim(file_path) <> '' and snapshot_id is not null").select("snapshot_id", "file_path", ext.alias("ext")).distinct().withColumn("language", language).where("language is not null")
    n = f.groupBy("snapshot_id", "language", "ext").agg(F.count("*").alias("files"))
    sums = n.groupBy("snapshot_id").agg((F.sum(F.when(F.col("ext").isin(".cc", ".cpp", ".cxx"), F.col("files"))) > F.coalesce(F.sum(F.when(F.col("ext") == ".c", F.col("files"))), F.lit(0))).alias("mostly_cpp"))
    m = n.join(sums, "snapshot_id").groupBy("snapshot_id", F.when((F.col("ext") == ".h") & F.col("mostly_cpp"), "cpp").otherwise(F.col("language")).alias("language")).agg(F.sum("files").alias("files"))
    return m.groupBy("snapshot_id").agg(F.max_by("language", F.struct("files", "language")).alias("language"), F.max("files").alias("files"), F.sum("files").alias("all_files"))


# ---- searches from each entry point ----
@query(f"with recursive {_REACHED} select graph, {_name('entry', 'entry', 'entry_file')}, {_name('vertex')}, depth from m")
def graph_entry_reaches(spark: SparkSession, d: str) -> DataFrame:
    """Least depth from every entry point of a snapshot to every function, all searches in the same steps."""
    return graph.named(graph.named(_reached(spark, d), "entry", "entry", "entry_file"), "vertex", "name", "file")


@query(rf"""with recursive {_REACHED}, v as (select id, min(library_id) as library_id, nullif(regexp_extract(min(summary), '(?:before|in|when) ([A-Za-z_]\w*[A-Z_]\w*)', 1), '') as target from upstream_vulns where id is not null group by 1),
n as (select distinct library_id, snapshot_id as graph from function_records where library_id is not null and snapshot_id is not null),
h as (select v.id, min((split_part(m.entry, chr(31), 1), m.depth)) as hit from v join n on n.library_id = v.library_id join m on m.graph = n.graph and split_part(m.vertex, chr(31), 1) = v.target group by 1),
b as (select distinct snapshot_id as graph, name || chr(31) || coalesce(file_path, '') as vertex, 0 as depth from function_records where name = 'main' and snapshot_id is not null),
w as (select * from b union select w.graph, e.dst, w.depth + 1 from w join e on e.graph = w.graph and e.src = w.vertex where w.depth < 10),
p as (select v.id, min(w.depth) as length from v join n on n.library_id = v.library_id join w on w.graph = n.graph and split_part(w.vertex, chr(31), 1) = v.target where w.depth > 0 group by 1)
select v.id, v.target, case when v.target is null then 'no_affected_functions' when not exists (select 1 from n where n.library_id = v.library_id) then 'library_snapshot_not_found' when h.id is not null then 'entry_reaches' when p.id is not null then 'shortest_path' else 'exhausted' end as strategy,
coalesce(h.hit[1], case when p.id is not null then 'main' end) as entry, cast(coalesce(h.hit[2], p.length) as int) as depth from v left join h on h.id = v.id left join p on p.id = v.id""")
def reachability_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether the function that a vulnerability's summary names can be reached from an entry point of its library.

    One search against the calls, from all named functions, decides all vulnerabilities: the first entry point by name that
    reaches the function, in any snapshot. Where none does, the shortest path from a function named main decides, of at
    most 10 steps.
    """
    v = table(spark, d, "upstream_vulns").where("id is not null").groupBy("id").agg(F.min("library_id").alias("library_id"), text.named_function(F.min("summary")).alias("target"))
    f = table(spark, d, "function_records").where("snapshot_id is not null and name is not null").select("library_id", F.col("snapshot_id").alias("graph"), "name", graph.vertex("name", "file_path").alias("vertex"), "is_entry_point").distinct()
    snapshots = f.where("library_id is not null").select("library_id", "graph").distinct()
    aims = v.where("target is not null").select("library_id", "target").distinct().join(snapshots, "library_id").join(f.select("graph", F.col("name").alias("target"), F.col("vertex").alias("aim")).distinct(), ["graph", "target"])
    aims = checkpointed(aims)
    back = graph.reach(graph.reversed_edges(_steps(spark, d)), aims.select("graph", "aim", F.col("aim").alias("vertex")), HOPS, "aim").where("depth > 0")
    ends = f.where("is_entry_point or name = 'main'").groupBy("graph", "vertex", "name").agg(F.coalesce(F.bool_or("is_entry_point"), F.lit(False)).alias("starts"))
    ways = back.join(ends, ["graph", "vertex"]).join(aims, ["graph", "aim"])
    hit = F.min(F.when(F.col("starts"), F.struct(F.col("name").alias("entry"), "depth")))
    length = F.min(F.when((F.col("name") == "main") & (F.col("depth") <= 10), F.col("depth")))
    ways = ways.groupBy("library_id", "target").agg(hit.alias("hit"), length.alias("length"))
    got = v.join(ways, ["library_id", "target"], "left").join(snapshots.select("library_id").distinct().withColumn("known", F.lit(True)), "library_id", "left")
    strategy = F.when(F.col("target").isNull(), "no_affected_functions").when(F.col("known").isNull(), "library_snapshot_not_found").when(F.col("hit").isNotNull(), "entry_reaches").when(F.col("length").isNotNull(), "shortest_path").otherwise("exhausted")
    entry = F.coalesce("hit.entry", F.when(F.col("length").isNotNull(), "main"))
    return got.select("id", "target", strategy.alias("strategy"), entry.alias("entry"), F.coalesce("hit.depth", "length").alias("depth"))


@query(f"""with recursive {_EDGES}, {_ENTRIES}, q as (select snapshot_id as graph, name || chr(31) || file as vertex, file from f where trim(file) <> ''),
w as (select distinct s.graph, s.entry, b.vertex from s join q a on a.graph = s.graph and a.vertex = s.entry join q b on b.graph = a.graph and b.file = a.file where b.vertex <> s.entry),
r as (select graph, entry, entry as vertex from s union select r.graph, r.entry, w.vertex from r join e on e.graph = r.graph and e.src = r.vertex join w on w.graph = r.graph and w.entry = r.entry and w.vertex = e.dst)
select distinct r.graph, {_name('r.entry', 'start', 'start_file')}, {_name('e.dst', 'callee', 'callee_file')} from r join e on e.graph = r.graph and e.src = r.vertex left join w on w.graph = r.graph and w.entry = r.entry and w.vertex = e.dst where w.vertex is null and e.dst <> r.entry""")
def graph_helper_calls(spark: SparkSession, d: str) -> DataFrame:
    """What entry points call, themselves or through functions of their own file."""
    f = table(spark, d, "function_records").where("trim(file_path) <> '' and snapshot_id is not null and name is not null").select(F.col("snapshot_id").alias("graph"), graph.vertex("name", "file_path").alias("vertex"), "file_path").distinct()
    s = _entries(spark, d)
    own = f.join(s, ["graph", "vertex"]).select("graph", F.col("vertex").alias("start"), "file_path").join(f, ["graph", "file_path"]).where("vertex <> start")
    got = graph.through_helpers(_steps(spark, d), s, own)
    return graph.named(graph.named(got, "start", "start", "start_file"), "callee", "callee", "callee_file")


# ---- sources ----
@query(r"""with f as (select distinct snapshot_id, name, content from function_records where snapshot_id is not null and content <> '' and language in ('c', 'cpp')),
b as (select snapshot_id, name, regexp_replace(regexp_replace(content, '(?s)("(?:[^"\\\n]|\\.)*"|''(?:[^''\\\n]|\\.)*'')|/\*.*?\*/|//[^\n]*', '\1 ', 'g'), '"(?:[^"\\\n]|\\.)*"', '""', 'g') as content from f),
c as (select distinct snapshot_id, name as caller, unnest(regexp_extract_all(content, '\b([A-Za-z_]\w*)\s*\(', 1)) as callee from b)
select c.snapshot_id, c.caller, c.callee from c where callee <> caller and exists (select 1 from function_records k where k.snapshot_id = c.snapshot_id and k.name = c.callee) and callee not in ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'catch', 'do', 'else', 'defined')""")
def source_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls read from the sources: words before a bracket that are functions of the same snapshot."""
    f = table(spark, d, "function_records").where("snapshot_id is not null")
    src = f.where("content <> '' and language in ('c', 'cpp')").select("snapshot_id", F.col("name").alias("caller"), F.explode(text.called_names("content")).alias("callee")).where("callee <> caller").distinct()
    return src.join(f.select("snapshot_id", F.col("name").alias("callee")).distinct(), ["snapshot_id", "callee"], "left_semi").select("snapshot_id", "caller", "callee")


@query(r"select distinct snapshot_id, regexp_extract(split_part(content, chr(10), 1), '(\w+)\s*\(', 1) as changed from function_records where snapshot_id is not null and regexp_matches(file_path, '\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$') and regexp_matches(split_part(content, chr(10), 1), '^\S.*\w\s*\(') and not contains(split_part(content, chr(10), 1), '@@') and not contains(split_part(content, chr(10), 1), chr(13))")
def diff_functions(spark: SparkSession, d: str) -> DataFrame:
    """Patches are written with each function's first line behind their hunks' marks; the changed functions are read back."""
    first = F.split_part("content", F.lit("\n"), F.lit(1))
    f = table(spark, d, "function_records").where(F.col("snapshot_id").isNotNull() & text.is_c_file("file_path") & first.rlike(r"^\S.*\w\s*\(") & ~first.contains("@@") & ~first.contains("\r"))
    hunk = F.concat(F.lit("@@ -"), F.col("start_line").cast("string"), F.lit(",4 +"), F.col("start_line").cast("string"), F.lit(",5 @@ "), first, F.lit("\n context\n+added\n"))
    return f.select("snapshot_id", F.explode(text.hunk_functions(F.coalesce(hunk, F.concat(F.lit("@@ -1,4 +1,5 @@ "), first)))).alias("changed")).distinct()


@query("select distinct snapshot_id, name, file_path, start_line as line from function_records where snapshot_id is not null and name <> '' and trim(file_path) <> '' and start_line is not null")
def debug_functions(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot's functions are written as the debug records of a module and read back."""
    f = table(spark, d, "function_records").where("snapshot_id is not null and name <> '' and trim(file_path) <> '' and start_line is not null")
    rows = f.select("snapshot_id", "name", "file_path", F.col("start_line").alias("line")).distinct()
    per_file = rows.withColumn("snapshot_id", F.concat_ws("\0", "snapshot_id", "file_path"))  # a module per source file
    got = debug_info.debug_functions(debug_info.debug_text(per_file, "snapshot_id"), "snapshot_id", "text")
    return got.select(F.split_part("snapshot_id", F.lit("\0"), F.lit(1)).alias("snapshot_id"), "name", "file_path", "line")


# ---- manifests ----
# kind: (file, opening, line of a dependency named lib{n} in version {v}, separator, closing)
_KINDS = [
    ("build.gradle", "dependencies {\n", "    implementation 'org:lib{n}:{v}'", "\n", "\n}"),
    ("CMakeLists.txt", "project(x)\nfind_package(Threads REQUIRED)\n", "find_package(lib{n} {v} REQUIRED)", "\n", "\n"),
    ("conanfile.txt", "[requires]\n", "lib{n}/{v}@user/stable", "\n", "\n[options]\nx/1\n"),
    ("Cargo.toml", "[dependencies]\n", 'lib{n} = "{v}"', "\n", "\n"),
    ("vcpkg.json", '{"dependencies": [', '{"name": "lib{n}", "version>=": "{v}"}', ", ", "]}"),
    ("foundry.toml", "[dependencies]\n", 'lib{n} = "{v}"', "\n", "\n"),
    ("pyproject.toml", "[project]\ndependencies = [", '"lib{n}[x]=={v} ; python_version > \'3\'"', ", ", "]\n"),
    ("pom.xml", "<project><dependencies>", "<dependency><groupId>org</groupId><artifactId>lib{n}</artifactId><version>{v}</version></dependency>", "", "</dependencies></project>"),
    ("gitmodules", "", '[submodule "lib{n}"]\n\tpath = x{n}\n\turl = https://forge.example/org/lib{n}.git', "\n", "\n"),
]
_EXPR = {0: "", 1: ">=", 2: "==", 3: "", 4: ">=", 5: "", 6: "==", 7: ""}


@query("select project_id, concat(case when project_id % 9 in (0, 7) then 'org:lib' else 'lib' end, cast(library_id as varchar)) as library_name, case when project_id % 9 = 8 then null else concat(case project_id % 9 " + " ".join(f"when {k} then '{v}'" for k, v in _EXPR.items()) + " end, cast(resolved_version as varchar)) end as constraint_expr, case when project_id % 9 in (0, 2, 5, 6, 7) then cast(resolved_version as varchar) end as resolved_version from p_deps")
def manifest_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Each project's dependencies are written as one of nine kinds of manifests and read back."""
    n, v, kind = F.col("library_id").cast("string"), F.col("resolved_version").cast("string"), F.col("project_id") % len(_KINDS)
    pick = lambda i: F.element_at(F.array(*(F.lit(k[i]) for k in _KINDS)), (kind + 1).cast("int"))
    line = F.replace(F.replace(pick(2), F.lit("{n}"), n), F.lit("{v}"), v)
    lines = relational.in_chunks(view(spark, d, "p_deps").select("project_id", line.alias("line")), ["project_id"], ["line"]).groupBy("project_id", "chunk").agg(F.collect_list("line").alias("lines"))
    files = lines.select(F.concat_ws("/", "project_id", "chunk", pick(0)).alias("path"), F.concat(pick(1), F.array_join("lines", "\0"), pick(4)).alias("content"), pick(3).alias("between"))
    files = files.select("path", F.replace("content", F.lit("\0"), F.col("between")).alias("content"))
    deps = manifests.dependencies(files).withColumn("project_id", F.substring_index("path", "/", 1).cast("bigint"))
    return deps.select("project_id", "library_name", "constraint_expr", "resolved_version")


def queries() -> dict:
    return dict(query.queries)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
