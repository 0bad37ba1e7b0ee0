"""Call graphs as DataFrames: (graph, src, dst) edges, traversed by whole frontiers.

A vertex is a function of a snapshot, by name and file, as one string (``vertex``). Each step is one join of the frontier
with the edges and an anti join with what is known, both by (graph, vertex), and is checkpointed, so the plan doesn't grow
with the depth. A frontier that was counted and is small is broadcast, so that its step doesn't shuffle all edges. A callee that holds a tenth of all edges is met once per graph and step, as frontiers hold distinct vertices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import checkpointed


SEP = "\x1f"
BROADCAST_ROWS = 100_000  # a frontier of at most so many rows, of some hundred bytes each, goes to the edges; beyond, both are shuffled


def vertex(name: Column | str, file: Column | str) -> Column:
    """A function of a snapshot as one string; a null file is blank."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat_ws(SEP, c(name), F.coalesce(c(file), F.lit("")))


def named(rows: DataFrame, column: str, name: str, file: str) -> DataFrame:
    """rows with a vertex column replaced by its name and file."""
    split = lambda n: F.split_part(F.col(column), F.lit(SEP), F.lit(n))
    return rows.withColumns({name: split(1), file: split(2)}).drop(*({column} - {name, file}))


def known_functions(functions: DataFrame) -> DataFrame:
    """(snapshot_id, name, wanted, file): the functions by their file, and under a blank one that of the least file."""
    f = functions.where("snapshot_id is not null and name is not null").select("snapshot_id", "name", F.coalesce("file_path", F.lit("")).alias("file")).distinct()
    return f.where("file <> ''").select("snapshot_id", "name", F.col("file").alias("wanted"), "file").unionByName(f.groupBy("snapshot_id", "name").agg(F.min("file").alias("file")).select("snapshot_id", "name", F.lit("").alias("wanted"), "file"))


def _with_ends(edges: DataFrame, functions: DataFrame, *more: Column | str) -> DataFrame:
    """The edges with a known function at both ends, repeated ones too."""
    e = edges.select("snapshot_id", "caller", "callee", *more, *(F.coalesce(F.trim(f"{x}_file"), F.lit("")).alias(f"{x}_wanted") for x in ("caller", "callee")))
    known = known_functions(functions)
    for x in ("callee", "caller"):
        e = e.join(known.select("snapshot_id", F.col("name").alias(x), F.col("wanted").alias(f"{x}_wanted"), F.col("file").alias(f"{x}_file")), ["snapshot_id", x, f"{x}_wanted"])
    return e


def call_steps(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(graph, src, dst) of the edges that ``resolved_edges`` gives, repeated ones too: enough for a search, and a shuffle less."""
    return _with_ends(edges, functions).select(F.col("snapshot_id").alias("graph"), vertex("caller", "caller_file").alias("src"), vertex("callee", "callee_file").alias("dst"))


def resolved_edges(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(snapshot_id, caller, caller_file, callee, callee_file, call_type, confidence, backend), both ends functions of the snapshot.

    Where an edge names a file, that end must be the function of that file; else it is the one with the least file. Edges
    with an unknown end are dropped; of equal edges the greatest confidence stays, of these the first. Calls of a function
    to itself are edges like others.
    """
    e = _with_ends(edges, functions, "edge_id", "call_type", "confidence", F.col("source_backend").alias("backend"))
    best = F.max_by(F.struct("call_type", "confidence", "backend"), F.struct("confidence", -F.col("edge_id")))
    return e.groupBy("snapshot_id", "caller", "caller_file", "callee", "callee_file").agg(best.alias("r")).select("snapshot_id", "caller", "caller_file", "callee", "callee_file", "r.*")


def vertex_edges(resolved: DataFrame) -> DataFrame:
    """(graph, src, dst, call_type) of resolved edges."""
    return resolved.select(F.col("snapshot_id").alias("graph"), vertex("caller", "caller_file").alias("src"), vertex("callee", "callee_file").alias("dst"), "call_type")


def asked_functions(functions: DataFrame, asked: DataFrame) -> DataFrame:
    """(snapshot_id, name, file, found, first_file, status) of asked (snapshot_id, name, file); a null or blank file is any.

    status is found, missing or ambiguous: several functions of that name and none of them chosen by a file.
    """
    f = functions.where("snapshot_id is not null").select("snapshot_id", "name", F.coalesce("file_path", F.lit("")).alias("own")).distinct()
    a = asked.select("snapshot_id", "name", F.coalesce("file", F.lit("")).alias("file")).distinct()
    hits = a.join(f, ["snapshot_id", "name"], "left").where("own is null or file = '' or own = file").groupBy("snapshot_id", "name", "file").agg(F.count("own").alias("found"), F.min("own").alias("first_file"))
    hits = a.join(hits, ["snapshot_id", "name", "file"], "left").fillna(0, ["found"])
    return hits.withColumn("status", F.when(F.col("found") == 0, "missing").when(F.col("found") == 1, "found").otherwise("ambiguous"))


def callees(resolved: DataFrame, answers: DataFrame) -> DataFrame:
    """The resolved edges out of the functions that ``asked_functions`` found."""
    return resolved.join(answers.where("status = 'found'").select("snapshot_id", F.col("name").alias("caller"), F.col("first_file").alias("caller_file")).distinct(), ["snapshot_id", "caller", "caller_file"], "left_semi")


def callers(resolved: DataFrame, answers: DataFrame) -> DataFrame:
    """The resolved edges into the functions that ``asked_functions`` found."""
    return resolved.join(answers.where("status = 'found'").select("snapshot_id", F.col("name").alias("callee"), F.col("first_file").alias("callee_file")).distinct(), ["snapshot_id", "callee", "callee_file"], "left_semi")


def entry_edges(fuzzers: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges of fuzzers (snapshot_id, fuzzer, entry, entry_file, called array) to the library functions they call.

    One row (snapshot_id, fuzzer, entry, entry_file, callee, callee_file, call_type, confidence, backend) per call; of
    several functions of a name the one with the least file; names that are no function are dropped.
    """
    calls = fuzzers.select("snapshot_id", "fuzzer", "entry", "entry_file", F.explode("called").alias("callee")).distinct()
    any_ = known_functions(functions).where("wanted = ''").select("snapshot_id", F.col("name").alias("callee"), F.col("file").alias("callee_file"))
    return calls.join(any_, ["snapshot_id", "callee"]).select("snapshot_id", "fuzzer", "entry", "entry_file", "callee", "callee_file", F.lit("direct").alias("call_type"), F.lit(1.0).alias("confidence"), F.lit("fuzzer_parser").alias("backend"))


def plain_edges(edges: DataFrame) -> DataFrame:
    """(graph, src, dst) of the names alone, each once, without loops."""
    return edges.where("snapshot_id is not null and trim(caller) <> '' and trim(callee) <> '' and caller <> callee").select(F.col("snapshot_id").alias("graph"), F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def _to_edges(front: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(front) if rows <= BROADCAST_ROWS else front


def reach(edges: DataFrame, starts: DataFrame, max_depth: int = 50, tag: str | None = None) -> DataFrame:
    """(graph, [tag,] vertex, depth): least number of steps from any start (graph, [tag,] vertex), at most max_depth.

    With a tag every tag has its own search, all of them in the same steps. Repeated edges and starts change nothing.
    """
    on = ["graph", *([tag] if tag else []), "vertex"]
    e = checkpointed(edges.select("graph", F.col("src").alias("vertex"), "dst"))
    front = checkpointed(starts.select(*on).distinct().withColumn("depth", F.lit(0)))
    seen, rows = front, front.count()
    for depth in range(1, max_depth + 1):
        step = _to_edges(front.drop("depth"), rows).join(e, ["graph", "vertex"]).drop("vertex").withColumnRenamed("dst", "vertex").select(*on).distinct()
        front = checkpointed(step.join(seen, on, "left_anti").withColumn("depth", F.lit(depth)))
        if not (rows := front.count()):
            break
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges whose both ends are among the vertices (graph, vertex)."""
    v = vertices.select("graph", "vertex").distinct()
    return edges.join(v.withColumnRenamed("vertex", "src"), ["graph", "src"], "left_semi").join(v.withColumnRenamed("vertex", "dst"), ["graph", "dst"], "left_semi")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """(graph, src, dst) against the calls, for a search from what is called."""
    return edges.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"))


def shortest_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 10, max_results: int = 10) -> DataFrame:
    """(graph, start, vertex, depth, rank, path): up to max_results shortest paths from each start to each vertex, in order.

    A path to a vertex is a path to a vertex one step nearer and the vertex itself, so the first max_results paths of the
    nearer vertices suffice, and no more are kept. ``paths_to`` is the way to chosen vertices.
    """
    on = ["graph", "start"]
    starts = starts.select("graph", F.col("vertex").alias("start"), "vertex").distinct()
    depths = checkpointed(reach(edges, starts, max_depth, "start"))
    nearer = depths.select(*on, F.col("vertex").alias("src"), F.col("depth").alias("from_depth"))
    onward = checkpointed(edges.select("graph", "src", "dst").join(nearer, ["graph", "src"]).join(depths.select(*on, F.col("vertex").alias("dst"), "depth"), [*on, "dst"]).where("depth = from_depth + 1").select(*on, "src", "dst", "depth"))
    front = checkpointed(starts.select(*on, "vertex", F.lit(0).alias("depth"), F.lit(1).alias("rank"), F.array("vertex").alias("path")))
    found = front
    order = Window.partitionBy(*on, "vertex").orderBy("path")
    for depth in range(1, max_depth + 1):
        step = front.select(*on, F.col("vertex").alias("src"), "path").join(onward.where(F.col("depth") == depth), [*on, "src"])
        step = step.select(*on, F.col("dst").alias("vertex"), "depth", F.concat("path", F.array("dst")).alias("path"))
        front = checkpointed(step.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_results).select(*found.columns))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def paths_to(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int = 10, max_results: int = 10) -> DataFrame:
    """The rows of ``shortest_paths`` of one step and more to the targets (graph, vertex) alone.

    One search against the calls tells how far each function is from each target; from the starts on, every step that
    comes one nearer is on a shortest path, so nothing that leads elsewhere is followed.
    """
    at, on = ["graph", "aim"], ["graph", "start", "aim"]
    aims = targets.select("graph", F.col("vertex").alias("aim"), "vertex").distinct()
    left = checkpointed(reach(reversed_edges(edges), aims, max_depth, "aim").withColumnRenamed("depth", "left"))
    src = left.select(*at, F.col("vertex").alias("src"), F.col("left").alias("from_left"))
    onward = edges.select("graph", "src", "dst").join(src, ["graph", "src"]).join(left.select(*at, F.col("vertex").alias("dst"), "left"), [*at, "dst"])
    onward = checkpointed(onward.where("left = from_left - 1").select(*at, F.col("src").alias("vertex"), "dst"))
    first = starts.select("graph", F.col("vertex").alias("start"), "vertex").distinct().join(left.where("left > 0"), ["graph", "vertex"])
    front = checkpointed(first.select(*on, "vertex", F.col("left").alias("depth"), F.lit(1).alias("rank"), F.array("vertex").alias("path")))
    found, rows = front.limit(0), front.count()
    order = Window.partitionBy(*on, "vertex").orderBy("path")
    for _ in range(max_depth):
        step = _to_edges(front, rows).join(onward, [*at, "vertex"]).select(*on, F.col("dst").alias("vertex"), "depth", F.concat("path", F.array("dst")).alias("path"))
        front = checkpointed(step.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_results).select(*found.columns))
        if not (rows := front.count()):
            break
        found = found.unionByName(front.where("vertex = aim"))
    return found.select("graph", "start", "vertex", "depth", "rank", "path")


def trails(edges: DataFrame, starts: DataFrame, max_depth: int, max_results: int = 100) -> DataFrame:
    """(graph, start, vertex, length, path): the walks of 1..max_depth steps that use no edge twice, of each pair of start
    and vertex the max_results shortest."""
    e = checkpointed(edges.select("graph", F.col("src").alias("vertex"), "dst"))
    walk = starts.select("graph", F.col("vertex").alias("start"), "vertex", F.array("vertex").alias("path"))
    found = None
    for depth in range(1, max_depth + 1):
        used = F.exists(F.sequence(F.lit(1), F.size("path") - 1), lambda i: (F.element_at("path", i) == F.col("vertex")) & (F.element_at("path", i + 1) == F.col("dst"))) if depth > 1 else F.lit(False)
        walk = checkpointed(walk.join(e, ["graph", "vertex"]).where(~used).select("graph", "start", F.col("dst").alias("vertex"), F.concat("path", F.array("dst")).alias("path")))
        longer = walk.select("graph", "start", "vertex", F.lit(depth).alias("length"), "path")
        found = longer if found is None else found.unionByName(longer)
    order = Window.partitionBy("graph", "start", "vertex").orderBy("length", "path")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_results).drop("rank")


def merged_backends(edges: DataFrame, key: list[str], backend: str, order: list[str]) -> DataFrame:
    """One edge per key from several analyses: backends (sorted, joined by +), call_type of the most precise backend in
    order, confidence raised by the number of backends that agree.

    Within a backend the greatest confidence stands for an edge. One backend keeps its confidence; of several the least is
    taken, with 0.1 more for two and 0.2 for more, at most 1. Unknown backends come last in order.
    """
    rank = F.coalesce(F.nullif(F.array_position(F.lit(order), F.col(backend)), F.lit(0)), F.lit(len(order) + 1))
    one = edges.groupBy(*key, backend).agg(F.max("confidence").alias("confidence"), F.min("call_type").alias("call_type"))
    got = one.groupBy(*key).agg(F.concat_ws("+", F.array_sort(F.collect_set(backend))).alias("backends"), F.min_by("call_type", F.struct(rank, backend)).alias("call_type"), F.min("confidence").alias("least"), F.count("*").alias("n"))
    extra = F.when(F.col("n") == 1, 0.0).when(F.col("n") == 2, 0.1).otherwise(0.2)
    return got.withColumn("confidence", F.least(F.lit(1.0), F.col("least") + extra)).drop("least", "n")


def through_helpers(edges: DataFrame, starts: DataFrame, helpers: DataFrame, max_depth: int = 50) -> DataFrame:
    """(graph, start, callee): what a start calls itself or through its helpers (graph, start, vertex), helpers left out.

    The search goes on from helpers alone, so the library behind the first call isn't entered.
    """
    on = ["graph", "start", "vertex"]
    e = checkpointed(edges.select("graph", F.col("src").alias("vertex"), "dst"))
    own = checkpointed(helpers.select(*on).distinct())
    front = checkpointed(starts.select("graph", F.col("vertex").alias("start"), "vertex").distinct())
    seen, calls = front, None
    for _ in range(max_depth):
        step = checkpointed(front.join(e, ["graph", "vertex"]).select("graph", "start", F.col("dst").alias("vertex")).distinct())
        outside = step.join(own, on, "left_anti").where("vertex <> start")
        calls = outside if calls is None else calls.unionByName(outside)
        front = checkpointed(step.join(own, on, "left_semi").join(seen, on, "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return calls.distinct().withColumnRenamed("vertex", "callee")
