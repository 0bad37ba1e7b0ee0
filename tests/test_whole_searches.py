"""Searches from every entry point, as deep as the graph is."""

import __spark_entry__ as e
from strandline.operators import graph


def _write(spark, at, edges, functions):
    rows = [(i, "g", a, b, "direct", None, " ", 1.0, "svf") for i, (a, b) in enumerate(edges)]
    spark.createDataFrame(rows, "edge_id bigint, snapshot_id string, caller string, callee string, call_type string, caller_file string, callee_file string, confidence double, source_backend string").write.parquet(f"{at}/call_edges.parquet")
    spark.createDataFrame([("g", "lib", n, "a.c", entry) for n, entry in functions], "snapshot_id string, library_id string, name string, file_path string, is_entry_point boolean").write.parquet(f"{at}/function_records.parquet")
    return str(at)


def test_all_entry_points_and_all_depths(spark, tmp_path):
    chain = ["z_entry", *(f"f{i}" for i in range(1, 13))]
    d = _write(spark, tmp_path, [*zip(chain, chain[1:]), ("a_entry", "g1")], [*((n, n == "z_entry") for n in chain), ("a_entry", True), ("g1", False), ("alone", False)])
    got = {(r.entry, r.name, r.depth) for r in e.queries()["graph_entry_reaches"](spark, d).collect()}
    assert got == {*(("z_entry", n, k) for k, n in enumerate(chain) if k), ("a_entry", "g1", 1)}
    assert [r.name for r in e.queries()["graph_unreached"](spark, d).collect()] == ["alone"]


def test_a_flaw_far_from_its_entry_point_is_reached(spark, tmp_path):
    chain = ["z_entry", *(f"f_{i}" for i in range(1, 10))]
    d = _write(spark, tmp_path, list(zip(chain, chain[1:])), [(n, n == "z_entry") for n in chain])
    spark.createDataFrame([("u", "lib", "Overflow in f_9")], "id string, library_id string, summary string").write.parquet(f"{d}/upstream_vulns.parquet")
    assert tuple(e.queries()["reachability_decisions"](spark, d).first()) == ("u", "f_9", "entry_reaches", "z_entry", 9)


def test_a_flaw_that_only_main_reaches(spark, tmp_path):
    chain = ["main", *(f"f_{i}" for i in range(1, 12))]
    d = _write(spark, tmp_path, list(zip(chain, chain[1:])), [*((n, False) for n in chain), ("a_entry", True)])
    spark.createDataFrame([("near", "lib", "Overflow in f_10"), ("far", "lib", "Overflow in f_11")], "id string, library_id string, summary string").write.parquet(f"{d}/upstream_vulns.parquet")
    got = {tuple(r) for r in e.queries()["reachability_decisions"](spark, d).collect()}
    assert got == {("near", "f_10", "shortest_path", "main", 10), ("far", "f_11", "exhausted", None, None)}


def test_functions_of_one_name_are_vertices_of_their_own(spark):
    f = spark.createDataFrame([("g", n, file) for n, file in (("init", "a.c"), ("init", "b.c"), ("run", "a.c"), ("stop", "b.c"), ("malloc", None))], "snapshot_id string, name string, file_path string")
    e = spark.createDataFrame(
        [(1, "g", "init", "a.c", "run", "", "direct", 0.5, "x"), (2, "g", "init", "b.c", "stop", "b.c", "fptr", 0.9, "x"), (3, "g", "run", "", "init", "", "direct", None, "x"), (4, "g", "run", None, "run", "a.c", "direct", 0.1, "x"),
         (5, "g", "init", "a.c", "run", "a.c", "fptr", 0.5, "y"), (6, "g", "stop", "", "malloc", "", "direct", 1.0, "x"), (7, "g", "stop", "a.c", "malloc", "", "direct", 1.0, "x"), (8, "g", "run", "", "gone", "", "direct", 1.0, "x")],
        "edge_id bigint, snapshot_id string, caller string, caller_file string, callee string, callee_file string, call_type string, confidence double, source_backend string",
    )
    r = graph.resolved_edges(e, f)
    got = {(x.caller, x.caller_file, x.callee, x.callee_file, x.call_type) for x in r.collect()}
    assert got == {("init", "a.c", "run", "a.c", "direct"), ("init", "b.c", "stop", "b.c", "fptr"), ("run", "a.c", "init", "a.c", "direct"), ("run", "a.c", "run", "a.c", "direct"), ("stop", "b.c", "malloc", "", "direct")}
    asked = spark.createDataFrame([("g", "init", None), ("g", "init", "b.c"), ("g", "gone", ""), ("g", "run", None), ("g", "run", "z.c")], "snapshot_id string, name string, file string")
    answers = graph.asked_functions(f, asked)
    assert {(x["name"], x["file"], x["status"]) for x in answers.collect()} == {("init", "", "ambiguous"), ("init", "b.c", "found"), ("gone", "", "missing"), ("run", "", "found"), ("run", "z.c", "missing")}
    assert {(x.caller_file, x.callee) for x in graph.callees(r, answers).collect()} == {("b.c", "stop"), ("a.c", "init"), ("a.c", "run")}
    assert {(x.caller, x.caller_file) for x in graph.callers(r, answers).collect()} == {("init", "a.c"), ("run", "a.c")}
    none = graph.resolved_edges(e.limit(0), f)
    assert none.count() == 0 and graph.asked_functions(f.limit(0), asked).where("status = 'missing'").count() == 5


def test_small_and_large_frontiers_give_the_same(spark, monkeypatch):
    e = spark.createDataFrame([("g", f"v{i}", f"v{j}") for i in range(12) for j in (i + 1, (i * i) % 12)], "graph string, src string, dst string")
    s = spark.createDataFrame([("g", "v2", "x"), ("g", "v7", "y")], "graph string, vertex string, tag string")
    goal = spark.createDataFrame([("g", "v12")], "graph string, vertex string")
    got = []
    for rows in (100_000, 0):
        monkeypatch.setattr(graph, "BROADCAST_ROWS", rows)
        got.append([sorted(map(tuple, df.collect())) for df in (graph.reach(e, s, 50, "tag"), graph.paths_to(e, s, goal))])
    assert got[0] == got[1] and all(got[0])


def test_paths_to_targets_alone_are_those_of_all(spark):
    pairs = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "a"), ("x", "d"), ("e", "f")]
    e = spark.createDataFrame([("g", s, d) for s, d in pairs], "graph string, src string, dst string")
    s = spark.createDataFrame([("g", "a"), ("g", "x")], "graph string, vertex string")
    every = {(r.start, r.vertex, r.depth, r.rank, tuple(r.path)) for r in graph.shortest_paths(e, s).collect() if r.depth}
    some = graph.paths_to(e, s, spark.createDataFrame([("g", "e"), ("g", "c"), ("g", "a"), ("g", "zz")], "graph string, vertex string"))
    assert {(r.start, r.vertex, r.depth, r.rank, tuple(r.path)) for r in some.collect()} == {x for x in every if x[1] in ("e", "c")}
    assert len([x for x in every if x[:2] == ("a", "e")]) == 2
