"""Parts, pages, questions, replies, ends of bodies, and files of repositories, registries, orders, logs and reports."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import merge, relational
from strandline.sources import debug_info, dot, files, manifests
from strandline.streaming.ingest import insert_ignore_into, watermarked_counts


def test_a_part_that_fails_keeps_none_of_the_others_away(spark):
    def fails():
        raise TimeoutError("rate limit")

    rows, errors = merge.union_of_parts({"a": lambda: spark.range(2), "b": fails, "c": lambda: spark.range(1)})
    assert sorted(tuple(r) for r in rows.collect()) == [(0, "a"), (0, "c"), (1, "a")] and errors == {"b": "rate limit"}
    assert merge.union_of_parts({"b": fails}) == (None, {"b": "rate limit"})


def test_pages_looks_back_and_questions(spark):
    assert [tuple(relational.page_meta(spark.range(n), p, 20).first()) for n, p in ((0, 0), (20, 0), (41, 2), (61, 1))] == [(0, 0, False), (20, 1, False), (41, 3, False), (61, 4, True)]
    rows = spark.sql("select 'k' as k, i, timestamp_ntz '2024-03-01' - make_dt_interval(i) as at from (select explode(sequence(0, 60)) as i)")
    assert sorted(r.i for r in relational.looked_back(rows, ["k"], "at", "i", 30, 300).collect()) == list(range(31))
    assert sorted(r.i for r in relational.looked_back(rows, ["k"], "at", "i", 30, 5).collect()) == list(range(5))
    assert relational.looked_back(rows.limit(0), ["k"], "at", "i", 30, 5).count() == 0
    assert relational.read_only(spark, "select count(*) as n from {t} where id >= :low", {"low": 2}, t=spark.range(5)).first().n == 3
    for sql in ("DROP table x", "select 1; Delete from x", "insert into x values (1)"):
        with pytest.raises(ValueError):
            relational.read_only(spark, sql)
    assert relational.read_only(spark, "select 1 as updated_at, 'offset' as c").count() == 1


@pytest.mark.parametrize(
    ("source", "line"),
    [("int f()\n{\n  g();\n}\nint h() { }", 4), ('f() { s = "}";\n /* } \n } */ c = \'}\'; // }\n}', 4), ("f() {\n", 1), ("int x;", 1), ("", 1), ("f() {" + "\n" * 2500 + "}", 1), ("f() {{}\n{}\n}", 3), ('f() { "\\"}"\n;}', 2)],
)
def test_where_bodies_end(source, line):
    assert text.lines_to_end(source) == line


def test_findings_in_replies_and_moved_addresses(spark):
    one = '{"vuln_type": "UAF", "severity": "Severe", "summary": "x"}'
    cases = [(f"so: [{one}, {{}}, {one}] ok", 2), (f"only {one}", 1), ("[]", 0), ("none {", 0), (None, 0), ('{"a": 1}', 0)]
    got = spark.createDataFrame(cases, "reply string, n int").select("n", text.reply_findings("reply").alias("f")).collect()
    assert all(len(r.f or []) == r.n for r in got) and tuple(got[0].f[0]) == ("use_after_free", "critical", "x")
    urls = spark.createDataFrame([("https://h/A/b.git", "https://h/a/b/"), ("https://h/a/b", "https://h/a/c"), ("https://h/a/b", None)], "r string, f string")
    assert [r[0] for r in urls.select(text.moved("r", "f")).collect()] == ["same", "redirects", None]


def test_files_of_all_kinds(spark, tmp_path):
    for name, body in {"src/a.c": "int a;", "src/b.txt": "b", "vendor/c.c": "c", "x/build/deep/d.c": "d", "e.py": "e", "lib/a.c": "other"}.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(body)
    found = files.source_files(spark, f"{tmp_path}/tree")
    assert {r.path: r.bytes for r in found.collect()} == {"src/a.c": 6, "e.py": 1, "lib/a.c": 5}
    wanted = spark.createDataFrame([("f1", "src/a.c"), ("f2", "moved/a.c"), ("f3", "gone.c")], "name string, path string")
    assert {r.name: r.code for r in files.looked_up(wanted, found).collect()} == {"f1": "int a;", "f2": "other", "f3": ""}

    (tmp_path / "reg" / "rust").mkdir(parents=True)
    (tmp_path / "reg" / "rust" / "repos.json").write_text(json.dumps([{"name": "n", "repo_url": "u", "default_branch": "old"}, {"name": "m"}]))
    rows = files.registered(spark, f"{tmp_path}/reg")
    assert {(r.name, r.ecosystem) for r in rows.collect()} == {("n", "rust"), ("m", "rust")}
    branches = spark.createDataFrame([("n", "main"), ("m", None)], "name string, branch string")
    assert {r.name: r.default_branch for r in files.with_branches(rows, branches).collect()} == {"n": "main", "m": None}

    (tmp_path / "o1.json").write_text(json.dumps({"repo_url": "u", "version": "1", "fuzzer_sources": {"f": ["a.c"]}}))
    (tmp_path / "o2.json").write_text("{}")
    assert sorted(len(r.problems) for r in files.work_orders(spark, f"{tmp_path}/o*.json").collect()) == [0, 3]

    lines = spark.createDataFrame([("s", "build", "one"), ("s", "run", "two")], "snapshot_id string, phase string, line string")
    for _ in range(2):
        files.append_log(lines, f"{tmp_path}/logs")
    assert [r.line for r in files.read_log(spark, f"{tmp_path}/logs", "s", "build").collect()] == ["one", "one"]
    files.write_report(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string"), f"{tmp_path}/report", "Health")
    assert [r.value for r in spark.read.text(f"{tmp_path}/report").collect()] == ["# Health", "", "| n | t |", "| --- | --- |", "| 1 | a\\|b |", "| 2 |  |"]


def test_a_scan_of_a_folder(spark, tmp_path):
    """Manifests found in a folder, parsed, and of each library the last find."""
    (tmp_path / "requirements.txt").write_text("zlib==1.2\ncurl>=8\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "vcpkg.json").write_text('{"dependencies": ["zlib"]}')
    deps = manifests.dependencies(manifests.discovered(spark, str(tmp_path)))
    assert deps.agg(F.countDistinct("path"), F.count("*")).first()[:] == (2, 3)
    assert {(r.library_name, r.detection_method) for r in manifests.last_found(deps).collect()} == {("zlib", "vcpkg"), ("curl", "pip-requirements")}


def test_a_batch_that_is_handed_in_again_changes_nothing(spark, tmp_path):
    accept = insert_ignore_into(spark, f"{tmp_path}/t", ["k"], "n")
    for i, ks in enumerate(("aab", "bc", "")):
        batch = spark.createDataFrame([(j, k) for j, k in enumerate(ks)], "n int, k string")
        accept(batch, i)
        accept(batch, i)
    assert sorted((r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/t/rows").collect()) == [("a", 0), ("b", 2), ("c", 1)]


def test_watermarked_counts(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 10:00:00' + make_dt_interval(i % 2) as at, 'k' as k from (select explode(sequence(1, 6)) as i)").write.parquet(f"{tmp_path}/in")
    counts = watermarked_counts(spark, spark.read.parquet(f"{tmp_path}/in").schema, f"{tmp_path}/in", "at", "k")
    q = counts.writeStream.format("memory").queryName("late_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["count"] for r in spark.table("late_counts").collect()) == [3, 3]


def test_patches_set_the_fields_they_name(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "d", "w")], "id int, must string, may string")
    patches = spark.createDataFrame([(1, None, None, ["must", "may"]), (2, "B", None, ["must"]), (3, "C", "Z", ["may"]), (4, "D", "W", None), (9, "n", "n", ["must"])], "id int, must string, may string, fields array<string>")
    got = merge.patched(old, patches, ["id"], ["may"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", None), (2, "B", "y"), (3, None, "Z"), (4, "d", "w")]
    assert merge.patched(old.limit(0), patches, ["id"]).count() == 0 and merge.patched(old, patches.limit(0), ["id"]).count() == 4


def test_debug_records_under_both_names(spark):
    f = spark.createDataFrame([("m", n) for n in ("init.1", "init", "gone", "run")], "k string, name string")
    metas = spark.createDataFrame([("m", "init", "init", 1, "a.c"), ("m", "init.1", "init", 2, "b.c"), ("m", "run", None, 3, "c.c"), ("m", "", None, 4, "d.c"), ("x", "gone", "gone", 5, "e.c")], "k string, ir_name string, original_name string, n int, file_path string")
    got = debug_info.with_debug(f, metas, "k", "n")
    assert {(r["name"], r.file_path, r.is_external) for r in got.collect()} == {("init.1", "b.c", False), ("init", "b.c", False), ("gone", None, True), ("run", "c.c", False)}
    assert debug_info.with_debug(f, metas.limit(0), "k", "n").where("is_external").count() == 4


def test_repositories_of_packages(spark):
    gh = "https://github.com/o/"
    links = [({"Docs": gh + "docs", "homepage": gh + "home", "SOURCE": gh + "src"}, None, gh + "src"), ({"Source": "https://x.example/a/b", "Tracker": gh + "t/issues"}, gh + "h", gh + "t/issues"), ({}, gh + "h", gh + "h"), (None, "https://x.example", None), (None, None, None)]
    got = spark.createDataFrame(links, "links map<string,string>, home string, want string").select(text.linked_repo("links", "home"), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    poms = [
        (f"<project><url>{gh}own</url><scm><url>{gh}scm</url></scm></project>", gh + "scm"),
        ("<project><scm><url>https://x.example</url><connection>scm:git:git://github.com/o/c.git</connection></scm></project>", gh + "c.git"),
        (f"<project><licenses><license><url>{gh}licence</url></license></licenses><url>{gh}own</url></project>", gh + "own"),
        (f"<!-- <project> --><url>{gh}own</url>", None), ("", None), (None, None),
    ]
    got = spark.createDataFrame(poms, "pom string, want string").select(text.pom_repo("pom"), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_slices_of_lines_and_names_in_graphs(spark):
    rows = [("a\nb\nc", 2, 3, "b\nc"), ("a\nb", 2, 9, "b"), ("a", 2, 2, None), ("a", 0, 1, None), ("", 1, 1, ""), (None, 1, 1, None), ("a", None, 1, None)]
    got = spark.createDataFrame(rows, "t string, a int, b int, want string").select(text.line_slice("t", "a", "b"), "want").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    t = spark.createDataFrame([("g", 'digraph {\n N1 [shape=record,label="{main}"];\n N2 [label="{fun: lone}"];\n N1 -> N1;\n}'), ("h", None)], "k string, t string")
    assert {tuple(r) for r in dot.dot_names(t, "k", "t").collect()} == {("g", "main"), ("g", "lone")}
