"""Small cases for the core operators, against brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.functions import cursor, text
from strandline.functions.ids import uuid_key
from strandline.operators import graph, late_events, merge, orphans, relational
from strandline.sources import manifests
from strandline.streaming.ingest import insert_ignore_into, run_available

T = dt.datetime
REFS = "ref_field string, record_id string, key string, period string, created_at timestamp_ntz"
TARGETS = "ref_field string, key string, gone boolean, first_at timestamp_ntz"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- problem 1 ----
def test_orphans_against_brute_force_whatever_is_heavy(spark):
    r = random.Random(3)
    days = [T(2024, 1, 1) + dt.timedelta(days=9 * i) for i in range(12)]
    refs = [("t.f", str(i), f"k{r.choice([0] * 9 + list(range(12)))}", None if i % 50 == 0 else f"2024-{r.randrange(1, 4):02}", r.choice([*days, None])) for i in range(400)]
    targets = [("t.f", f"k{i}", i == 3, days[i] if i % 4 else None) for i in range(9)]
    known = {k: (g, at) for _, k, g, at in targets}
    lost = {(f, i) for f, i, k, _, at in refs if k not in known or known[k][0] or (at and known[k][1] and at < known[k][1])}
    assert lost and len(lost) < 400
    for heavy, most in ((1, 1000), (50, 1000), (1, 2), (10**9, 5)):
        got = orphans.orphan_records(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), heavy, most)
        assert {(x["ref_field"], x["record_id"]) for x in got.collect()} == lost
    counts = orphans.orphan_counts(spark.createDataFrame(refs, REFS), spark.createDataFrame(targets, TARGETS), 50)
    assert sum(x["n_orphans"] for x in counts.collect()) == len(lost) and sum(x["n_references"] for x in counts.collect()) == 400


def test_orphans_of_empty_tables_and_repeated_rows(spark):
    none, t = spark.createDataFrame([], REFS), spark.createDataFrame([], TARGETS)
    assert orphans.orphan_records(none, t).count() == 0 and orphans.orphan_counts(none, t).count() == 0
    twice = spark.createDataFrame([("a", "1", "k", "p", None)] * 2, REFS)
    assert orphans.orphan_records(twice, t).count() == 1
    assert [(x["n_references"], x["n_orphans"]) for x in orphans.orphan_counts(twice, t).collect()] == [(1, 1)]


def test_references_skip_null_and_blank_and_ignore_other_columns(spark):
    df = spark.createDataFrame([("1", None, 9), ("2", "  ", 9), ("3", "{AABBCCDD-0011-2233-4455-66778899AABB}", 9), ("4", "x y", 9)], "id string, ref string, key int")
    got = orphans.references(df, "t.ref", F.col("id"), uuid_key("ref"), F.lit("p"), F.lit(None).cast("timestamp_ntz"))
    assert rows(got.select("record_id", "key")) == [("3", "aabbccdd00112233445566778899aabb"), ("4", "x y")]


@pytest.mark.parametrize("spelled", ["AABBCCDD-0011-2233-4455-66778899AABB", "urn:uuid:aabbccdd-0011-2233-4455-66778899aabb", " {aabbccdd00112233445566778899aabb}\n"])
def test_uuid_spellings(spark, spelled):
    assert spark.createDataFrame([(spelled,)], "u string").select(uuid_key("u")).first()[0] == "aabbccdd00112233445566778899aabb"


# ---- problem 4 ----
def test_late_events_against_brute_force(spark):
    r = random.Random(5)
    data = []
    for i in range(500):
        at = T(2024, 3, 1) + dt.timedelta(hours=r.randrange(24 * 40))
        data.append((f"e{i}", r.choice(["a", "a", "b", None]), at, at + dt.timedelta(hours=r.choice([-30, 0, 1, 30, 70, 80, 120, 900]))))
    data.append(("edge", "a", T(2024, 3, 2, 5), T(2024, 3, 6)))  # the very end of the cut-off counts
    df = spark.createDataFrame(data, "id string, key string, event_time timestamp_ntz, arrived timestamp_ntz")
    late = {i for i, _, at, came in data if came > T(at.year, at.month, at.day) + dt.timedelta(days=4)}
    assert "edge" not in late and late
    for every, batches in ((1, 4), (7, 1), (1000, 2)):
        assert {x["id"] for x in late_events.too_late(df, every_days=every, batches=batches).collect()} == late
        days = late_events.daily(df, every_days=every, batches=batches).collect()
        want = defaultdict(int)
        for i, k, at, _ in data:
            want[k, at.date()] += i not in late
        assert {(x["key"], dt.date(1970, 1, 1) + dt.timedelta(days=x["day"])): x["n_events"] for x in days} == want
        for k in ("a", "b", None):
            total = 0
            for x in sorted((x for x in days if x["key"] == k), key=lambda x: x["day"]):
                total += x["n_events"]
                assert x["running_total"] == total


def test_a_ledger_in_separate_runs_restores_and_replaces(spark, tmp_path):
    schema = "key string, event_time timestamp_ntz, arrived timestamp_ntz"
    day = lambda n, h=5: T(2024, 3, 1, h) + dt.timedelta(days=n)
    runs = [
        [("a", day(0), day(0, 6)), ("a", day(20), day(20, 6)), ("a", day(40), day(40, 6)), ("b", day(1), day(1, 6))],
        [("a", day(38), day(41)), ("a", day(0), day(41)), ("a", day(41), day(41, 6))],  # one corrects, one is too late
        [("b", day(1), day(50)), ("a", day(41), day(42)), (None, day(3), day(3))],
    ]
    at, want = str(tmp_path / "ledger"), late_events.daily(spark.createDataFrame([x for r in runs for x in r], schema), batches=1)
    for i, r in enumerate(runs):
        late_events.Ledger(spark, at).ingest(spark.createDataFrame(r, schema), i)
        before = late_events.Ledger(spark, at).days().collect()
        late_events.Ledger(spark, at).ingest(spark.createDataFrame(r, schema), i)  # once more
        assert sorted(map(str, before)) == sorted(map(str, late_events.Ledger(spark, at).days().collect()))
    assert rows(late_events.Ledger(spark, at).days().drop("closed_from")) == rows(want)
    last = spark.read.parquet(f"{at}/state/batch=2").where("what = 0").collect()
    ordinal = day(0).toordinal() - dt.date(1970, 1, 1).toordinal()  # day 41 begins a block of its own
    assert {(x["key"], x["day"] - ordinal) for x in last} == {("a", 41), ("b", 1), ("\0", 3)}


def test_arrivals_fall_back_repeat_and_leave_out(spark):
    e = spark.createDataFrame(
        [("1", "l", "commit", "r", None, T(2024, 1, 5)), ("1", "l", "commit", "r", None, T(2024, 1, 4)), ("2", "l", "tag", "v", None, T(2024, 1, 4)), ("3", "l", "tag", "w", T(2024, 1, 1), None), (None, "l", "tag", "w", T(2024, 1, 1), T(2024, 1, 1))],
        "id string, library_id string, type string, ref string, event_at timestamp_ntz, created_at timestamp_ntz",
    )
    c = spark.createDataFrame([("l", "commit", "r", T(2024, 1, 3), 1), ("l", "commit", "r", T(2024, 1, 2), 2), ("l", "tag", "v", None, 3)], "library_id string, type string, ref string, event_at timestamp_ntz, key int")
    assert rows(late_events.arrivals(e, c)) == [("1", "l", T(2024, 1, 2), T(2024, 1, 4))]
    assert late_events.daily(late_events.arrivals(e.limit(0), c)).count() == 0


# ---- relational ----
def test_keyset_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(i, T(2024, 1, 1 + i // 7)) for i in range(100)], "id int, created_at timestamp_ntz")
    seen, after = [], None
    while True:
        page = relational.keyset_page(df, 9, after).collect()
        seen += [x["id"] for x in page[:9]]
        if len(page) <= 9:
            break
        after = (page[8]["created_at"], page[8]["id"])
    assert seen == sorted(range(100), key=lambda i: (i // 7, i), reverse=True)


def test_eviction_by_pressure_is_least_recently_used(spark):
    data = [(i, T(2024, 1, 1) + dt.timedelta(days=(i * 37) % 200), 10 + i % 5) for i in range(60)]
    df = spark.createDataFrame(data, "id int, last_accessed_at timestamp_ntz, size_bytes bigint")
    used, want = sum(x[2] for x in data), []
    left = used
    for i, _, s in sorted(data, key=lambda x: (x[1], x[0])):
        if left > 0.7 * used:
            want.append(i)
            left -= s
    assert sorted(x["id"] for x in relational.evicted_by_pressure(df, used, used, 0.8, 0.7).collect()) == sorted(want)
    assert relational.evicted_by_pressure(df, 10, 100).count() == 0


def test_rows_until_a_sentinel(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "s"), ("a", 3, "y"), ("b", 1, "z")], "k string, n int, ref string")
    assert rows(relational.until_sentinel(df, ["k"], "n", F.col("ref") == "s").select("k", "ref")) == [("a", "x"), ("b", "z")]


def test_queue_of_waiting_rows(spark):
    a = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id int, lib int")
    done, needed = spark.createDataFrame([(2,)], "ref int"), spark.createDataFrame([(20,), (20,)], "lib int")
    assert rows(relational.waiting(a, done, needed, ("id", "ref"), ("lib", "lib"))) == [(20, 3)] or rows(relational.waiting(a, done, needed, ("id", "ref"), ("lib", "lib")).select("id")) == [(3,)]


# ---- merge ----
def test_upsert_keeps_and_takes(spark):
    old = spark.createDataFrame([(1, "manual", "1"), (2, "scan", "1"), (3, "scan", "1")], "k int, src string, v string")
    new = spark.createDataFrame([(1, "scan", "2"), (2, "scan", None), (4, "scan", "2")], "k int, src string, v string")
    got = merge.upsert(old, new, ["k"], {"src": merge.keep_value("src", "manual"), "v": merge.keep_known("v")})
    assert rows(got) == [(1, "manual", "2"), (2, "scan", "1"), (3, "scan", "1"), (4, "scan", "2")]


def test_last_write(spark):
    f = spark.createDataFrame([("x", 1, "old", True), ("x", 2, None, False)], "k string, n int, v string, ext boolean")
    assert rows(merge.last_write_wins(f, ["k"], "n", ["ext"])) == [("x", 2, None, True)]


# ---- graph ----
def test_paths_against_brute_force(spark):
    r = random.Random(11)
    edges = sorted({("g", f"v{r.randrange(14)}", f"v{r.randrange(14)}") for _ in range(40)})
    edges = [e for e in edges if e[1] != e[2]]
    e = spark.createDataFrame(edges, "graph string, src string, dst string")
    s = spark.createDataFrame([("g", "v0")], "graph string, vertex string")
    out, walks, best = defaultdict(list), [["v0"]], {}
    for _, a, b in edges:
        out[a].append(b)
    trails = []
    for _ in range(4):
        walks = [[*w, b] for w in walks for b in out[w[-1]] if (w[-1], b) not in set(zip(w, w[1:]))]
        trails += walks
    for w in [["v0"], *sorted(trails, key=len)]:
        if len(w) == len(set(w)) and len(w) <= len(best.get(w[-1], [w])[0]):
            best.setdefault(w[-1], []).append(w)
    got = graph.shortest_paths(e, s, 4, 3).collect()
    assert {v: [x["path"] for x in sorted((x for x in got if x["vertex"] == v), key=lambda x: x["rank"])] for v in {x["vertex"] for x in got}} == {v: sorted(p)[:3] for v, p in best.items()}
    assert sorted(x["path"] for x in graph.trails(e, s, 4).collect()) == sorted(trails)
    assert {x["vertex"]: x["depth"] for x in graph.reach(e, s, 4).collect()} == {v: len(p[0]) - 1 for v, p in best.items()}


# ---- text, manifests, cursors, streaming ----
def test_text_functions(spark):
    df = spark.createDataFrame([("git@h.example:a/b.git", "fix(x)!: y (#12)", "Closes #7", "@@ -1 +1 @@ int foo(int a)\n+x\n@@ -9 +9 @@ struct bar\n@@ -9 +9 @@ foo(x)")], "u string, t string, m string, p string")
    got = df.select(text.repo_path("u"), text.repo_name("u"), text.title_prefix("t"), text.merge_number("t"), text.issue_number("t", "m"), text.hunk_functions("p"), text.html_escaped(F.lit("<a & \"b\">")), text.parsed_time(F.lit("no"))).first()
    assert tuple(got) == ("a/b", "b", "fix", 12, 7, ["foo", "bar"], "&lt;a &amp; &quot;b&quot;&gt;", None)
    assert spark.range(1).select(F.lit("AxB.c").rlike(text.glob_pattern("a?b.*")), F.lit("zAxB.c").rlike(text.glob_pattern("a?b.*"))).first()[:] == (True, False)


MANIFESTS = {
    "a/requirements.txt": ("# c\n-r x\nfoo==1.2\nbar>=2,<3\n", [("foo", "1.2"), ("bar", None)]),
    "a/pyproject.toml": ('[project]\ndependencies = ["foo[x]==1.0; python_version>\'3\'", "bar"]\n', [("foo", "1.0"), ("bar", None)]),
    "go.mod": ("module m\nrequire (\n github.com/a/b/v2 v1.2.3\n x.io/y v0.1 // indirect\n)\nrequire gitlab.com/c/d v1\n", [("github.com/a/b/v2", "1.2.3"), ("gitlab.com/c/d", "1")]),
    "x/Cargo.toml": ('[dependencies]\na = "1"\nb = {version = "2", git = "u"}\n', [("a", None), ("b", None)]),
    "pom.xml": ("<project xmlns='u'><properties><v>3</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>", [("g:a", "3")]),
    "build.gradle.kts": ('implementation("g:a:1.0")\ntestImplementation("g:a:2.0")\nksp "g:k:3"\ndebugImplementation(\'g:d\')\nclasspath "g:x:1"\n', [("g:a", "1.0"), ("g:k", "3"), ("g:d", None)]),
    "CMakeLists.txt": ("find_package(ZLIB 1.2)\nFIND_PACKAGE(Threads)\nfind_package(zlib)\nfind_package(GTest)\nfind_package(Gettext)\n", [("ZLIB", None), ("GTest", None)]),
    "conanfile.txt": ("[requires]\nfmt/9.1@u/c\n[options]\nx/1\n", [("fmt", "9.1")]),
    "vcpkg.json": ('{"dependencies": ["a", {"name": "b", "version>=": "2"}]}', [("a", None), ("b", None)]),
    "foundry.toml": ('[dependencies]\na = "1"\n', [("a", "1")]),
    "gitmodules": ('[submodule "x"]\n\tpath = x\n\turl = https://h/o/name.git\n', [("name", None)]),
    "bad/Cargo.toml": ("[[", []),
    "bad/pom.xml": ("<", []),
    "vcpkg.json.bak": ("{}", []),
}


def test_manifests_are_found_and_parsed(spark, tmp_path):
    for name, (content, _) in MANIFESTS.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    got = manifests.dependencies(manifests.discovered(spark, str(tmp_path))).collect()
    for name, (_, want) in MANIFESTS.items():
        own = sorted((x for x in got if x["path"].endswith(f"{tmp_path.name}/{name}")), key=lambda x: x["ordinal"])
        assert [(x["library_name"], x["resolved_version"]) for x in own] == want, name
    last = {x["library_name"]: x["detection_method"] for x in manifests.last_found(spark.createDataFrame(got, manifests.SCHEMA)).collect()}
    assert last["foo"] == "pyproject-toml"


def test_cursor_round_trip_and_tampering():
    c = cursor.encode(T(2024, 1, 2), "id", b"k")
    assert cursor.decode(c, b"k") == (T(2024, 1, 2, tzinfo=dt.timezone.utc), "id")
    for bad, key in ((c, b"other"), ("xx", b"k"), (c[:-6], b"k")):
        with pytest.raises(cursor.InvalidCursor):
            cursor.decode(bad, key)


def test_stream_equals_batch(spark, tmp_path):
    data = [(i, f"k{i % 13}") for i in range(60)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame(data[i * 20 : i * 20 + 20], "n int, k string").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):  # the second run finds nothing new
        run_available(spark, schema, src, str(tmp_path / "cp"), insert_ignore_into(spark, out, ["k"], "n"))
    assert sorted(x["k"] for x in spark.read.parquet(f"{out}/rows").collect()) == sorted({k for _, k in data})
