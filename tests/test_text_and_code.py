"""Text functions, debug records, merges and searches on small rows."""

from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import graph, merge
from strandline.sources import debug_info


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column("v")).first()[0]


def test_rules_in_order(spark):
    rows = [
        ("tag", "x", "fix: a", None, ("other", 0.95)),
        ("commit", "Dependabot[bot]", "fix: CVE-2024-1", None, ("other", 0.9)),
        ("commit", "x", "fix: heap overflow", None, None),
        ("commit", "x", "fix(core)!: a", "", ("normal_bugfix", 0.7)),
        ("commit", None, "  Feat: a", None, ("feature", 0.8)),
        ("commit", None, "wip: a", None, None),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "type string, author string, title string, message string")
    got = [tuple(r[0]) if r[0] else None for r in df.select(text.rule_class("type", "author", "title", "message")).collect()]
    assert got == [r[4] for r in rows]


def test_security_words_end_at_word_ends(spark):
    for said, hit in (("exploits a vulnerability", False), ("an exploit", True), ("null deref", True), ("NULL dereference", False), ("integer-overflow", True), (None, False)):
        assert bool(one(spark, said, text.security_words)) == hit, said


def test_replies(spark):
    cases = {
        'so {"label": " Bug_Fix ", "confidence": 1.7} done': ("normal_bugfix", 1.0),
        '{"label": "perf", "confidence": "high"}': ("other", 0.5),
        '{"confidence": -1}': ("other", 0.0),
        "{not json}": None,
        "none": None,
    }
    for reply, want in cases.items():
        got = one(spark, reply, text.reply_class)
        assert (tuple(got) if got else None) == want, reply
    assert one(spark, None, text.reply_class) is None


def test_hunks_modules_mounts_and_calls(spark):
    patch = "@@ -1,2 +1,3 @@ static int parse_url(const char *u)\n x\n@@ -9 +9 @@ struct tail\n@@ -10 +11 @@\n@@ -20 +21 @@ int parse_url(int)\n@@ -30 +31 @@ a = b;\n"
    assert one(spark, patch, text.hunk_functions) == ["parse_url", "tail"]
    assert one(spark, "github.com/a/b/v2", text.module_repo) == "https://github.com/a/b" and one(spark, "example.org/a/b", text.module_repo) is None
    assert one(spark, "/src/curl/lib/url.c", text.without_mount) == "lib/url.c" and one(spark, "lib/url.c", text.without_mount) == "lib/url.c"
    assert one(spark, 'f(x); /* g(1) */ if (h (2)) puts("k(3)"); // m(4)\nf(5);', text.called_names) == ["f", "h", "puts"]
    assert one(spark, 'a("/*"); b(); c("*/"); // "d(\nq("//"); e()', text.called_names) == ["a", "b", "c", "q", "e"]


def test_debug_records_in_any_order(spark):
    module = "\n".join([
        '!7 = distinct !DISubprogram(name: "f", linkageName: "_Zf", scope: !1, file: !3, line: 12, spFlags: DISPFlagDefinition, unit: !0)',
        '!3 = !DIFile(filename: "a.c", directory: "/src/curl/lib")',
        '!8 = distinct !DISubprogram(line: 5, spFlags: DISPFlagLocalToUnit | DISPFlagDefinition, file: !9, name: "g")',
        '!10 = !DISubprogram(name: "declared", file: !3, line: 1, flags: DIFlagPrototyped)',
        "garbage",
    ])
    got = debug_info.debug_functions(spark.createDataFrame([("m", module), ("n", None), ("o", "")], "k string, t string"), "k", "t")
    assert sorted(map(tuple, got.collect())) == [("m", "f", "_Zf", "lib/a.c", 12), ("m", "g", None, None, 5)]


def test_backends_agree(spark):
    rows = [("a", "b", "svf", 0.6, "fptr"), ("a", "b", "joern", 0.7, "direct"), ("a", "c", "joern", 0.4, "direct"), ("a", "c", "joern", 0.5, "direct"), ("a", "d", "x", 0.9, "direct"), ("a", "d", "svf", 0.95, "fptr"), ("a", "d", "joern", 0.9, "direct")]
    e = spark.createDataFrame(rows, "caller string, callee string, source_backend string, confidence double, call_type string")
    got = {r.callee: (r.backends, r.call_type, round(r.confidence, 6)) for r in graph.merged_backends(e, ["caller", "callee"], "source_backend", ["svf", "joern"]).collect()}
    assert got == {"b": ("joern+svf", "fptr", 0.7), "c": ("joern", "direct", 0.5), "d": ("joern+svf+x", "fptr", 1.0)}


def test_helpers_are_passed_through(spark):
    e = spark.createDataFrame([("g", "main", "h1"), ("g", "h1", "h2"), ("g", "h2", "h1"), ("g", "h2", "lib"), ("g", "lib", "deep"), ("g", "main", "main2")], "graph string, src string, dst string")
    s = spark.createDataFrame([("g", "main")], "graph string, vertex string")
    h = spark.createDataFrame([("g", "main", "h1"), ("g", "main", "h2")], "graph string, start string, vertex string")
    assert {r.callee for r in graph.through_helpers(e, s, h).collect()} == {"lib", "main2"}
    assert graph.through_helpers(e, s.limit(0), h).count() == 0


def test_names_conflict_cascades_and_order_of_sources(spark):
    old = spark.createDataFrame([("a", "u1"), ("b", None)], "name string, url string")
    new = spark.createDataFrame([("a", "u2"), ("b", None), ("c", "u3")], "name string, url string")
    fresh, conflicts = merge.upsert_by_name(old, new, "name", "url")
    assert fresh.collect() == [("c", "u3")] and conflicts.collect() == [("a", "u2", "u1")]
    first = merge.first_of_sources([old, new], "name")
    assert sorted(first.collect()) == [("a", "u1", 0), ("b", None, 0), ("c", "u3", 1)]
    top = spark.createDataFrame([(1,), (2,)], "id int")
    mid = spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id int, top int")
    low = spark.createDataFrame([(100, 10), (200, 20)], "id int, mid int")
    kept = merge.delete_cascade(top.where("id = 1"), {"top": (top, "id", None, None), "mid": (mid, "id", "top", "top"), "low": (low, "id", "mid", "mid")}, "id")
    assert [sorted(r.id for r in kept[t].collect()) for t in ("top", "mid", "low")] == [[2], [20, 30], [200]]


def test_folded_spellings(spark):
    rows = spark.createDataFrame([(" UAF ",), ("zzz",), (None,)], "v string")
    assert [r[0] for r in rows.select(text.folded(F.col("v"), text.VULN_TYPES, "other")).collect()] == ["use_after_free", "other", "other"]
