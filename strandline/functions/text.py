"""Text functions as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repo_path(url: Column | str) -> Column:
    """'owner/name' of a repository URL (https, ssh, with or without .git or a last slash); null without both parts."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(_c(url)), r"/+$", ""), r"\.git$", "")
    got = F.regexp_extract(bare, r"^(?:[a-z+]+://(?:[^/@]+@)?[^/]+/|[^/@]+@[^/:]+:)(?:.*/)?([^/]+/[^/]+)$", 1)
    return F.when(got != "", got)


def repo_name(url: Column | str) -> Column:
    """The last part of a URL without .git."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(F.trim(_c(url)), r"/+$", ""), "/", -1), r"\.git$", "")


def html_escaped(c: Column | str) -> Column:
    out = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def issue_number(title: Column | str, message: Column | str) -> Column:
    """The first issue that title or message says it fixes, closes or resolves; null if none."""
    got = F.regexp_extract(F.concat_ws("\n", _c(title), _c(message)), r"(?i)\b(?:fix(?:e[sd])?|close[sd]?|resolve[sd]?)\s+#(\d+)\b", 1)
    return F.when(got != "", got.cast("bigint"))


def merge_number(title: Column | str) -> Column:
    """The merge request in brackets in a title, '(#12)'; null if none."""
    got = F.regexp_extract(_c(title), r"\(#(\d+)\)", 1)
    return F.when(got != "", got.cast("bigint"))


def title_prefix(title: Column | str) -> Column:
    """The type before the colon of a conventional title, in lower case: 'fix(x)!: y' gives 'fix'; null if none."""
    got = F.lower(F.regexp_extract(_c(title), r"^(\w+)(?:\([^)]*\))?!?:\s", 1))
    return F.when(got != "", got)


def parsed_time(c: Column | str) -> Column:
    """An ISO 8601 time; null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(_c(c), "Z$", "+00:00"))


def glob_pattern(glob: str) -> str:
    """A pattern for rlike that matches the whole text whatever its case; * and ? as in file names."""
    return "(?is)^(?:" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + ")$"


def hunk_functions(patch: Column | str) -> Column:
    """The functions named after the @@ of a patch's hunks, each once in order: the word before the first bracket, or the
    last word of a line without brackets if it can be a name."""
    heads = F.regexp_extract_all(_c(patch), F.lit(r"(?m)^@@.*@@[ \t]+(.+)$"), 1)
    named = lambda h: F.when(h.rlike(r"\w\s*\("), F.regexp_extract(h, r"(\w+)\s*\(", 1)).otherwise(F.regexp_extract(h, r"(?:^|\s)([A-Za-z_]\w*)\s*$", 1))
    return F.array_distinct(F.filter(F.transform(heads, named), lambda n: n != ""))


def is_c_file(path: Column | str) -> Column:
    return _c(path).rlike(r"\.(c|cc|cpp|cxx|h|hh|hpp|hxx)$")


# Words that speak of security, authors that are bots, what a title's prefix says (class, confidence),
# spellings of event classes, of kinds of vulnerabilities and of severities.
SECURITY_WORDS = (
    r"CVE-\d{4}-\d+|CWE-\d+|vulnerab|exploit|security|"
    r"buffer.?over(?:flow|read|write)|heap.?over(?:flow|read|write)|stack.?over(?:flow|read|write)|"
    r"use.?after.?free|double.?free|out.?of.?bounds|oob|integer.?(?:over|under)flow|null.?(?:pointer|ptr|deref)|"
    r"uninitiali[sz]ed|race.?condition|TOCTOU|injection|XSS|CSRF|SSRF|auth.?bypass|privilege.?escalat|"
    r"info(?:rmation)?.?leak|denial.?of.?service|dos\b|memory.?corrupt|memory.?safety"
)
BOTS = "dependabot|renovate|greenkeeper|snyk-bot|github-actions|semantic-release-bot|mergify|codecov|depfu"
PREFIXES = {
    "fix": ("normal_bugfix", 0.70), "feat": ("feature", 0.80), "refactor": ("refactor", 0.80),
    "docs": ("other", 0.85), "test": ("other", 0.85), "perf": ("other", 0.85), "ci": ("other", 0.85), "chore": ("other", 0.85), "build": ("other", 0.85),
}
CLASSES = {
    "security_bugfix": "security_bugfix", "security": "security_bugfix",
    "normal_bugfix": "normal_bugfix", "bugfix": "normal_bugfix", "bug_fix": "normal_bugfix", "bug": "normal_bugfix",
    "feature": "feature", "refactor": "refactor", "refactoring": "refactor",
}  # all else: other
VULN_TYPES = {
    "buffer_overflow": ("buffer_overflow", "heap_overflow", "stack_overflow", "buffer_overread", "heap_buffer_overflow", "stack_buffer_overflow", "oob_read", "oob_write", "out_of_bounds"),
    "use_after_free": ("use_after_free", "double_free", "uaf", "use-after-free"),
    "integer_overflow": ("integer_overflow", "int_overflow", "integer_underflow"),
    "null_deref": ("null_deref", "null_pointer", "null_dereference", "nullptr"),
    "injection": ("injection", "command_injection", "sql_injection", "header_injection"),
    "auth_bypass": ("auth_bypass", "authentication_bypass", "authorization_bypass"),
    "info_leak": ("info_leak", "information_leak", "information_disclosure", "uninitialized_memory"),
    "dos": ("dos", "denial_of_service", "infinite_loop"),
    "race_condition": ("race_condition", "toctou", "data_race"),
    "memory_corruption": ("memory_corruption",),
}  # all else: other
SEVERITIES = {"critical": ("critical", "severe"), "high": ("high", "important"), "medium": ("medium", "moderate"), "low": ("low", "minor", "negligible")}  # all else: unknown


def security_words(c: Column | str) -> Column:
    """All words of a text that speak of security, as they stand; null for null."""
    return F.regexp_extract_all(_c(c), F.lit(rf"(?i)\b(?:{SECURITY_WORDS})\b"), 0)


def rule_class(kind: Column | str, author: Column | str, title: Column | str, message: Column | str) -> Column:
    """What cheap rules say of an event, struct(classification, confidence); null where none decides.

    In order: tags and bots' events are "other"; nothing is said of texts with words of security; then the title's prefix.
    """
    said = lambda name, sure: F.struct(F.lit(name).alias("classification"), F.lit(sure).alias("confidence"))
    text = F.concat(F.coalesce(_c(title), F.lit("")), F.lit(" "), F.coalesce(_c(message), F.lit("")))
    rule = F.when(_c(kind) == "tag", said("other", 0.95)).when(_c(author).rlike(rf"(?i)\b(?:{BOTS})\b"), said("other", 0.90))
    rule = rule.when(text.rlike(rf"(?i)\b(?:{SECURITY_WORDS})\b"), F.lit(None))
    prefix = title_prefix(F.trim(_c(title)))
    for p, (name, sure) in PREFIXES.items():
        rule = rule.when(prefix == p, said(name, sure))
    return rule


def reply_class(reply: Column | str) -> Column:
    """struct(classification, confidence) of the first flat JSON object in a scorer's reply; null without one.

    Labels are folded to their class, unknown ones to "other"; the confidence is cut to 0..1 and 0.5 where it's no number.
    """
    found = F.regexp_extract(_c(reply), r"\{[^{}]*\}", 0)
    label = F.lower(F.trim(F.get_json_object(found, "$.label")))
    name = F.lit("other")
    for alias, to in CLASSES.items():
        name = F.when(label == alias, to).otherwise(name)
    sure = F.coalesce(F.get_json_object(found, "$.confidence").try_cast("double"), F.lit(0.5))
    parsed = F.try_parse_json(F.when(found != "", found))
    return F.when(parsed.isNotNull(), F.struct(name.alias("classification"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence")))


def folded(c: Column | str, spellings: dict, default: str) -> Column:
    """The name whose spellings hold the value in lower case; the default for all else and for nulls."""
    out = F.lit(default)
    for name, known in spellings.items():
        out = F.when(F.lower(F.trim(_c(c))).isin(list(known)), name).otherwise(out)
    return out


def module_repo(module: Column | str) -> Column:
    """The repository of a Go module on one of three known hosts, from its first three parts; else null."""
    parts = F.split(_c(module), "/")
    return F.when(parts[0].isin("github.com", "gitlab.com", "bitbucket.org") & (F.size(parts) >= 3), F.concat(F.lit("https://"), F.array_join(F.slice(parts, 1, 3), "/")))


def without_mount(path: Column | str) -> Column:
    """A path within a build container, /src/<name>/x/y.c, relative to the project: x/y.c; others stay."""
    return F.regexp_replace(_c(path), r"^/src/[^/]+/", "")


def called_names(content: Column | str) -> Column:
    """The distinct words before an opening bracket in a source text, outside comments and strings, without keywords."""
    # whichever of string, block and line comment begins first ends first
    bare = F.regexp_replace(_c(content), r'(?s)("(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|/\*.*?\*/|//[^\n]*', "$1 ")
    bare = F.regexp_replace(bare, r'"(?:[^"\\\n]|\\.)*"', '""')
    names = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b([A-Za-z_]\w*)\s*\("), 1))
    return F.filter(names, lambda n: ~n.isin("if", "for", "while", "switch", "return", "sizeof", "catch", "do", "else", "defined"))


def named_function(summary: Column | str) -> Column:
    """The function that a flaw's summary names, a word with an underscore or a capital within; null if none."""
    got = F.regexp_extract(_c(summary), r"(?:before|in|when) ([A-Za-z_]\w*[A-Z_]\w*)", 1)
    return F.when(got != "", got)


def moved(registered: Column | str, found: Column | str) -> Column:
    """"redirects" where the address that answers is another than the registered one, whatever its case, a last slash and
    .git; else "same"; null where none answers."""
    bare = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.trim(_c(c)), r"/+$", ""), r"\.git$", ""))
    return F.when(bare(found) != bare(registered), "redirects").when(_c(found).isNotNull(), "same")


# A package's links that name its sources, in order of preference.
SOURCE_LINKS = ("source", "source code", "repository", "github", "code", "homepage")


def _on_forge(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?:https?://|git@)(?:www\.)?github\.com[/:][^/\s]+/[^/\s]+"), F.lit(False))


def linked_repo(links: Column | str, home: Column | str) -> Column:
    """The repository among a package's links (map of label to URL): by the labels in SOURCE_LINKS in their order and
    whatever their case, else the first of any label, else its home page; null where none leads to a repository."""
    found = F.filter(F.map_entries(_c(links)), lambda e: _on_forge(e["value"]))
    ranked = F.transform(found, lambda e, i: F.struct(F.coalesce(F.nullif(F.array_position(F.lit(list(SOURCE_LINKS)), F.lower(e["key"])), F.lit(0)), F.lit(99)).alias("place"), i.alias("i"), e["value"].alias("url")))
    return F.coalesce(F.array_min(ranked)["url"], F.when(_on_forge(_c(home)), _c(home)))


def pom_repo(pom: Column | str) -> Column:
    """The repository that a POM names: the address of its scm, its connections without their prefix, its own address; null
    where none leads to a repository, and for texts without a project."""
    bare = F.regexp_replace(_c(pom), r"(?s)<!--.*?-->|<(dependencies|dependencyManagement|build|licenses|developers|organization|parent)\b[^>]*>.*?</\1>", "")
    scm = F.regexp_extract(bare, r"(?s)<scm\b[^>]*>(.*?)</scm>", 1)
    own = F.regexp_replace(bare, r"(?s)<scm\b[^>]*>.*?</scm>", "")
    tag = lambda text, name: F.trim(F.regexp_extract(text, rf"(?s)<{name}>(.*?)</{name}>", 1))
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "^scm:(?:git|svn):", ""), r"^git://github\.com/", "https://github.com/")
    ways = [tag(scm, "url"), plain(tag(scm, "connection")), plain(tag(scm, "developerConnection")), tag(own, "url")]
    return F.when(bare.contains("<project"), F.coalesce(*(F.when(_on_forge(w), w) for w in ways)))


def line_slice(content: Column | str, first: Column | str, last: Column | str) -> Column:
    """The lines first to last, from 1, of a text; null where the text has no line first or any of them is null."""
    lines = F.split(_c(content), "\n")
    inside = (_c(first) >= 1) & (_c(first) <= F.size(lines)) & (_c(last) >= _c(first))
    return F.when(inside, F.array_join(F.slice(lines, F.greatest(_c(first), F.lit(1)), F.greatest(_c(last) - _c(first) + 1, F.lit(0))), "\n"))


def reply_findings(reply: Column | str) -> Column:
    """array<struct(vuln_type, severity, summary)> of a scorer's reply: its JSON array, else its one object; null for none.

    Kinds and severities are folded to their names, unknown ones to "other" and "unknown".
    """
    kind = "struct<vuln_type:string,severity:string,summary:string>"
    many = F.from_json(F.regexp_extract(_c(reply), r"(?s)\[\s*\{.*\}\s*\]", 0), f"array<{kind}>")
    one = F.from_json(F.regexp_extract(_c(reply), r"(?s)\{.*\}", 0), kind)
    known = lambda x: x.isNotNull() & F.coalesce(x["vuln_type"], x["severity"], x["summary"]).isNotNull()
    found = F.filter(F.coalesce(many, F.array(one)), known)
    named = F.transform(found, lambda x: F.struct(folded(x["vuln_type"], VULN_TYPES, "other").alias("vuln_type"), folded(x["severity"], SEVERITIES, "unknown").alias("severity"), x["summary"].alias("summary")))
    return F.when(F.size(named) > 0, named)


_PARTS = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?(?:\*/|\Z)|[{}\n]', re.S)


def lines_to_end(source: str, most: int = 2000) -> int:
    """The line, from 1, in which the braces of a function's source close; 1 where they don't within ``most`` lines."""
    line, depth, opened = 1, 0, False
    for m in _PARTS.finditer(source):
        part = m.group()
        if part == "{":
            depth, opened = depth + 1, True
        elif part == "}":
            depth -= 1
            if opened and not depth:
                return line
        else:
            line += part.count("\n")
            if line > most:
                break
    return 1


def body_lines(content: Column | str) -> Column:
    """``lines_to_end`` of each source; null for null."""

    @F.pandas_udf("int")
    def ends(sources: pd.Series) -> pd.Series:
        return sources.map(lines_to_end, na_action="ignore").astype("Int32")

    return ends(_c(content))
