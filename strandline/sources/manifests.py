"""Dependencies from manifests: rows (path, content) to one row per dependency.

Files are read in Spark's binary or text sources (``discovered``); each is parsed within its Arrow batch by a small
function of its kind. Constraint and resolved version are null where a manifest says none.
"""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, ordinal int, library_name string, library_repo_url string, constraint_expr string, resolved_version string, detection_method string"
Found = tuple[str, str | None, str | None, str | None]  # name, repository, constraint, version


def pip_requirements(text: str) -> Iterator[Found]:
    for line in map(str.strip, text.splitlines()):
        m = re.match(r"[A-Za-z0-9][\w.-]*", line)
        if m and not line.startswith(("#", "-")):
            rest = line[m.end() :].strip()
            exact = re.fullmatch(r"==\s*([^\s,;=#]+)", rest)
            yield m.group(), None, rest or None, exact and exact.group(1)


def pyproject(text: str) -> Iterator[Found]:
    for spec in tomllib.loads(text).get("project", {}).get("dependencies", []):
        m = re.match(r"\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*(.*)", spec.split(";")[0])
        if m:
            exact = re.fullmatch(r"==\s*([^\s,=]+)", m.group(2).strip())
            yield m.group(1), None, m.group(2).strip() or None, exact and exact.group(1)


def go_mod(text: str) -> Iterator[Found]:
    block = False
    for line in map(str.strip, text.splitlines()):
        if line.startswith("require ("):
            block = True
        elif block and line == ")":
            block = False
        elif (block or line.startswith("require ")) and not line.startswith("//") and "// indirect" not in line:
            parts = line.removeprefix("require ").split()
            if len(parts) >= 2:
                host = parts[0].split("/")
                repo = "https://" + "/".join(host[:3]) if host[0] in ("github.com", "gitlab.com", "bitbucket.org") and len(host) >= 3 else None
                yield parts[0], repo, parts[1], parts[1].removeprefix("v")


def cargo(text: str) -> Iterator[Found]:
    doc = tomllib.loads(text)
    for part in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, spec in doc.get(part, {}).items():
            spec = {"version": spec} if isinstance(spec, str) else spec
            yield name, spec.get("git"), spec.get("version"), None


def maven(text: str) -> Iterator[Found]:
    root = ElementTree.fromstring(text)
    local = lambda e: e.tag.rpartition("}")[2]
    props = {local(p): (p.text or "").strip() for e in root if local(e) == "properties" for p in e}
    fill = lambda s: re.sub(r"\$\{([^}]+)\}", lambda m: props.get(m.group(1), m.group()), s)
    for e in root.iter():
        if local(e) == "dependency":
            d = {local(c): fill((c.text or "").strip()) for c in e}
            if d.get("groupId") and d.get("artifactId"):
                v = d.get("version") or None
                yield f"{d['groupId']}:{d['artifactId']}", None, v, v if v and "${" not in v else None


# Configurations of a Gradle build, packages of CMake that are no libraries.
GRADLE = "implementation api compileOnly compileOnlyApi runtimeOnly annotationProcessor kapt ksp testImplementation testCompileOnly testRuntimeOnly optional provided compile runtime testCompile testRuntime".split()
GRADLE_ENDS = "Implementation Api CompileOnly RuntimeOnly".split()
CMAKE_TOOLS = frozenset("perl python python2 python3 threads pkgconfig pkg-config git doxygen latex java jni swig bison flex gperf gettext intl patch backtrace".split())
GRADLE_LINE = re.compile(rf"""(?:{"|".join(sorted(GRADLE, key=len, reverse=True))}|\w+(?:{"|".join(GRADLE_ENDS)}))\s*\(?\s*["']([\w.-]+):([\w.-]+)(?::([\w.+-]+))?["']""", re.A)


def gradle(text: str) -> Iterator[Found]:
    seen = set()
    for group, artifact, version in GRADLE_LINE.findall(text):
        name = f"{group}:{artifact}"
        if name not in seen:
            seen.add(name)
            yield name, None, version or None, version or None


def cmake(text: str) -> Iterator[Found]:
    seen = set(CMAKE_TOOLS)
    for name, least in re.findall(r"(?i)find_package\s*\(\s*(\w[\w+-]*)(?:\s+(\d[\w.+-]*))?", text, re.A):
        if name.lower() not in seen:
            seen.add(name.lower())
            yield name, None, f">={least}" if least else None, None


def conan(text: str) -> Iterator[Found]:
    part = None
    for line in map(str.strip, text.splitlines()):
        if line.startswith("["):
            part = line.strip("[]")
        elif part == "requires" and (m := re.match(r"([\w.+-]+)/([^\s@#]+)", line)):
            yield m.group(1), None, f"=={m.group(2)}", m.group(2)


def vcpkg(text: str) -> Iterator[Found]:
    for d in json.loads(text).get("dependencies", []):
        d = {"name": d} if isinstance(d, str) else d if isinstance(d, dict) else {}
        v = d.get("version>=") or d.get("version")
        if d.get("name"):
            yield d["name"], None, v and f">={v}", None


def foundry(text: str) -> Iterator[Found]:
    for name, spec in tomllib.loads(text).get("dependencies", {}).items():
        spec = {"version": spec} if isinstance(spec, str) else spec
        yield name, spec.get("url"), spec.get("version"), spec.get("version")


def submodules(text: str) -> Iterator[Found]:
    ini = configparser.ConfigParser(strict=False, interpolation=None)
    ini.read_string("\n".join(map(str.strip, text.splitlines())))
    for part in ini.sections():
        if url := ini[part].get("url"):
            yield url.rstrip("/").removesuffix(".git").rpartition("/")[2].rpartition(":")[2], url, None, None


#: Detection method: (pattern of the path, parser), in the order in which a later find of a library wins.
PARSERS: dict[str, tuple[str, Callable[[str], Iterator[Found]]]] = {
    "cargo-toml": (r"(^|/)Cargo\.toml$", cargo),
    "cmake-find-package": (r"(^|/)CMakeLists\.txt$", cmake),
    "conan": (r"(^|/)conanfile\.txt$", conan),
    "foundry-soldeer": (r"(^|/)foundry\.toml$", foundry),
    "git-submodule": (r"(^|/)\.?gitmodules$", submodules),
    "go-mod": (r"(^|/)go\.mod$", go_mod),
    "gradle": (r"(^|/)build\.gradle(\.kts)?$", gradle),
    "maven-pom": (r"(^|/)pom\.xml$", maven),
    "pip-requirements": (r"(^|/)requirements(\.txt|/[^/]+\.txt)$", pip_requirements),
    "pyproject-toml": (r"(^|/)pyproject\.toml$", pyproject),
    "vcpkg": (r"(^|/)vcpkg\.json$", vcpkg),
}


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the manifests below a folder. Spark's sources skip names with a leading dot, so a mirror keeps
    .gitmodules as gitmodules, or hands its rows to ``dependencies`` itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.toml,*.txt,*.mod,*.xml,*.gradle,*.kts,*.json,gitmodules}").load(root)
    return files.where(F.col("path").rlike("|".join(p for p, _ in PARSERS.values()))).select("path", F.decode("content", "UTF-8").alias("content"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """The dependencies of (path, content) rows; files that can't be parsed have none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, content in zip(p["path"], p["content"]):
                for method, (pattern, parse) in PARSERS.items():
                    if re.search(pattern, path or ""):
                        try:
                            out += [(path, i, *d, method) for i, d in enumerate(parse(content or ""))]
                        except (ValueError, ElementTree.ParseError, configparser.Error, AttributeError, TypeError):
                            pass
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return manifests.select("path", "content").mapInPandas(run, SCHEMA)


def last_found(deps: DataFrame) -> DataFrame:
    """One row per library, the one found last in order of method, path and place."""
    return deps.groupBy("library_name").agg(F.max_by(F.struct(*[c for c in deps.columns if c != "library_name"]), F.struct("detection_method", "path", "ordinal")).alias("r")).select("library_name", "r.*")
