"""Files of repositories, registries, work orders, logs and reports, read and written by Spark's own sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources of the project itself, endings of sources.
SKIPPED = "build cmake-build .git .svn third_party third-party vendor node_modules __pycache__ .cache dist out".split()
SOURCES = ".c .cc .cpp .cxx .h .hh .hpp .hxx .go .rs .py .js .java".split()

REPOSITORIES = "name string, repo_url string, default_branch string, platform string"
ORDER = "repo_url string, version string, path string, build_script string, backend string, language string, fuzzer_sources map<string,array<string>>, diff_files array<string>, ai_refine boolean"


def source_files(spark: SparkSession, root: str, skipped: Sequence[str] = SKIPPED, endings: Sequence[str] = SOURCES) -> DataFrame:
    """(path, bytes, content) of the sources below a folder, none from a skipped folder at any depth; path is below root."""
    at = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at)
    path = F.substring_index(F.col("path"), f"{at}/", -1)
    files = files.select(path.alias("path"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return files.where(~F.arrays_overlap(folders, F.lit(list(skipped))) & F.regexp_extract("path", r"\.[^./]*$", 0).isin(list(endings)))


def looked_up(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (name, path) with the content of its source: the file of that path, else the first one of the same last part."""
    base = F.substring_index(F.col("path"), "/", -1)
    by_base = files.select(base.alias("base"), F.struct("path", "content").alias("f")).groupBy("base").agg(F.min("f").alias("any"))
    got = wanted.withColumn("base", base).join(files.select("path", F.col("content").alias("exact")), "path", "left").join(by_base, "base", "left")
    return got.select("name", "path", F.coalesce("exact", "any.content", F.lit("")).alias("code"))


def registered(spark: SparkSession, root: str) -> DataFrame:
    """Rows of root/<ecosystem>/repos.json files, each an array of repositories."""
    rows = spark.read.schema(REPOSITORIES).option("multiLine", True).json(f"{root.rstrip('/')}/*/repos.json")
    return rows.select("*", F.element_at(F.split(F.input_file_name(), "/"), -2).alias("ecosystem"))


def work_orders(spark: SparkSession, path: str) -> DataFrame:
    """Work orders from JSON files with what is wrong with each in ``problems``; a file that is no JSON has all fields null."""
    rows = spark.read.schema(ORDER).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    missing = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in ("repo_url", "version")]
    none = F.when(F.coalesce(F.cardinality("fuzzer_sources"), F.lit(0)) <= 0, F.lit("fuzzer_sources is empty"))
    return rows.withColumn("problems", F.filter(F.array(*missing, none), lambda p: p.isNotNull()))


def append_log(lines: DataFrame, folder: str) -> None:
    """Appends (snapshot_id, phase, line) rows to a text log of each snapshot and phase."""
    lines.select("snapshot_id", "phase", F.col("line").alias("value")).write.partitionBy("snapshot_id", "phase").mode("append").text(folder)


def read_log(spark: SparkSession, folder: str, snapshot_id: str, phase: str) -> DataFrame:
    """The lines of one snapshot and phase."""
    rows = spark.read.schema("value string, snapshot_id string, phase string").text(folder)
    return rows.where((F.col("snapshot_id") == snapshot_id) & (F.col("phase") == phase)).select(F.col("value").alias("line"))


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """A table in Markdown, as text files in order: a title and head before the rows."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in rows.columns]
    head = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    top = rows.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head)], "place int, value string")
    body = rows.select(F.lit(len(head)).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    top.unionByName(body).orderBy("place", "value").select("value").write.mode("overwrite").text(path)


def with_branches(repositories: DataFrame, branches: DataFrame) -> DataFrame:
    """repositories with the default branch that was found (name, branch) where it differs."""
    found = branches.where("branch <> ''").groupBy("name").agg(F.max("branch").alias("branch"))
    return repositories.join(found, "name", "left").withColumn("default_branch", F.coalesce("branch", "default_branch")).select(*repositories.columns)
