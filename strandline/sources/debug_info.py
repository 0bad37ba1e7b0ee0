"""Debug information in the text form of LLVM modules, read with Spark's own text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import without_mount
from strandline.operators.relational import in_chunks


def debug_functions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, linkage_name, file_path, line) of the defined functions in module texts, one or several a key.

    A DISubprogram names its DIFile by number; one without a known file has a null path. Paths are taken relative to the
    project within the build container. Order of fields and escapes in other fields don't matter, as each is read alone.
    """
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("line"))
    files = lines.where(F.col("line").rlike(r"^!\d+ = (?:distinct )?!DIFile\(")).select(
        key, F.regexp_extract("line", r"^!(\d+)", 1).alias("file"), F.regexp_extract("line", r'[( ]filename: "([^"]*)"', 1).alias("filename"), F.regexp_extract("line", r'[( ]directory: "([^"]*)"', 1).alias("directory")
    )
    whole = F.when(F.col("filename").startswith("/") | (F.col("directory") == ""), F.col("filename")).otherwise(F.concat_ws("/", "directory", "filename"))
    files = files.select(key, "file", without_mount(whole).alias("file_path")).dropDuplicates([key, "file"])
    subs = lines.where(F.col("line").rlike(r"^!\d+ = (?:distinct )?!DISubprogram\(") & F.col("line").contains("DISPFlagDefinition")).select(
        key,
        F.regexp_extract("line", r'[( ]name: "([^"]*)"', 1).alias("name"),
        F.nullif(F.regexp_extract("line", r'[( ]linkageName: "([^"]*)"', 1), F.lit("")).alias("linkage_name"),
        F.regexp_extract("line", r"[( ]file: !(\d+)", 1).alias("file"),
        F.regexp_extract("line", r"[( ]line: (\d+)", 1).try_cast("int").alias("line"),
    )
    return subs.where("name <> ''").join(files, [key, "file"], "left").select(key, "name", "linkage_name", "file_path", "line")


def with_debug(functions: DataFrame, metas: DataFrame, key: str, ordinal: str) -> DataFrame:
    """functions (key, name) with what the debug records (key, ir_name, original_name, ordinal, ...) say of them.

    A record stands under its name in the module and, where that is another, under its name in the source; of several
    under one name the last by ordinal holds. A function without a record is external: all its other columns are null.
    Null and blank names are none.
    """
    rest = [c for c in metas.columns if c not in (key, "ir_name", "original_name", ordinal)]
    names = F.array_distinct(F.array("ir_name", "original_name"))
    under = metas.select(key, F.explode(names).alias("name"), ordinal, *rest).where("name <> ''")
    last = under.groupBy(key, "name").agg(F.max_by(F.struct(*rest), ordinal).alias("m"))
    return functions.join(last, [key, "name"], "left").select(*functions.columns, *(F.col(f"m.{c}").alias(c) for c in rest), F.col("m").isNull().alias("is_external"))


def debug_text(functions: DataFrame, key: str) -> DataFrame:
    """(key, text): functions (key, name, file_path, line) written as modules' debug records, in texts of a
    bounded number of lines."""
    number = lambda *c: F.abs(F.xxhash64(*c)).cast("string")
    files = functions.select(key, "file_path").distinct().select(key, F.concat(F.lit("!"), number("file_path"), F.lit(' = !DIFile(filename: "'), F.col("file_path"), F.lit('", directory: "/src/project")')).alias("line"))
    subs = functions.select(key, F.concat(F.lit("!"), number("name", "file_path", "line"), F.lit(' = distinct !DISubprogram(name: "'), F.col("name"), F.lit('", scope: !1, file: !'), number("file_path"), F.lit(", line: "), F.col("line").cast("string"), F.lit(", spFlags: DISPFlagDefinition, unit: !0)")).alias("line"))
    return in_chunks(files.unionByName(subs), [key], ["line"]).groupBy(key, "chunk").agg(F.concat_ws("\n", F.collect_list("line")).alias("text")).drop("chunk")
