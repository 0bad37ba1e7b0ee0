"""Call graphs in DOT text, read with Spark's own text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.relational import in_chunks

NODE = r'^\s*"?(\w+)"?\s*\[.*label="\{?(?:fun: )?([^"{}\\|]+)'


def dot_edges(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, caller, callee) of DOT texts, one or several a key: labelled nodes joined to both ends, unknown ends and loops dropped."""
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("line"))
    nodes = lines.where(F.col("line").rlike(NODE)).select(key, F.regexp_extract("line", NODE, 1).alias("n"), F.trim(F.regexp_extract("line", NODE, 2)).alias("name")).dropDuplicates([key, "n"])
    edge = r'^\s*"?(\w+)"?(?::\w+)?\s*->\s*"?(\w+)"?'
    edges = lines.where(F.col("line").rlike(edge)).select(key, F.regexp_extract("line", edge, 1).alias("a"), F.regexp_extract("line", edge, 2).alias("b"))
    named = edges.join(nodes.select(key, F.col("n").alias("a"), F.col("name").alias("caller")), [key, "a"]).join(nodes.select(key, F.col("n").alias("b"), F.col("name").alias("callee")), [key, "b"])
    return named.where("caller <> callee").select(key, "caller", "callee").distinct()


def dot_names(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name): the distinct labels of the nodes in DOT texts, also of nodes without an edge."""
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(NODE))
    return lines.select(key, F.trim(F.regexp_extract("line", NODE, 2)).alias("name")).distinct()


def typed_edges(final: DataFrame, initial: DataFrame, key: str) -> DataFrame:
    """The final edges: direct where the initial graph has them, else through a function pointer."""
    known = initial.select(key, "caller", "callee").distinct().withColumn("direct", F.lit(True))
    return final.join(known, [key, "caller", "callee"], "left").select(key, "caller", "callee", F.when(F.col("direct"), "direct").otherwise("fptr").alias("call_type"))


def dot_text(edges: DataFrame, key: str) -> DataFrame:
    """(key, text): edges (key, caller, callee) written as DOT, in texts of a bounded number of lines; nodes get the names' hashes
    as ids, so that the texts of a key are read together."""
    node = lambda c: F.concat(F.lit("N"), F.lower(F.hex(F.xxhash64(c))))
    names = edges.select(key, F.explode(F.array("caller", "callee")).alias("name")).distinct()
    lines = names.select(key, F.concat(F.lit("\t"), node("name"), F.lit(' [shape=record,label="{'), F.col("name"), F.lit('}"];')).alias("line"))
    lines = lines.unionByName(edges.select(key, F.concat(F.lit("\t"), node("caller"), F.lit(" -> "), node("callee"), F.lit(";")).alias("line")))
    return in_chunks(lines, [key], ["line"]).groupBy(key, "chunk").agg(F.concat(F.lit("digraph {\n"), F.concat_ws("\n", F.collect_list("line")), F.lit("\n}")).alias("text")).drop("chunk")
