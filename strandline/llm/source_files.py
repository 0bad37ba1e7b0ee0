"""Problem 6: generated, minified, vendored source files and data in the shape of code.

Every distinct content is described once by a few counts (characters of data, packed lines, tool marks in the comments above
the code, a named project) and the winnowed fingerprints of its token stream: comments dropped, white space ignored, numbers
and strings replaced; of each ``WINDOW`` neighbouring hashes of ``GRAM`` tokens the smallest is kept, so any copied run of
``GRAM + WINDOW - 1`` tokens leaves a common fingerprint. Runs with few names (tables of numbers) say nothing of where they
come from and leave none. A fingerprint recurs when several libraries hold it. Files whose fingerprints largely recur in
more than ``UNRELATED`` owners' libraries are copies; a sign of where they came from (a vendor folder, a foreign project's
banner) lowers the share that must recur, but is never enough: a copy that no other library holds is not found. What later
snapshots of a library keep never counts, as only distinct (fingerprint, library) pairs do.

Nothing is grouped by library or repository. Fingerprints are told apart by the least and greatest library that holds them,
with partial aggregation; only those that recur go on. Those in at least ``HOT_ROWS`` contents, at most ``MAX_HOT``
of them, are looked up by broadcast, all others by shuffle.

Defined cases: a null or blank file_path is no file; null or empty content adds nothing, a file of only such records is
hand-written; repeated rows of a function count once; a null library_id is a library of its own; contents of fewer than
``GRAM`` tokens have no fingerprints and are never copies; very long lines and contents are read whole; an empty table gives
no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import checkpointed, scratch_path

GRAM, WINDOW, NAMES = 24, 16, 7
#: Share of a file's fingerprints that must recur without and with a sign of where it came from; without one, how many
#: must (fewer are an idiom), and by how many owners most of them must be held at least.
COPIED_SHARE, SIGNED_SHARE, LEAST_SHARED, UNRELATED = 0.7, 0.05, 4, 2
#: Contents in which a fingerprint is hot, and how many hot ones are broadcast at most (the commonest; others shuffle).
HOT_ROWS, MAX_HOT = 100_000, 1_000

TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|[^\w\s]")
COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*|(?m:^[ \t]*#(?!\s*(?:include|define|if|ifdef|ifndef|else|endif|elif|line|pragma|undef|error)\b)[^\n]*)", re.S)
STRING = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')
COMMENT_TEXT = re.compile(r"/\*(.*?)\*/|(?:^|[ \t;{}])(?://+|#+)([^\n]*)|<!--(.*?)-->", re.S | re.M)

# What tools write above their output.
TOOL = re.compile(
    r"@generated\b|<auto-?generated\b|\bdo not (?:edit|modify|change|make (?:any )?(?:changes|edits))\b(?:,? (?:it|here|this file|this|manually|by hand|directly))*\W*(?:$|[.;!*])"
    r"|changes (?:here |to this file )?(?:will|may) be (?:lost|overwritten|discarded)"
    r"|^\W*(?:this (?:file|code|source|module|wrapper|parser|scanner|header|table) (?:is|was|has been) )?(?:\w+ )?(?:code|file|source|module|wrapper|parser|scanner|header|table|bindings?|stubs?)?\s*(?:was |is )?(?:automatically |auto-?|machine[- ])?generated (?:automatically )?(?:by|from|with|using) (?:an? |the )?[\w.+-]+(?: [\w.-]+)? ?(?:tool|compiler|generator|script|v?\d+\.\d+)"
    r"|^\W*this (?:file|code|source|module|wrapper|parser|scanner|header|table) (?:is|was|has been) (?:automatically |auto-?|machine[- ])?(?:created|produced|written|made|built|emitted|compiled) (?:automatically )?(?:by|from|with|using) (?:an? |the )?[\w.+-]+(?: [\w.-]+)? ?(?:tool|compiler|generator|script|v?\d+\.\d+)"
    r"|^\W*an? [\w ]{1,40}(?:scanner|parser|lexer|wrapper|binding|table|stub)s? (?:made|generated|created|produced|built) by \w+"
    r"|^\W*(?:auto|machine)[- ]?generated (?:by|from|file|code)|^\W*this (?:file|code|source|module) (?:is|was|has been) (?:automatically|auto-?|machine-?) ?\w+"
    r"|edit the (?:definition|schema|grammar|template|source|input) instead|ne pas (?:modifier|éditer)|ce fichier (?:est|a été) (?:produit|généré|créé)"
    r"|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|änderungen gehen verloren|nicht (?:von hand )?(?:bearbeiten|ändern|editieren)"
    r"|generado automáticamente|archivo generado|no (?:editar|modificar)|自动生成|請勿(?:修改|編輯)|请勿(?:修改|编辑)|不要(?:修改|编辑)",
    re.I | re.M,
)
SHAPES = [re.compile(x) for x in (r"vsp(?<=\b\w\wvsp)\s*\[\s*-?\d+\s*\]", r"#\s*line\s+\d+\s+\"", r"_(?<=\b\w\w_)(?:accept|ec|base|def|nxt|chk)\s*\[", r"_wrap_(?<=\b_wrap_)\w+\s*\(", r"file_(?<=\bfile_)\w+_rawDesc", r"func \(\w+ \*\w+\) Get\w+\(\) ", r"__pyx_\w+")]
DATA = re.compile(
    r"^\s*(?:[{(\[]\s*)?(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)[uUlLfF]*\s*[,;]?\s*){6,}[})\]]?[,;]?\s*$"
    r"|^\s*[bru]*[\"'](?:\\x[0-9a-fA-F]{2}|\\[0-7]{3}|\\u[0-9a-fA-F]{4}){8,}[\"']?[\\,;)]*\s*$"
    r"|^\s*[bru]*[\"']?(?=[A-Za-z0-9+/=]*\d)[A-Za-z0-9+/=]{40,}[\"']?[\\,;+)]*\s*$",
    re.M,
)
PROJECT = re.compile(
    r"this file is part of (?:the )?([\w.+-]+)|(?:imported|copied|taken|vendored|borrowed|adapted) (?:verbatim )?from (?:the )?(?!(?:rfc|posix|iso|iec|ieee|ansi|ecma|itu|nist|fips|din)\b)([\w.+-]+) v?\d"
    r"|^\W*([\w.+-]+) v?\d+\.\d+[\w.]* *(?:\||-|,)? *\(c\)|copyright (?:\(c\)|©)? *(?:\d{4}[-, \d]*)?(?:by )?(?:the )?([\w.+-]+) (?:authors|contributors|project|developers|team)",
    re.I | re.M,
)
VENDOR_DIR = r"(?i)(^|/)(third[-_]?party|3rd[-_]?party|vendor|vendored|extern|external|externals|deps|contrib|subprojects|node_modules|bower_components|submodules|bundled)/"

FEATURES = "chars bigint, data_chars bigint, lines bigint, packed_chars bigint, short_names bigint, names bigint, tool boolean, shape bigint, same_lines bigint, project string, prints array<bigint>"
COUNTS = ("chars", "data_chars", "lines", "packed_chars", "short_names", "names", "shape", "same_lines")
HEAD = re.compile(r"(?:\s*(?:/\*.*?\*/|//[^\n]*|<!--.*?-->|#(?!\s*(?:include|define|if|ifdef|ifndef|else|endif|elif|line|pragma|undef|error)\b)[^\n]*))+", re.S)
NUMBERED, MASKED = re.compile(r"\b\w*\d\w*|\"[^\"\n]*\""), re.compile(r"[;{},=]")


#: Factors of a run's tokens, by place.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, GRAM - 1 - i, 1 << 64) for i in range(GRAM)], np.uint64)


@lru_cache(1 << 18)
def _token_id(token: str) -> int:
    """A hash whose last bit tells names from other tokens."""
    return xxhash.xxh3_64_intdigest(token) & ~1 | (len(token) > 1 and (token[0].isalpha() or token[0] == "_"))


def fingerprints(texts: list[list[str]]) -> list[list[int]]:
    """For each list of tokens the winnowed hashes of its runs of GRAM tokens that hold at least NAMES names.

    All texts of a batch are one array, in which a run or window that goes beyond its text counts for nothing.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    total, out = int(sizes.sum()), [[] for _ in texts]
    if total < GRAM:
        return out
    ids = np.fromiter((_token_id(t) for text in texts for t in text), np.uint64, total)
    text_of, end = np.repeat(np.arange(len(texts)), sizes), np.repeat(np.cumsum(sizes), sizes)
    slide = np.lib.stride_tricks.sliding_window_view
    h = slide(ids ^ (ids >> np.uint64(29)), GRAM) @ FACTORS
    h ^= h >> np.uint64(32)
    at = np.arange(len(h))
    runs = at[at + GRAM <= end[: len(h)]]
    few = np.bincount(text_of[runs], minlength=len(texts))[text_of[runs]] <= WINDOW
    chosen = [runs[few]]
    if len(h) >= WINDOW:
        first = np.arange(len(h) - WINDOW + 1)
        first = first[first + WINDOW - 1 + GRAM <= end[: len(first)]]
        chosen.append(first + slide(h, WINDOW)[first].argmin(axis=1))
    at = np.unique(np.concatenate(chosen))
    named = np.concatenate([[0], np.cumsum((ids & np.uint64(1)).astype(np.int64))])
    at = at[named[at + GRAM] - named[at] >= NAMES]
    for text, start, stop in _stretches(text_of[at]):
        out[text] = np.unique(h[at[start:stop]]).view(np.int64).tolist()
    return out


def _stretches(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of the stretches of equal values."""
    cuts = np.flatnonzero(np.diff(values, prepend=-1, append=-1)) if len(values) else []
    return ((int(values[a]), int(a), int(b)) for a, b in zip(cuts, cuts[1:]))


def tokens_of(bare: str) -> list[str]:
    """The tokens of a text without comments; numbers are all the same."""
    return ["0" if t[0].isdigit() else t for t in TOKEN.findall(bare)]


def describe(text: str) -> tuple[tuple, list[str]]:
    """The counts of one content, in the order of FEATURES, and its tokens."""
    lines = [x for x in text.split("\n") if x.strip()]
    head = HEAD.match(text)
    tokens = tokens_of(STRING.sub('"', COMMENT.sub(" ", text)))
    names = [t for t in tokens if t[0].isalpha() or t[0] == "_"]
    above = "\n".join("".join(x) for x in COMMENT_TEXT.findall(head.group())) if head else ""
    named = PROJECT.search(above) if above else None
    masked = Counter(map(str.strip, NUMBERED.sub("0", text).split("\n"))) if len(lines) >= 6 else {}
    data = sum(m.end() - m.start() for m in DATA.finditer(text))
    packed = sum(len(x) for x in lines if len(x) > 160 and len(MASKED.findall(x)) * 12 > len(x) and x.count(" ") * 8 < len(x))
    counts = (
        len(text), data, len(lines), packed, sum(len(n) <= 2 for n in names), len(names),
        bool(above and TOOL.search(above)), sum(len(x.findall(text)) for x in SHAPES), sum(n for k, n in masked.items() if n >= 6 and len(k) > 8), named and next(filter(None, named.groups())),
    )
    return counts, tokens


def described(records: DataFrame) -> DataFrame:
    """(c, *FEATURES) of the distinct contents of records (c, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in FEATURES.split(", ")][:-1]
        for p in parts:
            counts, tokens = zip(*map(describe, p["content"]))
            yield pd.concat([p[["c"]].reset_index(drop=True), pd.DataFrame(counts, columns=cols), pd.Series(fingerprints(tokens), name="prints")], axis=1)

    return records.select("c", "content").where("content <> ''").groupBy("c").agg(F.first("content").alias("content")).mapInPandas(run, f"c binary, {FEATURES}")


def owners_of(libraries: DataFrame | None) -> DataFrame | None:
    """(library_id, owner, name): the owner is the first part of the repository's path, where it has one."""
    if libraries is None:
        return None
    owner = F.regexp_extract(F.lower("repo_url"), r"^[a-z+]*:?/*[^/:]+[/:]([^/]+)/", 1)
    return libraries.select(F.col("id").alias("library_id"), F.when(owner != "", owner).alias("owner"), F.lower("name").alias("name")).dropDuplicates(["library_id"])


def recurrence(contents: DataFrame, held: DataFrame, owners: DataFrame | None, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT) -> DataFrame:
    """(c, shared, wide): how many of a content's fingerprints several libraries hold, and more than UNRELATED owners.

    contents has (c, prints), held the (c, library_id) that hold a content, each once.
    """
    spread = held.groupBy("c").agg(F.min("library_id").alias("lo"), F.max("library_id").alias("hi"))
    prints = contents.select("c", F.explode("prints").alias("p"))
    ends = contents.join(spread, "c").select(F.explode("prints").alias("p"), "lo", "hi").groupBy("p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"))
    recurring = checkpointed(ends.where("lo <> hi").select("p", "n"))
    hot = recurring.where(F.col("n") >= hot_rows).orderBy(F.desc("n"), "p").limit(max_hot).select("p")
    hot = [r["p"] for r in hot.collect()]  # at most max_hot numbers
    known = prints.join(recurring.select("p"), "p", "left_semi") if not hot else prints.where(F.col("p").isin(hot)).unionByName(prints.where(~F.col("p").isin(hot)).join(recurring.select("p"), "p", "left_semi"))
    known = checkpointed(known)
    of = held if owners is None else held.join(owners.select("library_id", "owner"), "library_id", "left").select("c", F.coalesce("owner", "library_id").alias("library_id")).distinct()
    wide = known.join(of, "c").groupBy("p", "library_id").agg(F.lit(1).alias("one")).groupBy("p").agg(F.count("*").alias("owners")).where(F.col("owners") > UNRELATED).select("p")
    hits = known.withColumn("hit", F.lit(0)).unionByName(known.join(wide, "p", "left_semi").withColumn("hit", F.lit(1)))
    return hits.groupBy("c").agg(F.count_if(F.col("hit") == 0).alias("shared"), F.sum("hit").alias("wide"))


def judged_files(functions: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, file_path, kind): kind is generated, minified, data, vendored or null for hand-written files."""
    spark = functions.sparkSession
    content = F.coalesce("content", F.lit(""))
    records = functions.where("trim(file_path) <> ''").select("snapshot_id", "file_path", "function_id", F.coalesce("library_id", F.lit("")).alias("library_id"), F.coalesce("start_line", F.lit(0)).alias("line"), F.unhex(F.md5(content)).alias("c"), content.alias("content"))
    at = scratch_path(spark, "contents")
    described(records).write.parquet(at)
    contents = spark.read.parquet(at)
    keys = ["snapshot_id", "file_path", "function_id"]
    rows = checkpointed(records.groupBy(*keys).agg(F.min(F.struct("line", "c", "library_id")).alias("r")).select(*keys, "r.*"))
    owners = owners_of(libraries)
    found = recurrence(contents, rows.select("c", "library_id").distinct(), owners)
    facts = contents.withColumn("prints", F.size("prints")).join(found, "c", "left").fillna(0, ["shared", "wide"])
    first = F.struct("line", "function_id")
    files = rows.join(facts, "c", "left").groupBy("snapshot_id", "file_path").agg(
        F.min("library_id").alias("library_id"), F.min_by("project", first).alias("project"), F.coalesce(F.min_by("tool", first), F.lit(False)).alias("tool"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "prints", "shared", "wide")),
    )
    files = files.withColumn("name", F.lit(None).cast("string")) if owners is None else files.join(owners.select("library_id", "name"), "library_id", "left")
    bare = lambda c: F.regexp_replace(F.lower(c), r"^lib|[^a-z0-9]|\.(c|h|js)$", "")
    own = F.coalesce(bare(F.col("name")), F.lit(""))
    home = bare(F.regexp_replace(F.regexp_extract("file_path", VENDOR_DIR + r"([^/]+)/", 3), r"-v?\d.*$", ""))
    folder = F.col("file_path").rlike(VENDOR_DIR) & (home != own)
    foreign = F.coalesce(bare(F.col("project")) != own, F.lit(False))
    share = F.coalesce(F.col("shared") / F.nullif(F.col("prints"), F.lit(0)), F.lit(0.0))
    vendored = ((share >= COPIED_SHARE) & (F.col("shared") >= LEAST_SHARED) & (F.col("wide") * 2 >= F.col("shared"))) | ((share >= SIGNED_SHARE) & (folder | foreign))
    minified = ((F.col("packed_chars") > 0.5 * F.col("chars")) & (F.col("short_names") > 0.4 * F.col("names"))) | (F.col("packed_chars") > 0.8 * F.col("chars"))
    generated = F.col("tool") | (F.col("shape") >= 2) | ((F.col("same_lines") > 0.6 * F.col("lines")) & (F.col("lines") > 30))
    kind = (
        F.when((F.col("data_chars") > 0.5 * F.col("chars")) & (F.col("data_chars") > 200), "data")
        .when(minified, "minified").when(generated, "generated").when(vendored, "vendored")
    )
    return files.select("snapshot_id", "file_path", "library_id", kind.alias("kind"), "project", "prints", "shared", "wide", "chars", "same_lines", "lines")


def not_hand_written(functions: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    return judged_files(functions, libraries).where("kind is not null").select("snapshot_id", "file_path", "kind")
