"""Problem 5: duplicates of new batches against all history, with a segment index for edit distance.

A change is known by its reference (type and normalised ref), by the commit a merge names, and by its text. Texts are
strings over words: the words of title and message without labels and trailers. Two texts are the same up to light
edits when their fixed words (those with digits, underscores or path signs) are equal and at most ``TAU`` other words
differ. A text of L words is cut into TAU + 1 segments of fixed places; they are stored by (fixed words, L, place,
words). By the pigeonhole principle a text within TAU edits has one segment unchanged, shifted by at most TAU words, so
a new text probes the few substrings that can be that segment for each length from L - TAU to L + TAU, verifies the
candidates with a bounded edit distance and its segments are appended. Nothing is compared outside the probed entries.
:class:`History` keeps references, texts and segments in a shared folder; every query here goes through it.

Texts whose fixed words nobody shares can't have a partner and aren't probed; equal texts are one entry. The links of a
batch are closed transitively by label propagation with pointer jumping over checkpointed tables.

Defined cases: a null or blank ref tells nothing (such a row can only be linked by its text); a null library is a
library of its own; empty or short messages (100 characters or fewer) are linked by reference only; repeated rows are
repeats of the smallest seq; an empty table or batch gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import checkpointed, discard, scratch_path
from strandline.stored import StoredBatches

#: Words that may differ between two texts of one change.
TAU = 3
#: Messages need more characters than this to be compared as texts.
MIN_CHARS = 100
#: Buckets of the stored tables (hundreds for a long history), and batches in which a table of many runs is taken up.
BUCKETS, BATCHES = 8, 2
#: What a key stands for: a ref, the ref of a commit, a text.
OTHER, COMMIT, TEXT = 0, 1, 2

# Labels before a title, trailers after a message.
LABEL = re.compile(r"^\s*(?:(?:\[[^\]]{1,40}\]|\((?:backport|cherry-?pick|stable|lts)[^)]{0,20}\)|(?:re|fwd?|aw|backport|cherry-?pick|stable|lts|merged?|picked|squash!|fixup!|revised|v\d+)\s*[:!|]\s)\s*)+", re.I)
TRAILER = re.compile(
    r"(?i:\([^()]{0,40}\bcom+it\s+[0-9a-f]{7,64}\s*\))|(?i:\(\s*(?:cherry[-\s]+picked|backported|picked|ported|rebased|imported)\s+from\s[^)]{0,80}\)?)"
    r"|(?im:^[ \t>*-]*(?:[a-z]+(?:-[a-z]+)*-(?:by|to|from|of|on|id|for|with|url|link|sha|commit)|cc|change-?id|backport|upstream|bug|link|origin|submitted|pr-url|reviewed|backported from|picked from|git-svn-id)[ \t]*:[^\n]*$)"
    r"|(?i:\b(?:signed-off|reviewed|acked|tested|co-authored|co-developed|reported|suggested|approved|merged|helped|committed|requested)-by:\s*(?:[\w.'’-]+[ \t]+){0,4}(?:<[^>]{0,80}>|[\w.'’-]+))"
    r"|(?i:\b(?:change-id|backport-of|upstream-commit|[a-z]+-from|git-svn-id):\s*\S+)"
    r"|(?i:\A(?:[\s>*-]*(?:this is an? )?(?:ba\w*ck?-?por?t|cherry-?pick|port|copy)\s+(?:of|from)\s(?:[^.!;]|\.(?=\w)){0,120}?(?:[.!;]|\n\n|\n(?=[-*])))+)"
)
WORD = re.compile(r"\w+(?:[./]\w+)*")
FIXED = re.compile(r"[\d_/.]")
CAMEL = re.compile(r"[a-z0-9][A-Z]")


def words_of(title: str | None, message: str | None) -> list[str]:
    title, message = title or "", message or ""
    return WORD.findall(LABEL.sub("", title)) + WORD.findall(TRAILER.sub(" ", LABEL.sub("", message)))


def fixed_key(scope: str, words: list[str]) -> int:
    """One number for the scope and the multiset of fixed words."""
    fixed = sorted({w.lower() for w in words if FIXED.search(w)})
    return xxhash.xxh3_64_intdigest("\x1f".join([scope, *fixed])) - (1 << 63)


def segments(n: int, tau: int = TAU) -> list[tuple[int, int]]:
    """(start, length) of the tau + 1 segments of a text of n words; the last ones are longer by one."""
    k = tau + 1
    short, more = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - more)
        out.append((at, size))
        at += size
    return out


def index_keys(scope: int, words: list[str], tau: int = TAU) -> list[int]:
    n = len(words)
    return [_key(scope, n, i, words[a : a + s]) for i, (a, s) in enumerate(segments(n, tau))]


def probe_keys(scope: int, words: list[str], tau: int = TAU, longer: int = 0) -> list[int]:
    """Keys of the substrings that can equal a segment of a text of n - tau to n + longer words within tau edits."""
    n, out = len(words), set()
    for other in range(max(0, n - tau), n + longer + 1):
        d = n - other
        for i, (a, s) in enumerate(segments(other, tau)):
            # multi-match-aware window: i edits at most before the segment, tau - i after it
            lo = max(0, a - i, a + d - (tau - i))
            hi = min(n - s, a + i, a + d + (tau - i))
            out.update(_key(scope, other, i, words[p : p + s]) for p in range(lo, hi + 1))
    return list(out)


def _key(scope: int, n: int, i: int, seg: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(f"{scope} {n} {i} {' '.join(seg)}") - (1 << 63)


def same_but_light_edits(a: list[str], b: list[str], tau: int = TAU) -> bool:
    """Whether at most tau words differ, none of them fixed or a mixed-case name. Banded, so O(n tau)."""
    la, lb = [w.lower() for w in a], [w.lower() for w in b]
    lo = 0
    while lo < min(len(la), len(lb)) and la[lo] == lb[lo]:
        lo += 1
    hi = 0
    while hi < min(len(la), len(lb)) - lo and la[-1 - hi] == lb[-1 - hi]:
        hi += 1
    la, lb = la[lo : len(la) - hi], lb[lo : len(lb) - hi]
    left = {w.lower() for w in a if CAMEL.search(w)} | {w.lower() for w in b if CAMEL.search(w)}
    if {w for w in la if w in left or FIXED.search(w)} != {w for w in lb if w in left or FIXED.search(w)}:
        return False
    if abs(len(la) - len(lb)) > tau:
        return False
    row = {j: j for j in range(min(len(lb), tau) + 1)}
    for i, w in enumerate(la, 1):
        new = {}
        for j in range(max(0, i - tau), min(len(lb), i + tau) + 1):
            best = row.get(j, tau + 1) + 1
            if j:
                best = min(best, new.get(j - 1, tau + 1) + 1, row.get(j - 1, tau + 1) + (w != lb[j - 1]))
            new[j] = best
        if min(new.values()) > tau:
            return False
        row = new
    return row.get(len(lb), tau + 1) <= tau


def ref_key(type_: Column, ref: Column) -> Column:
    """A ref in one spelling: hex digits of a sha cut to 12, the number of an issue or merge, the bare tag."""
    low = F.lower(F.regexp_replace(ref, r"^\s+|\s+$", ""))
    sha = F.regexp_extract(low, r"^(?:commit|rev|sha|g|r)?[\s:/@#-]*([0-9a-f]{12,64})$", 1)
    num = F.regexp_extract(low, r"^[\p{L}\s#!/:._-]*?(\d+)$", 1)
    tag = F.regexp_extract(low, r"^(?:[\p{L}][\p{L}_+]*\d*[-_/\s:@])*(?:v|r|rel|release|version|ver|tag)?[-_\s.:#]*(\d.*)$", 1)
    found = F.when(type_ == "commit", F.substring(sha, 1, 12)).when(type_.isin("pr_merge", "bug_issue"), num).when(type_ == "tag", tag).otherwise(low)
    return F.when(low == "", None).otherwise(F.when(found != "", found).otherwise(low))


def keyed_rows(rows: DataFrame) -> DataFrame:
    """(seq, key, kind, sha_key): the key of a row's own ref and, for merges, that of the commit they name."""
    r = rows.where("seq is not null").select(
        "seq",
        F.coalesce("library_id", F.lit("")).alias("lib"),
        F.coalesce("type", F.lit("")).alias("type"),
        ref_key(F.col("type"), F.col("ref")).alias("ref"),
        F.when(F.col("type") == "pr_merge", ref_key(F.lit("commit"), F.col("related_commit_sha"))).alias("sha"),
    )
    digest = lambda kind, ref: F.when(ref.isNotNull(), F.unhex(F.md5(F.concat_ws("\x1f", "lib", kind, ref))))
    return r.select("seq", digest(F.col("type"), F.col("ref")).alias("key"), F.when(F.col("type") == "commit", COMMIT).otherwise(OTHER).alias("kind"), digest(F.lit("commit"), F.col("sha")).alias("sha_key"))


def texts_of(rows: DataFrame) -> DataFrame:
    """(seq, scope, same, text) of the commits with a long message: their words, and one key for equal texts of a scope."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            words = [words_of(t, m) for t, m in zip(p["title"], p["message"])]
            scopes, texts = [fixed_key(s, w) for s, w in zip(p["lib"], words)], [" ".join(w) for w in words]
            same = [s.to_bytes(8, "big", signed=True) + xxhash.xxh3_64_digest(t.lower()) for s, t in zip(scopes, texts)]
            yield pd.DataFrame({"seq": p["seq"], "scope": scopes, "same": same, "text": texts})

    long_ones = rows.where(F.col("seq").isNotNull() & (F.col("type") == "commit") & (F.length("message") > MIN_CHARS))
    return long_ones.select("seq", F.coalesce("library_id", F.lit("")).alias("lib"), "title", "message").mapInPandas(run, "seq bigint, scope bigint, same binary, text string")


def _index(texts: DataFrame) -> DataFrame:
    """(node, scope, keys): the segments' keys of texts (seq, scope, text)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"node": p["seq"], "scope": p["scope"], "keys": [index_keys(s, t.lower().split(" ")) for s, t in zip(p["scope"], p["text"])]})

    return texts.select("seq", "scope", "text").mapInPandas(run, "node bigint, scope bigint, keys array<bigint>")


def _probes(texts: DataFrame, longer: int) -> DataFrame:
    """(key, b): the keys that texts (node, scope, text) probe."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keys = [probe_keys(s, t.lower().split(" "), longer=longer) for s, t in zip(p["scope"], p["text"])]
            yield pd.DataFrame({"key": keys, "b": p["node"]}).explode("key", ignore_index=True).astype({"key": "int64"})

    return texts.select("node", "scope", "text").mapInPandas(run, "key bigint, b bigint")


def _light():
    @F.pandas_udf("boolean")
    def light(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([same_but_light_edits(x.split(" "), y.split(" ")) for x, y in zip(a, b)])

    return light


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, first): the smallest node of each component of links (a, b)."""
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("first")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "first"), "b").groupBy(F.col("a").alias("node")).agg(F.min("first").alias("near"))
        step = labels.join(near, "node").select("node", "first", F.least("first", "near").alias("low"))
        jump = step.join(labels.select(F.col("node").alias("low"), F.col("first").alias("lower")), "low").select("node", F.least("low", "lower").alias("next"), "first")
        new = checkpointed(jump)
        moved = new.where("next < first").limit(1).count()
        labels = new.select("node", F.col("next").alias("first"))
        if not moved:
            return labels
    raise RuntimeError(f"components of a diameter beyond 2^{max_rounds}")


class History(StoredBatches):
    """The accepted changes of all earlier batches in a shared folder, met by each new batch without reading them whole.

    Tables, each partitioned by batch and by bucket of what it is looked up by: ``refs`` and ``shas`` (key, first), ``texts``
    (seq, scope, same, text), ``segments`` (node, scope, keys, first), ``aliases`` and ``roots`` (a, b: the first a has become
    b, by either), ``rows`` (seq, first). ``ingest`` reads only the buckets that the batch's own keys and scopes fall in, so
    that a batch of some rows reads some buckets of the index however long the history is.

    Where a row joins changes that are stored already, their larger firsts get an alias; looked-up firsts are resolved by
    these, and ``firsts`` gives all rows of all batches with the smallest seq of their change. A batch that broke off can run
    again, and a complete batch that is handed in again only returns its rows.
    """

    SCHEMAS = {
        "refs": "key binary, first bigint", "shas": "key binary, first bigint", "texts": "seq bigint, scope bigint, same binary, text string",
        "segments": "node bigint, scope bigint, keys array<bigint>, first bigint", "aliases": "a bigint, b bigint", "roots": "a bigint, b bigint", "rows": "seq bigint, first bigint",
    }

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        super().__init__(spark, folder, buckets)

    def _near(self, new: DataFrame, texts: DataFrame, before: list[int]) -> DataFrame:
        """(b, a, old): new texts b that are the same as a but for light edits; old is the first of a stored a, else null."""
        buckets = self.touched(new, "scope") if before else []
        stored = self.read("segments", before, buckets)
        all_ = stored.unionByName(new.withColumn("first", F.lit(None).cast("bigint")))
        shared = all_.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(F.col("first").isNull()).alias("fresh")).where("n > 1 and fresh > 0")
        held = checkpointed(all_.join(shared.select("scope"), "scope", "left_semi"))
        own = self.read("texts", before, buckets).unionByName(texts).select(F.col("seq").alias("node"), "text")
        read = checkpointed(own.join(held.select("node", "scope", "first"), "node"))
        index = held.select(F.explode("keys").alias("key"), F.col("node").alias("a"), F.col("first").alias("old"))
        probes = _probes(read.where("first is null"), TAU if before else 0)
        pairs = index.join(probes, "key").where("a <> b").select("a", "b", "old")
        pairs = pairs.select(F.when(F.col("old").isNull(), F.least("a", "b")).otherwise(F.col("a")).alias("a"), F.when(F.col("old").isNull(), F.greatest("a", "b")).otherwise(F.col("b")).alias("b"), "old").distinct()
        both = pairs.join(read.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(read.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return both.where(_light()("ta", "tb")).select("b", "a", "old")

    def _resolved(self, hits: DataFrame, before: list[int]) -> DataFrame:
        """(a, b, stored) with stored b replaced by what it has become."""
        if not before:
            return hits
        known = self.read("aliases", before, self.touched(hits.where("stored"), "b")).groupBy(F.col("a").alias("b")).agg(F.min("b").alias("now"))
        return hits.join(known, "b", "left").select("a", F.when(F.col("stored"), F.coalesce("now", "b")).otherwise(F.col("b")).alias("b"), "stored")

    def ingest(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """(seq, first) of the batch's rows, first being the row that told the change first as far as is known by now."""
        before = self.new_batch(batch_id)
        if before is None:
            return self.read("rows", [batch_id])
        self.write("texts", batch_id, texts_of(batch), "scope")
        texts = self.read("texts", [batch_id])
        rows = checkpointed(keyed_rows(batch))

        # the batch's keys, of refs and of texts, with the batch's first row of each and the stored first
        keys = rows.where("key is not null").select("key", "seq", "kind").unionByName(texts.select(F.col("same").alias("key"), "seq", F.lit(TEXT).alias("kind")))
        keys = keys.groupBy("key").agg(F.min("seq").alias("node"), F.count("*").alias("n"), F.max("kind").alias("kind"))
        if before:
            keys = checkpointed(keys)
            keys = keys.join(self.read("refs", before, self.touched(keys, "key")), "key", "left")
        else:
            keys = keys.withColumn("first", F.lit(None).cast("bigint"))
        keys = checkpointed(keys)
        member = checkpointed(rows.join(keys.where(F.col("kind") != TEXT).select("key", "node"), "key", "left").select("seq", F.coalesce("node", "seq").alias("node"), "sha_key"))

        # links (a, b): a is a row of the batch, b another one or, where stored, the first of a stored change
        named = checkpointed(member.where("sha_key is not null").select(F.col("sha_key").alias("key"), F.col("node").alias("a")).distinct())
        commits = keys.where(F.col("kind") == COMMIT)
        again = texts.select(F.col("same").alias("key"), F.col("seq").alias("a")).join(keys.where((F.col("kind") == TEXT) & (F.col("n") > 1)).select("key", F.col("node").alias("b")), "key").where("a <> b")
        new_texts = keys.where((F.col("kind") == TEXT) & F.col("first").isNull()).select(F.col("node").alias("seq"))
        new = checkpointed(_index(texts.join(new_texts, "seq", "left_semi")))
        near = self._near(new, texts, before)
        links = [
            again.select("a", "b", F.lit(False).alias("stored")),
            named.join(commits.select("key", F.col("node").alias("b")), "key").select("a", "b", F.lit(False).alias("stored")),
            near.select(F.col("b").alias("a"), F.coalesce("old", "a").alias("b"), F.col("old").isNotNull().alias("stored")),
        ]
        if before:
            links += [
                keys.where("first is not null").select(F.col("node").alias("a"), F.col("first").alias("b"), F.lit(True).alias("stored")),
                named.join(self.read("refs", before, self.touched(named, "key")), "key").select("a", F.col("first").alias("b"), F.lit(True).alias("stored")),
                commits.join(self.read("shas", before, self.touched(commits, "key")).withColumnRenamed("first", "b"), "key").select(F.col("node").alias("a"), "b", F.lit(True).alias("stored")),
            ]
        links = checkpointed(reduce(DataFrame.unionByName, links).distinct())
        links = checkpointed(self._resolved(links, before).distinct())

        ends = links.select(F.col("a").alias("seq")).unionByName(links.where("not stored").select(F.col("b").alias("seq"))).distinct()
        within = member.join(ends, "seq").where("seq <> node").select(F.col("seq").alias("a"), F.col("node").alias("b"))
        top = checkpointed(components(links.select("a", "b").unionByName(within)))
        out = member.join(top, "node", "left").select("seq", F.coalesce("first", "node").alias("first"), "sha_key")
        self.write("rows", batch_id, out, "seq")
        firsts = self.read("rows", [batch_id])

        moved = links.where("stored").select(F.col("b").alias("node")).distinct().join(top, "node").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        if before:
            moved = checkpointed(moved)
            behind = self.read("roots", before, self.touched(moved, "a")).select(F.col("a").alias("x"), F.col("b").alias("a"))
            moved = checkpointed(moved.unionByName(behind.join(moved, "a").select(F.col("x").alias("a"), "b")).distinct())
        entries = [
            ("refs", keys.where("first is null").select("key", F.col("node").alias("seq")).join(firsts, "seq"), "key"),
            ("shas", out.where("sha_key is not null").select(F.col("sha_key").alias("key"), "first").distinct(), "key"),
            ("segments", new.join(firsts.withColumnRenamed("seq", "node"), "node"), "scope"), ("aliases", moved, "a"), ("roots", moved, "b"),
        ]
        with ThreadPoolExecutor(len(entries)) as pool:  # small jobs of their own, so side by side
            list(pool.map(lambda e: self.write(e[0], batch_id, *e[1:]), entries))
        self.finish(batch_id)
        return firsts

    def told(self) -> DataFrame:
        """(batch, seq, first) of all rows as their batch saw them."""
        return self.read("rows", self.batches(), with_batch=True).select("batch", "seq", "first")

    def firsts(self) -> DataFrame:
        """(seq, first) of all rows, by all that is known now."""
        known = self.read("aliases", self.batches()).groupBy(F.col("a").alias("first")).agg(F.min("b").alias("now"))
        return self.told().join(known, "first", "left").select("seq", F.coalesce("now", "first").alias("first"))


def ingest_in_batches(history: History, rows: DataFrame, batches: int = BATCHES) -> None:
    """Hands all rows to the history in order of arrival (seq), in batches of several runs each."""
    rows = rows.where("seq is not null")
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    if low is None:
        return
    part = F.least(F.lit(batches - 1), F.floor((F.col("seq") - low) * batches / (high - low + 1)))
    for i in range(batches):
        history.ingest(rows.where(part == i), i)


def first_rows(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(seq, first): for each row the smallest seq that tells the same change, batch by batch against a history of its own."""
    spark = rows.sparkSession
    at = scratch_path(spark, "history")
    history = History(spark, at)
    ingest_in_batches(history, rows, batches)
    out = checkpointed(history.firsts())
    discard(spark, at)
    return out


def repeats(rows: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(seq, repeat_seq): the first row of each change with each later row that tells it again."""
    return first_rows(rows, batches).where("seq <> first").select(F.col("first").alias("seq"), F.col("seq").alias("repeat_seq"))
