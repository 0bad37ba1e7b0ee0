"""Problem 8: mixing sources to target weights by Pareto order sampling.

A source's target is its share of the total size. Its documents get an expected number of copies proportional to the
square root of their size (``POWER``), capped at the source's repeats, so that the expected size meets the target; the
factor is solved from counts per source and size class (a few hundred rows). Whole copies are certain. For the rest of
each expectation, an inclusion probability, documents are ranked by random odds divided by inclusion odds and the
smallest are taken: a sample of fixed size with unequal probabilities. The random number is a hash of seed and doc_id, so
a lost task draws the same again.

The smallest n of a source are found without sorting or gathering it: the ranking number is cut into four digits of 13
bits, and per digit only counts per (source, digit) are made, which say where the n-th lies.

Defined cases: sources without documents or without a target contribute nothing, the former with a shortfall; null
sources, null and empty texts have no copies; a null or non-positive share or max_repeats takes nothing; equal ranking
numbers are taken by doc_id; an empty table gives no documents. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import checkpointed

#: Expected copies grow with size to this power; classes of size per doubling.
POWER, CLASSES = 0.5, 4
DIGIT, DIGITS = 13, 4


def _size_class() -> F.Column:
    return F.floor(F.log2(F.col("tokens").cast("double")) * CLASSES).cast("int")


def _weight(size_class: int) -> float:
    return 2.0 ** (size_class * POWER / CLASSES)


def expected_copies(classes: list[tuple[int, int]], target: float, most: int) -> dict[int, float]:
    """{size class: expected copies} for (size class, tokens) and a target size; at most ``most`` copies."""
    if most <= 0 or target <= 0:
        return {}
    if sum(t for _, t in classes) * most <= target:
        return {c: float(most) for c, _ in classes}
    # the size is a rising, piecewise linear function of the factor: cap classes from the heaviest down
    fixed, free = 0.0, sorted(classes, key=lambda c: -c[0])
    for i in range(len(free)):
        slope = sum(_weight(c) * t for c, t in free[i:])
        factor = (target - fixed) / slope
        if factor * _weight(free[i][0]) <= most:
            return {c: float(most) for c, _ in free[:i]} | {c: factor * _weight(c) for c, _ in free[i:]}
        fixed += most * free[i][1]
    return {c: float(most) for c, _ in classes}


def smallest(rows: DataFrame, take: dict[str, int]) -> DataFrame:
    """Of the rows (source, doc_id, z with DIGIT * DIGITS bits) the ``take[source]`` smallest of each source."""
    spark = rows.sparkSession
    open_ = {s: (0, n) for s, n in take.items() if n > 0}  # digits fixed so far, still to take below or at them
    for d in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - d)
        head = F.create_map(*(x for s, (p, _) in open_.items() for x in (F.lit(s), F.lit(p)))) if open_ else F.create_map()
        if not open_:
            break
        here = rows.where(F.shiftright("z", shift + DIGIT) == head[F.col("source")])
        counts: dict[str, dict[int, int]] = {}
        for s, digit, n in here.groupBy("source", F.shiftright("z", shift).bitwiseAND((1 << DIGIT) - 1).alias("digit")).count().collect():
            counts.setdefault(s, {})[digit] = n
        for s, (p, left) in list(open_.items()):
            for digit in sorted(counts.get(s, {})):
                if counts[s][digit] >= left:
                    open_[s] = ((p << DIGIT) | digit, left)
                    break
                left -= counts[s][digit]
            else:
                open_[s] = (1 << (DIGIT * DIGITS), 0)
    if not open_:
        return rows.limit(0)
    limits = F.broadcast(spark.createDataFrame([(s, p, n) for s, (p, n) in open_.items()], "source string, z_limit bigint, at_limit bigint"))
    held = rows.join(limits, "source").where("z <= z_limit")
    tied = held.where("z = z_limit").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("n <= at_limit").drop("n")
    return held.where("z < z_limit").unionByName(tied).select(*rows.columns)


def repeats(sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the documents used; sized has (doc_id, source, tokens).

    total is the size of the mix in tokens, by default that of all documents of the targeted sources.
    """
    spark = sized.sparkSession
    goal = {r[0]: (r[1], r[2]) for r in targets.where("target_share > 0 and max_repeats > 0 and source is not null").select("source", "target_share", "max_repeats").collect()}
    docs = checkpointed(sized.where("tokens > 0 and source is not null").where(F.col("source").isin(list(goal))).withColumn("size_class", _size_class()))
    classes: dict[str, list[tuple[int, int, int]]] = {}
    for s, c, n, t in docs.groupBy("source", "size_class").agg(F.count("*"), F.sum("tokens")).collect():  # some hundred rows a source
        classes.setdefault(s, []).append((c, n, t))
    total = total or sum(t for v in classes.values() for _, _, t in v)
    plan, take = [], {}
    for s, v in classes.items():
        share, most = goal[s]
        copies = expected_copies([(c, t) for c, _, t in v], share * total, most)
        plan += [(s, c, math.floor(m), m - math.floor(m)) for c, m in copies.items()]
        take[s] = round(sum(n * (copies.get(c, 0) - math.floor(copies.get(c, 0))) for c, n, _ in v))
    rates = F.broadcast(spark.createDataFrame(plan, "source string, size_class int, whole int, chance double"))
    drawn = docs.join(rates, ["source", "size_class"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (F.col("chance") / (1 - F.col("chance")))
    z = F.floor(odds / (1 + odds) * float(1 << (DIGIT * DIGITS))).cast("bigint")
    ranked = drawn.where("chance > 0").select("source", "doc_id", "tokens", F.least(z, F.lit((1 << (DIGIT * DIGITS)) - 1)).alias("z"))
    once = smallest(ranked, take).select("doc_id", "source", "tokens", F.lit(1).alias("repeats"))
    certain = drawn.where("whole > 0").select("doc_id", "source", "tokens", F.col("whole").alias("repeats"))
    return certain.unionByName(once).groupBy("doc_id", "source", "tokens").agg(F.sum("repeats").cast("int").alias("repeats"))


def shares(mixed: DataFrame, sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """Per source of either side: target and actual size and share, and what is missing."""
    have = sized.where("source is not null").groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available_tokens"))
    got = mixed.groupBy("source").agg(F.count("*").alias("documents_used"), F.max("repeats").alias("most_repeats"), F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"))
    want = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = want.join(have, "source", "full").join(got, "source", "left")
    every = Window.partitionBy()  # one row per source
    whole = F.lit(total) if total else F.sum(F.when(F.col("target_share").isNotNull(), F.col("available_tokens"))).over(every)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    goal = F.round(F.coalesce("target_share", F.lit(0.0)) * whole).cast("bigint")
    return rows.select(
        "source", "target_share", "max_repeats", zero("documents").alias("documents"), zero("available_tokens").alias("available_tokens"), zero("documents_used").alias("documents_used"), zero("most_repeats").alias("most_repeats"),
        goal.alias("target_tokens"), zero("actual_tokens").alias("actual_tokens"), (zero("actual_tokens") / F.sum(zero("actual_tokens")).over(every)).alias("actual_share"), F.greatest(goal - zero("actual_tokens"), F.lit(0)).alias("shortfall_tokens"),
    )
