"""Problem 9: the reading level of each document by a Rasch-style latent difficulty model.

Documents have a level, words a difficulty; a word's chance to occur rises or falls with the document's level around the
word's difficulty. In the pure Rasch form every word weighs the same, so a document's raw score is the number of its
distinct words, which is its length. The model here therefore has the words' own slopes and conditions on length: of
the words that occur in a document of level t, word w has the share f_w exp(b_w t - K(t)), K making the shares sum to 1.
It is estimated by alternating optimisation over the whole corpus: given the levels, each word's frequency f and slope b come
from sums over the documents with it; given the words, each document's level is a one-dimensional maximum with a normal
prior. Words are hashed into ``BUCKETS`` per language, so what goes between driver and tasks is bounded whatever the
corpus; the sums are made per partition and added by bucket.

The direction and scale come from labelled documents: the prior mean is a ridge regression of the grades on surface measures
(sentence length, word length, long words, standardised per language), and labelled documents enter the word step with their
grade. The fit of both regressions uses at most ``MAX_LABELS`` labelled documents, everything else every document. Other
languages than the labelled ones get their level from the standardised measures and their own words.

Defined cases: null and empty texts, or texts without words, have a null level; a null lang is guessed from the script
(zh where Han letters prevail, else en); null grades and grades of unknown documents are ignored, several of one document
averaged; without any grade the level is the standardised one (mean 0); repeated doc_ids each get their row; an empty
table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import scratch_path

BUCKETS, MAX_LABELS = 1 << 16, 20_000
#: Rounds at most, and the mean change of the words' slopes at which they are done.
ROUNDS, DONE = 12, 0.02
#: Weight of a word's evidence (words of one sentence aren't independent), of the prior, and of a word's own slope.
TEMPER, PRIOR_SD, SMOOTH = 0.25, 1.0, 8.0
LANGS = ("en", "de", "es", "fr", "zh", "other")
GRID = np.linspace(-8, 8, 161)

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
CODE = re.compile(r"<[^>\n]{1,200}>|https?://\S+|\S*[_/\\]\S*|\b\w*\d\w*\b|^[ \t]*[$#>].*$|^.*[;{}][ \t]*$", re.M)
HAN = re.compile(r"[一-鿿]")
SENTENCE = re.compile(r"[.!?]+(?=\s|$)|[。！？]|\n\s*\n|\n[-*] ")
PREPARED = "lang_ int, n_words int, words array<int>, m1 double, m2 double, m3 double, m4 double"


def language(lang: str | None, text: str) -> int:
    if not lang:
        return LANGS.index("zh") if len(HAN.findall(text)) > 0.2 * max(1, len(text)) else 0
    return LANGS.index(lang[:2].lower()) if lang[:2].lower() in LANGS else len(LANGS) - 1


def measure(text: str | None, lang: str | None) -> tuple | None:
    """(language, words, distinct hashed words, sentence length, word length, long words, rare punctuation)."""
    if not text:
        return None
    k = language(lang, text)
    prose = CODE.sub(" ", text)
    if LANGS[k] == "zh":
        han = re.findall(r"[一-鿿]+", prose)
        words = [s[i : i + 2] for s in han for i in range(max(1, len(s) - 1))]
        letters = sum(map(len, han))
    else:
        words = [w.lower() for w in WORD.findall(prose)]
        letters = sum(map(len, words))
    if not words:
        return None
    sentences = [n for n in (len(WORD.findall(s)) if LANGS[k] != "zh" else len(HAN.findall(s)) for s in SENTENCE.split(prose)) if n]
    ids = sorted({xxhash.xxh32_intdigest(w) % BUCKETS for w in words})
    clauses = len(re.findall(r"[,;:，；：、(]", prose)) / max(1, len(sentences))
    return k, len(words), ids, float(np.log(len(words) / max(1, len(sentences)) + 1)), letters / len(words), sum(len(w) > 8 for w in words) / len(words), float(np.log1p(clauses))


def prepared(documents: DataFrame) -> DataFrame:
    """The documents' words and measures, written once to the shared folder."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in PREPARED.split(", ")]
        for p in parts:
            got = [measure(t, g) for t, g in zip(p["text"], p["lang"])]
            d = pd.DataFrame([g or (None,) * len(cols) for g in got], columns=cols)
            yield pd.concat([p[["doc_id", "source", "lang"]].reset_index(drop=True), d.astype({"lang_": "Int32", "n_words": "Int32"})], axis=1)

    at = scratch_path(documents.sparkSession, "reading")
    documents.select("doc_id", "source", "lang", "text").mapInPandas(run, f"doc_id bigint, source string, lang string, {PREPARED}").write.parquet(at)
    return documents.sparkSession.read.parquet(at)


def _design(m: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(m)), m])


def _ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    p = np.eye(x.shape[1]) * penalty
    p[0, 0] = 0
    return np.linalg.solve(x.T @ x + p, x.T @ y)


def levels(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labels: int = MAX_LABELS) -> DataFrame:
    """(doc_id, source, lang, n_words, level): documents has (doc_id, source, lang, text), labels (doc_id, grade)."""
    spark, sc = documents.sparkSession, documents.sparkSession.sparkContext
    docs = prepared(documents)
    names = ["m1", "m2", "m3", "m4"]
    stats = np.tile(np.array([[0.0, 1.0]]), (len(LANGS), 4, 1)).reshape(len(LANGS), 4, 2)
    for r in docs.where("n_words > 0").groupBy("lang_").agg(*(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.avg, F.stddev_pop))).collect():  # one row per language
        stats[r["lang_"]] = [(r[f"avg_{n}"] or 0.0, r[f"stddev_pop_{n}"] or 1.0) for n in names]
    means = labels.where("grade is not null").groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    # a bounded sample of labelled documents, the same whenever it is drawn
    known = docs.where("n_words > 0").join(means, "doc_id").select("doc_id", "lang_", *names, "grade").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).toPandas()
    if len(known):
        mu, sd = known["grade"].mean(), known["grade"].std(ddof=0) or 1.0
        z = (known[names].to_numpy() - stats[known["lang_"], :, 0]) / stats[known["lang_"], :, 1]
        surface = _ridge(_design(z), (known["grade"].to_numpy() - mu) / sd)
        graded = dict(zip(known["doc_id"], (known["grade"] - mu) / sd))
    else:
        mu, sd, surface, graded = 0.0, 1.0, np.array([0.0, 0.5, 0.25, 0.25, 0.1]), {}
    fixed = sc.broadcast((stats, surface, graded))

    def prior(p: pd.DataFrame) -> np.ndarray:
        s, w, _ = fixed.value
        k = p["lang_"].to_numpy()
        return _design((p[names].to_numpy() - s[k, :, 0]) / s[k, :, 1]) @ w

    def estimate(p: pd.DataFrame, model) -> np.ndarray:
        """The level of each document given the words; without words' parameters the prior mean."""
        m = prior(p)
        if model is None:
            return m
        slope, norm = model.value
        k = p["lang_"].to_numpy()
        score = np.array([slope[i, w].sum() for i, w in zip(k, p["words"])])
        n = np.array([len(w) for w in p["words"]])
        gain = TEMPER * (score[:, None] * GRID - n[:, None] * norm[k]) - (GRID - m[:, None]) ** 2 / (2 * PRIOR_SD**2)
        # the top of the parabola through the best point of the grid and its neighbours
        best, rows = gain.argmax(axis=1).clip(1, len(GRID) - 2), np.arange(len(gain))
        left, mid, right = gain[rows, best - 1], gain[rows, best], gain[rows, best + 1]
        bend = left - 2 * mid + right
        return GRID[best] + (GRID[1] - GRID[0]) * np.clip(np.where(bend < 0, (left - right) / np.where(bend < 0, 2 * bend, 1), 0), -1, 1)

    def sums(model):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            occurs, level, total = np.zeros((len(LANGS), BUCKETS)), np.zeros((len(LANGS), BUCKETS)), np.zeros((len(LANGS), 3))
            for p in parts:
                t = estimate(p, model)
                own = p["doc_id"].map(fixed.value[2]).to_numpy(dtype=float)
                t = np.where(np.isnan(own), t, own)
                for k, w, x in zip(p["lang_"], p["words"], t):
                    occurs[k, w] += 1
                    level[k, w] += x
                    total[k] += len(w) * np.array([1, x, x * x])
            k, w = np.nonzero(occurs)
            yield pd.DataFrame({"k": k, "w": w, "s0": occurs[k, w], "s1": level[k, w], "s2": 0.0})
            yield pd.DataFrame({"k": np.arange(len(LANGS)), "w": -1, "s0": total[:, 0], "s1": total[:, 1], "s2": total[:, 2]})

        return run

    held, model, before = docs.where("n_words > 0"), None, np.zeros((len(LANGS), BUCKETS))
    for _ in range(rounds):
        added = held.select("doc_id", "lang_", "words", *names).mapInPandas(sums(model), "k int, w int, s0 double, s1 double, s2 double").groupBy("k", "w").agg(F.sum("s0"), F.sum("s1"), F.sum("s2"))
        got = added.toPandas().to_numpy()  # at most one row per language and bucket
        slope, norm = np.zeros((len(LANGS), BUCKETS)), np.zeros((len(LANGS), len(GRID)))
        for k in range(len(LANGS)):
            rows = got[got[:, 0] == k]
            n, m1, m2 = next(((r[2], r[3], r[4]) for r in rows if r[1] == -1), (0, 0, 0))
            rows = rows[rows[:, 1] >= 0]
            if not n or not len(rows):
                continue
            var = max(m2 / n - (m1 / n) ** 2, 1e-3)
            b = (rows[:, 3] / rows[:, 2] - m1 / n) / var * rows[:, 2] / (rows[:, 2] + SMOOTH)
            slope[k, rows[:, 1].astype(int)] = b
            power = np.outer(b, GRID)
            top = power.max(axis=0)
            norm[k] = np.log((rows[:, 2] / n) @ np.exp(power - top)) + top
        model = sc.broadcast((slope, norm))
        weights = got[got[:, 1] >= 0]
        at = weights[:, 0].astype(int), weights[:, 1].astype(int)
        change, before = np.sqrt(np.average((slope[at] - before[at]) ** 2, weights=weights[:, 2])) if len(weights) else 0.0, slope
        if change < DONE:
            break

    def final(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"], "source": p["source"], "lang": p["lang"], "n_words": p["n_words"], "t": estimate(p, model), "m": prior(p)})

    levelled = lambda df: df.select("doc_id", "source", "lang", "n_words", "lang_", "words", *names).mapInPandas(final, "doc_id bigint, source string, lang string, n_words int, t double, m double")
    raw = levelled(held)
    if len(known):
        grades = F.broadcast(spark.createDataFrame(known[["doc_id", "grade"]]))  # at most max_labels rows
        fit = levelled(held.join(grades.select("doc_id"), "doc_id", "left_semi")).join(grades, "doc_id").select("t", "m", "grade").toPandas()
        w = _ridge(_design(fit[["t", "m"]].to_numpy()), fit["grade"].to_numpy())
    else:
        w = np.array([0.0, 1.0, 0.0])
    scored = raw.select("doc_id", "source", "lang", "n_words", (F.lit(float(w[0])) + F.col("t") * float(w[1]) + F.col("m") * float(w[2])).alias("level"))
    without = docs.where("n_words is null or n_words = 0").select("doc_id", "source", "lang", F.lit(0).alias("n_words"), F.lit(None).cast("double").alias("level"))
    return scored.unionByName(without)


def profile(leveled: DataFrame) -> DataFrame:
    """By source and lang: documents, mean level and the levels of the tenths 1, 5 and 9."""
    return leveled.groupBy("source", "lang").agg(
        F.count("*").alias("documents"), F.avg("level").alias("mean_level"), *(F.percentile_approx("level", q, 1000).alias(f"level_p{int(q * 100)}") for q in (0.1, 0.5, 0.9)), F.sum("n_words").alias("words")
    )
