"""Quality classifier: Bradley-Terry ranking learned from preference pairs, thresholded by score quantile.

A document's strength is a linear function of features of its text. Documents labelled good are preferred to
documents labelled bad: the weights minimise the logistic loss on feature differences over such pairs (Newton
steps, ridge penalty). The decision is a quantile of the strengths of the labelled sample, the one of the best
balanced accuracy. Scores are logistic in the strength with that quantile at ``CUT``. Features and scores
are Spark expressions; labels reach the driver as a bounded sample only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import STOP_WORDS, let, ratio, repeated_words, words_of

#: Labelled rows of each class at most (those of the smallest hash), pairs drawn from them, and the ridge.
SAMPLE, PAIRS, RIDGE = 10_000, 100_000, 1e-3
#: The score of the threshold.
CUT = 0.7

FEATURES = ["log_words", "mean_word_chars", "symbols", "marks", "stops", "dup_lines", "line_words", "capitals", "digits", "stops_signs", "repeats", "distinct", "odd_words", "long_words"]


def features(text: Column) -> Column:
    """FEATURES of a text as an array; null is the empty text, whose features are 0.

    All is one expression in which each part is bound once (``let``): a filter on a score, which Spark moves below the
    projection, then doesn't repeat the work."""
    gone = lambda t, pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("double")

    def words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("double").alias("n"),
            repeated_words(w).cast("double").alias("repeat"),
            F.size(F.array_distinct(w)).cast("double").alias("distinct"),
            F.size(F.filter(w, lambda x: F.lower(F.translate(x, ".,;:!?*#$%&|", "")).isin(STOP_WORDS))).cast("double").alias("stop"),
            F.size(F.filter(w, lambda x: x.rlike("[^\\p{L}.,;:]"))).cast("double").alias("odd"),
            F.size(F.filter(w, lambda x: F.length(x) > 12)).cast("double").alias("long"),
        )

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("double").alias("n"), F.size(F.array_distinct(x)).cast("double").alias("distinct"))

    def counts(t: Column) -> Column:
        return F.struct(
            let(words_of(t), words).alias("w"),
            let(F.filter(F.split(t, "\n"), lambda s: s.rlike("[^ \\t-\\r]")), lines).alias("l"),
            gone(t, "[#*$%&|<>]").alias("sym"),
            gone(t, "[!?]").alias("mark"),
            gone(t, "\\p{Lu}").alias("cap"),
            gone(t, "[0-9]").alias("dig"),
            gone(t, "[.,;:]").alias("end"),
            F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("double").alias("len"),
        )

    def values(c: Column) -> Column:
        w, n, lines_ = c["w"], c["w"]["n"], c["l"]["n"]
        by_name = {
            "log_words": F.log1p(n),
            "mean_word_chars": ratio(c["len"], n),
            "symbols": F.log1p(10 * ratio(c["sym"], n)),
            "marks": F.log1p(10 * ratio(c["mark"], n)),
            "stops": ratio(w["stop"], n),
            "dup_lines": ratio(lines_ - c["l"]["distinct"], lines_),
            "line_words": F.log1p(ratio(n, lines_)),
            "capitals": ratio(c["cap"], c["len"]),
            "digits": ratio(c["dig"], c["len"]),
            "stops_signs": ratio(c["end"], n),
            "repeats": ratio(w["repeat"], n),
            "distinct": ratio(w["distinct"], n),
            "odd_words": ratio(w["odd"], n),
            "long_words": ratio(w["long"], n),
        }
        return F.array(*(by_name[k] for k in FEATURES))

    return let(let(F.coalesce(text.cast("string"), F.lit("")), counts), values)


@dataclass(frozen=True)
class QualityModel:
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    threshold: float
    quantile: float
    slope: float

    def strength(self, f: Column) -> Column:
        parts = [(F.get(f, F.lit(i)) - m) / s * w for i, (w, m, s) in enumerate(zip(self.weights, self.center, self.scale, strict=True))]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``score`` (0 to 1; at least CUT exactly where the strength reaches the quantile) and
        ``predicted``. Null and empty texts are scored by their zero features; every row stays."""

        def scored(s: Column) -> Column:
            z = self.slope * (s - self.threshold) + float(np.log(CUT / (1 - CUT)))
            p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))
            # on the side of CUT that the strength is on, whatever the rounding
            return F.when(s >= self.threshold, F.greatest(p, F.lit(CUT))).otherwise(F.least(p, F.lit(float(np.nextafter(CUT, 0)))))

        score = let(let(features(F.col("text")), self.strength), scored)
        return docs.drop("score", "predicted").withColumn("score", score).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def bradley_terry(good: np.ndarray, bad: np.ndarray, seed: int = 17) -> np.ndarray:
    """Weights from preference pairs of rows of ``good`` over rows of ``bad``."""
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), PAIRS)] - bad[rng.integers(0, len(bad), PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # how much a pair still pulls
        gradient = d.T @ p / len(d) - RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Learn from the documents that ``labels`` (``doc_id``, ``quality`` 1 or 0; other values and nulls ignored) marks.

    Of each class the ``sample`` rows whose ids have the smallest hashes are used. Without rows of either class
    every text counts as good."""
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = None
    for q in (0, 1):
        part = marks.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", features(F.col("text")).alias("f")).toArrow()  # at most 2 * sample ids
    y = rows["quality"].to_numpy()
    x = np.array(rows["f"].to_pylist(), float).reshape(len(y), len(FEATURES))
    if not len(y) or y.min() == y.max():
        k = len(FEATURES)
        return QualityModel((0.0,) * k, (0.0,) * k, (1.0,) * k, 0.0, 0.0, 1.0)
    center, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = (x - center) / scale
    w = bradley_terry(z[y == 1], z[y == 0])
    s = z @ w
    grid = np.linspace(0.002, 0.998, 499)
    cuts = np.quantile(s, grid)
    good, bad = np.sort(s[y == 1]), np.sort(s[y == 0])
    kept = 1 - np.searchsorted(good, cuts) / len(good)
    caught = np.searchsorted(bad, cuts) / len(bad)
    best = (kept + caught).max()
    near = np.flatnonzero(kept + caught >= best - 1e-9)
    k = int(near[len(near) // 2])
    spread = max(float(np.std(s)), 1e-6)
    return QualityModel(tuple(map(float, w)), tuple(map(float, center)), tuple(map(float, scale)), float(cuts[k]), float(grid[k]), min(20.0, 4 / spread))
