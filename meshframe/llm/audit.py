"""Filter interaction audit: what each of several filters removes in every order of applying them.

Every document is a cell of a 2 x ... x 2 contingency table (passes or fails each filter). Spark counts the cells of every
part; an order of the filters then needs no further pass over documents: what is kept after a step, removed by it or
removed earlier is a contraction of the part's table, in which each axis is selected by one of PASS, FAIL and ALL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import let, words_of

#: Selections along an axis, whose first place counts documents that pass its filter.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
LETTERS = "ABCDE"
MEASURES = ["n", "good", "toxic"]


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (A is 1, B 2, C 4, D 8); null is the empty text."""

    def bits(t: Column) -> Column:
        def of_words(w: Column) -> Column:
            few = F.when(F.size(w) < 200, 1).otherwise(0)
            return few + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)

        capitals = F.length(F.regexp_replace(t, "[^A-Z]+", ""))
        loud = F.when(100 * capitals > 3 * F.length(t), 4).otherwise(0)
        return let(words_of(t), of_words) + loud + F.when(t.rlike("[#$%&*|]"), 8).otherwise(0)

    return let(F.coalesce(text.cast("string"), F.lit("")), bits)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, code, n, good, toxic``: documents of each part by the bits of the filters that they fail (E, a copy of a
    smaller doc_id's text anywhere in the table, is 16), and how many of them ``labels`` marks.

    Texts meet by their SHA-256. Filters A to D depend on the text alone, so that a text's rows can be summed by part and
    mark before they meet: a group of copies of any size is a few rows by then. Rows without doc_id never fail E and have
    no marks; several rows of one doc_id don't make each other copies; several marks of a doc_id count as their largest."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), text_failures(F.col("text")).alias("bits"))
    rows = rows.groupBy("doc_id", "part", "h", "bits").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    none = F.lit(0)
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    marked = known.unionByName(rows.where("doc_id is null").withColumns({"good": none, "toxic": none}))
    named = F.col("doc_id").isNotNull()
    groups = marked.groupBy("h", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), none).alias("unnamed"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("first"),
    )
    # a text has at most four rows a part here
    least = F.min("first.doc_id").over(Window.partitionBy("h"))
    told = groups.withColumn("least", least).select("part", "bits", "good", "toxic", "n", (F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)).alias("firsts"))
    both = told.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("bits").alias("code"), F.col("firsts").alias("n")), F.struct((F.col("bits") + 16).alias("code"), (F.col("n") - F.col("firsts")).alias("n")))).alias("c"))
    n = F.col("c.n")
    return both.groupBy("part", F.col("c.code").cast("int").alias("code")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


@lru_cache(maxsize=1)
def plan() -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
    """``filter_order, step`` and the filter of every step of every order, and what each quantity selects along every axis
    (steps x axes x 2)."""
    k = len(LETTERS)
    rows, kept, removed, alone, fails = [], [], [], [], []
    for order in permutations(range(k)):
        name = "".join(LETTERS[f] for f in order)
        for step, f in enumerate(order):
            before = set(order[:step])
            rows.append((name, step + 1, f))
            kept.append([PASS if a in before or a == f else ALL for a in range(k)])
            removed.append([FAIL if a == f else PASS if a in before else ALL for a in range(k)])
            alone.append([FAIL if a == f else PASS for a in range(k)])
            fails.append([FAIL if a == f else ALL for a in range(k)])
    chosen = {"kept": kept, "removed": removed, "unique_fails": alone, "fails": fails}
    return pd.DataFrame(rows, columns=["filter_order", "step", "filter"]), {q: np.array(s, np.int64) for q, s in chosen.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """For every row of ``chosen`` (rows x axes x 2) the sum of the cells that it selects; ``tensor`` has measures first."""
    axes = [x for a in range(chosen.shape[1]) for x in (chosen[:, a], [1, 2 + a])]
    return np.einsum(tensor, [0, *range(2, 2 + chosen.shape[1])], *axes, [0, 1], optimize="greedy")


def interactions(part: str, counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part from its cells (32 rows at most)."""
    steps, chosen = plan()
    k = len(LETTERS)
    flat = np.zeros((len(MEASURES), 1 << k), np.int64)
    for i, measure in enumerate(MEASURES):
        np.add.at(flat[i], counts["code"].to_numpy(), counts[measure].to_numpy())
    # the bit of the last filter is the highest: axes come in reverse
    tensor = flat.reshape(len(MEASURES), *(2,) * k).transpose(0, *range(k, 0, -1))
    got = {q: contract(tensor, s) for q, s in chosen.items()}
    removed = got["removed"]
    f = steps["filter"].to_numpy()
    shapley = np.bincount(f, removed[0], k).astype(np.int64)[f]
    out = steps[["filter_order", "step"]].assign(
        part=part, kept=got["kept"][0], removed=removed[0], redundant=got["fails"][0] - removed[0], unique_fails=got["unique_fails"][0], good_lost=removed[1], toxic_lost=removed[2], shapley=shapley
    )
    return out[["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for every part
    (``lang``; null is the empty string) and all 120 orders of the filters A to E; see ``cells`` for odd rows.

    Reads ``doc_id, text, lang`` of ``docs`` and ``doc_id, quality, toxic`` of ``labels``; other columns are ignored. A part
    has 600 rows, zeros included; an empty table has none. ``shapley`` is what a filter removes, summed over all orders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, code, n, good, toxic in batch.itertuples(index=False):
                yield interactions(part, pd.DataFrame({"code": code, "n": n, "good": good, "toxic": toxic}))

    arrays = [F.collect_list(c).alias(c) for c in ("code", *MEASURES)]  # a part has at most 32 cells
    tables = cells(docs, labels).groupBy("part").agg(*arrays)
    return tables.mapInPandas(run, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
