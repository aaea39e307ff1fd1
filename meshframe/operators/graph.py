"""Iterative graph operators: level structures, components, numbering, recursive bisection."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import number
from ..working import settled, shared_dir


#: Levels are found within blocks of about this many edges at once.
BLOCK_EDGES = 1 << 20
_CHUNK = 4096


def _blocks(edges: DataFrame, size: int) -> DataFrame:
    """``chunk, block``: runs of node ids (chunks of 4,096 values, one row each) that together have about ``size`` edges."""
    count = edges.groupBy(F.floor(F.col("src") / _CHUNK).alias("chunk")).agg(F.greatest(F.count("*"), F.lit(_CHUNK)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return count.select("chunk", F.floor(before / size).alias("block"))


def _relax(edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """``block, node, level`` of nodes that a block's edges (``src``, ``dst``) bring nearer, from the rows of ``known`` (``node``,
    ``level``, ``new``) that are new; those among them."""
    nodes, at = np.unique(np.concatenate([known["node"].to_numpy(), edges["src"].to_numpy(), edges["dst"].to_numpy()]), return_inverse=True)
    n, src = len(known), at[len(known) : len(known) + len(edges)]
    order = np.argsort(src, kind="stable")
    first, far = np.searchsorted(src[order], np.arange(len(nodes) + 1)).tolist(), at[n + len(edges) :][order].tolist()
    level, old = np.full(len(nodes), 1 << 30, dtype=np.int64), known["new"].to_numpy(dtype=bool)
    np.minimum.at(level, at[:n][~old], known["level"].to_numpy()[~old])
    before, todo = level.copy(), {}
    np.minimum.at(level, at[:n][old], known["level"].to_numpy()[old])
    for i in np.flatnonzero(level < before).tolist():
        todo.setdefault(int(level[i]), []).append(i)
    now = level.tolist()
    while todo:
        k = min(todo)
        while near := todo.pop(k, None):
            up = []
            for i in near:
                if now[i] == k:
                    for j in far[first[i] : first[i + 1]]:
                        if now[j] > k + 1:
                            now[j] = k + 1
                            up.append(j)
            k += 1
            if up:
                todo.setdefault(k, []).extend(up)
    level = np.array(now, dtype=np.int64)
    hit = np.flatnonzero(level < before)
    return pd.DataFrame({"block": np.full(len(hit), known["block"].iloc[0] if n else 0, dtype=np.int64), "node": nodes[hit].astype(np.int64), "level": level[hit].astype(np.int32)})


def levels(edges: DataFrame, start: DataFrame, max_rounds: int = 100_000, size: int = BLOCK_EDGES) -> DataFrame:
    """``node, level``: breadth-first distance from ``start`` (``node``) over ``edges`` (``src``, ``dst``, both directions).

    Nodes lie in blocks of neighbouring ids with about ``size`` edges. A round takes the blocks that were reached nearer than
    before, finds the levels within each of them to the end, and sends them over the edges between blocks. So rounds are as
    many as the blocks that a shortest path passes through, not as the levels; after k rounds all nodes are right whose
    shortest path changes blocks less than k times."""
    spark = edges.sparkSession
    work = f"{shared_dir(spark)}/work/{uuid.uuid4().hex}"
    blocks = settled(_blocks(edges, size))
    in_block = lambda df, c, name: df.withColumn("chunk", F.floor(F.col(c) / _CHUNK)).join(F.broadcast(blocks.withColumnRenamed("block", name)), "chunk", "left").drop("chunk")  # noqa: E731  a row for each 4,096 ids
    placed = in_block(in_block(edges.select("src", "dst").distinct(), "src", "block"), "dst", "to").where("src <> dst")
    graph = settled(placed.repartitionByRange("block", "src").sortWithinPartitions("block"))
    begin = in_block(start.select("node").distinct(), "node", "block").select("block", "node", F.lit(0).alias("level"))
    begin.where("block is null").write.parquet(f"{work}/round=0")  # far from any edge
    done = spark.read.schema("block long, node long, level int")
    front = settled(begin.where("block is not null"))
    for k in range(1, max_rounds):
        active = [r[0] for r in front.select("block").distinct().collect()]  # a number for each block
        if not active:
            return done.parquet(work).groupBy("node").agg(F.min("level").alias("level"))
        here = F.col("block").isin(active)
        known = done.parquet(work).where(here).groupBy("block", "node").agg(F.min("level").alias("level")).withColumn("new", F.lit(False)).union(front.withColumn("new", F.lit(True)))
        inner = graph.where(here & (F.col("block") == F.col("to"))).select("block", "src", "dst")
        path = f"{work}/round={k}"
        inner.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(_relax, "block long, node long, level int").write.parquet(path)
        out = graph.where(here & (F.col("block") != F.col("to"))).join(done.parquet(path).select(F.col("node").alias("src"), "level"), "src")
        near = out.groupBy(F.col("to").alias("block"), F.col("dst").alias("node")).agg((F.min("level") + 1).alias("level"))
        held = done.parquet(work).select("node", F.col("level").alias("had")).groupBy("node").agg(F.min("had").alias("had"))
        front = settled(near.join(held, "node", "left").where("had is null or level < had").select("block", "node", "level"))
    raise RuntimeError(f"levels aren't done after {max_rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node, component``: the smallest node reachable, by minima over neighbours and pointer jumping.

    Edges are worked out once for all rounds, and no round sends a table to the driver for a broadcast."""
    shared_dir(nodes.sparkSession)
    edges = edges.select("src", "dst").transform(settled)
    label = nodes.select("node", F.col("node").alias("component")).distinct().transform(settled)
    for _ in range(max_rounds):
        near = edges.join(label.hint("merge"), edges["dst"] == label["node"]).groupBy("src").agg(F.min("component").alias("m"))
        step = label.join(near.hint("merge"), label["node"] == near["src"], "left").select("node", F.col("component").alias("was"), F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = label.select(F.col("node").alias("c"), F.col("component").alias("j"))
        new = step.join(jump.hint("merge"), "c").select("node", F.least("c", "j").alias("component"), "was").transform(settled)
        label = new.select("node", "component")
        if new.where("component <> was").isEmpty():
            return label
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def bandwidth(edges: DataFrame) -> DataFrame:
    """``max_diff, mean_diff`` of the ids of neighbours."""
    d = F.abs(F.col("src") - F.col("dst"))
    return edges.agg(F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"))


def renumber_by_levels(nodes: DataFrame, edges: DataFrame, start: DataFrame) -> DataFrame:
    """``node, new_id`` by (level from ``start``, degree, node); nodes out of reach follow in id order. If neither the
    largest nor the mean difference of neighbours' ids falls, or only one does, the old order is kept (dense). Edges are
    worked out once."""
    edges = edges.select("src", "dst").transform(settled)
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    far = nodes.select("node").join(levels(edges, start), "node", "left").join(deg, F.col("node") == F.col("src"), "left")
    made = number(far.select("node", F.coalesce("level", F.lit(1 << 30)).cast("long").alias("level"), F.coalesce("deg", F.lit(0)).alias("deg")), "new_id", "level", "deg", "node", block=1).select("node", "new_id").transform(settled)
    to = lambda c: made.select(F.col("node").alias(c), F.col("new_id").alias(f"n_{c}"))
    after = bandwidth(edges.join(to("src"), "src").join(to("dst"), "dst").select(F.col("n_src").alias("src"), F.col("n_dst").alias("dst"))).first()
    before = bandwidth(edges).first()
    if before[0] is not None and after[0] < before[0] and after[1] < before[1]:
        return made
    return number(nodes.select("node"), "new_id", "node")


def extremal(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Levels (``component``, ``node``, ``level``) from both ends of a long shortest path (a pseudo-diameter) of every
    component at once: from a node of the least degree to the least of the last level, until that is no farther."""
    shared_dir(nodes.sparkSession)
    label = components(nodes, edges)
    deg = label.join(edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("deg")), "node", "left").fillna({"deg": 0}).transform(settled)
    least = lambda df: df.groupBy("component").agg(F.min(F.struct("deg", "node")).alias("m")).select(F.col("m.node").alias("node"))
    reach = lambda start: levels(edges, start).join(label, "node").select("component", "node", "level").transform(settled)
    depth = lambda df, name: df.groupBy("component").agg(F.max("level").alias(name))
    here = reach(least(deg))
    there = None  # the other ends of the components that are done
    for _ in range(max_rounds):
        open_ = here if there is None else here.join(there.select("component").distinct(), "component", "left_anti")
        far = open_.join(depth(open_, "d"), "component").where("level = d").join(deg.select("node", "deg"), "node")
        new = reach(least(far))
        grown = depth(open_, "d").join(depth(new, "e"), "component").where("e > d").select("component").transform(settled)
        done = new.join(grown, "component", "left_anti")
        there = (done if there is None else there.union(done)).transform(settled)
        if grown.isEmpty():
            return here, there
        here = here.join(grown, "component", "left_anti").union(new.join(grown, "component", "left_semi")).transform(settled)
    raise RuntimeError(f"pseudo-diameters still grow after {max_rounds} rounds")


def combined_levels(edges: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """``component, node, level``: two level structures of each component, from opposite ends, made one of little width.

    A node's candidates are its level and the other one counted from the far end. Where they agree, that is its level.
    What is left falls into connected pieces; each takes the candidates that keep the widest level narrower, judged
    against the settled nodes (all pieces at once, not one after another)."""
    depth = here.groupBy("component").agg(F.max("level").alias("d"))
    both = here.join(there.select("node", F.col("level").alias("other")), "node").join(depth, "component").select("component", "node", F.col("level").alias("a"), (F.col("d") - F.col("other")).alias("b")).transform(settled)
    fixed, open_ = both.where("a = b"), both.where("a <> b").select("node")
    inner = edges.join(open_.withColumnRenamed("node", "src"), "src", "left_semi").join(open_.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    piece = components(open_, inner).withColumnRenamed("component", "piece").join(both, "node").transform(settled)
    taken = fixed.groupBy("component", F.col("a").alias("level")).agg(F.count("*").alias("w"))
    choice = piece.select("component", "piece", F.explode(F.array(F.struct(F.lit("a").alias("by"), F.col("a").alias("level")), F.struct(F.lit("b").alias("by"), F.col("b").alias("level")))).alias("c")).select("component", "piece", "c.*")
    width = choice.groupBy("component", "piece", "by", "level").agg(F.count("*").alias("n")).join(taken, ["component", "level"], "left").groupBy("piece", "by").agg(F.max(F.col("n") + F.coalesce("w", F.lit(0))).alias("width"))
    best = width.groupBy("piece").agg(F.min(F.struct("width", "by")).alias("m")).select("piece", F.col("m.by").alias("by"))
    chosen = piece.join(best, "piece").select("component", "node", F.when(F.col("by") == "a", F.col("a")).otherwise(F.col("b")).alias("level"))
    return fixed.select("component", "node", F.col("a").alias("level")).union(chosen)


def profiles(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``node, reach``: how far each node's id (``node``, ``id``) stands behind the least id among it and its neighbours;
    their sum is the profile of the numbering."""
    to = lambda c: ids.select(F.col("node").alias(c), F.col("id").alias(f"id_{c}"))
    least = edges.join(to("dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("id_dst").alias("low"))
    return ids.join(least, "node", "left").select("node", F.greatest(F.col("id") - F.coalesce("low", "id"), F.lit(0)).alias("reach"))


def renumber_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, new_id`` (from 1) of any graph: components one after another, the largest first; within one by combined levels
    from both ends of a pseudo-diameter, within a level by degree and id (in the manner of Gibbs, Poole and Stockmeyer), so
    that neighbours' ids are near. A component that this gives no smaller profile keeps its old order; so the whole
    profile never grows. Edges are worked out once."""
    shared_dir(nodes.sparkSession)
    edges = edges.select("src", "dst").transform(settled)
    here, there = extremal(nodes, edges)
    level = combined_levels(edges, here, there)
    deg = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("deg"))
    rows = level.join(deg, "node", "left").select("component", "node", F.col("level").cast("long").alias("level"), F.coalesce("deg", F.lit(0)).alias("deg"))
    widths = rows.groupBy("component", "level").agg(F.count("*").alias("n"))
    before = widths.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("component").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("component", "level").orderBy("deg", "node"))
    made = rows.withColumn("own", own).join(before, ["component", "level"]).select("component", "node", (F.col("before") + F.col("own")).alias("id")).transform(settled)
    old = number(made.select("component", "node"), "id", "node").transform(settled)
    total = lambda ids, name: profiles(edges, ids.select("node", "id")).join(made.select("node", "component"), "node").groupBy("component").agg(F.sum("reach").alias(name))
    worse = total(made, "new").join(total(old, "old"), "component").where("new >= old").select("component").transform(settled)
    stay = number(old.join(worse, "component", "left_semi").select("component", "node"), "k", "node", group="component")
    low = stay.groupBy("component").agg(F.min("k").alias("low"))
    kept = stay.join(low, "component").select("component", "node", (F.col("k") - F.col("low") + 1).alias("id"))
    inside = made.join(worse, "component", "left_anti").union(kept)
    # components of one size stand together; so the place of one follows from its number among them
    size = made.groupBy("component").agg(F.count("*").alias("size"))
    sizes = size.groupBy("size").agg(F.count("*").alias("m"))
    base = sizes.select("size", F.coalesce(F.sum(F.col("size") * F.col("m")).over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = number(size, "k", "component", group="size")
    first = ranked.groupBy("size").agg(F.min("k").alias("first"))
    start = ranked.join(first, "size").join(base, "size").select("component", (F.col("base") + (F.col("k") - F.col("first")) * F.col("size")).alias("start"))
    return inside.join(start, "component").select("node", (F.col("start") + F.col("id")).alias("new_id"))


def bisect(points: DataFrame, depth: int, axes=("x", "y"), bins: int = 1024, rounds: int = 6) -> DataFrame:
    """``id, part``: recursive coordinate bisection of ``points`` (``id`` and axes) into ``2 ** depth`` parts.

    Each level splits all parts at once at their median along the axes in turn; values equal to the median go down, and of
    an even number the mean of the middle two counts. Values below 1e-10 in size count as 0. Medians are found by
    histograms of ``bins`` cells, refined ``rounds`` times around the middle ranks, so that no part is ever gathered."""
    shared_dir(points.sparkSession)
    now = points.select("id", *[F.when(F.abs(F.col(a)) < 1e-10, 0.0).otherwise(F.col(a)).alias(a) for a in axes], F.lit(0).alias("part")).transform(settled)
    for d in range(depth):
        a = axes[d % len(axes)]
        cut = _medians(now.select("part", F.col(a).alias("v")), bins, rounds)
        now = now.join(F.broadcast(cut), "part").select("id", *axes, (2 * F.col("part") + (F.col(a) > F.col("cut")).cast("int")).alias("part")).transform(settled)  # at most 2 ** depth rows
    return now.select("id", "part")


def _medians(values: DataFrame, bins: int, rounds: int) -> DataFrame:
    """``part, cut``: the exact medians of ``v``. The two middle ranks of each part are followed into ever smaller intervals
    (a row per part and rank: few); what is left of an interval at the end is one value, or is sorted out by minima."""
    size = values.groupBy("part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    want = size.select("part", "lo", "hi", F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("rank")).withColumn("key", F.col("rank"))
    spark = values.sparkSession
    want = spark.createDataFrame(want.collect(), want.schema)  # two rows a part
    for _ in range(rounds):
        inside = values.join(F.broadcast(want), "part").where("v >= lo and v <= hi")
        step = (F.col("hi") - F.col("lo")) / bins
        cell = F.when(step > 0, F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
        hist = inside.withColumn("cell", cell).groupBy("part", "key", "rank", "cell").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy("part", "key").orderBy("cell"))  # at most ``bins`` rows each
        hit = hist.withColumn("upto", upto).where("upto >= rank and upto - c < rank")
        want = spark.createDataFrame(hit.select("part", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), "key").collect(), want.schema)
        if want.where("lo < hi").isEmpty():
            break
    else:  # values too close for the cells: the ranks among the few distinct values left
        left = values.join(F.broadcast(want), "part").where("v >= lo and v <= hi").groupBy("part", "key", "rank", "v").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("part", "key").orderBy("v"))
        want = left.withColumn("upto", upto).where("upto >= rank and upto - c < rank").select("part", F.col("v").alias("lo"), F.col("v").alias("hi"), "rank", "key")
    return want.groupBy("part").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).select("part", (F.col("a") + (F.col("b") - F.col("a")) / 2).alias("cut"))


def columns_together(parts: DataFrame, points: DataFrame) -> DataFrame:
    """``id, part``: all elements over one (x, y) get the part of the lowest (z, then id) of them."""
    j = parts.join(points, "id")
    base = j.groupBy("x", "y").agg(F.min_by("part", F.struct("z", "id")).alias("p"))
    return j.join(base, ["x", "y"]).select("id", F.col("p").alias("part"))


def rank_in_order(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
