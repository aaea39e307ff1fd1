"""Batches of edits whose requests may meet: which of them can be made at once, in rounds, and which are refused.

Requests touch things (faces, vertices, pairs of vertices). Of those that touch one thing, the one of the least priority
goes first, the others wait for the next round and are judged on the mesh as it is then. Priorities are hashes of ids, so
that rows of neighbouring requests don't wait for each other one by one: a request waits for a falling chain of hashes,
whose length grows with the logarithm of their number. The outcome is that of making the edits one after another in the
order of the rounds, which is returned with every request.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, half_edges
from ..working import settled, shared_dir
from .graph import components

#: Rounds after which a batch that isn't done is an error.
ROUNDS = 500
#: Loops of at most this many sides are put in order within a task, many at once (tasks take about BLOCK_SIDES sides).
SHORT, BLOCK_SIDES = 4096, 1 << 16


def firsts(pending: DataFrame, touched: DataFrame, key: str = "eid") -> DataFrame:
    """``key`` of the rows of ``pending`` that come first at everything that they touch (``touched``: ``key`` and ``item``).
    Where ``touched`` has ``reads``, things that a request only reads may be read by others at once, but not be changed."""
    order = F.struct(F.xxhash64(key).alias("h"), F.col(key).alias("k"))
    reads = F.col("reads") if "reads" in touched.columns else F.lit(False)
    least = touched.groupBy("item").agg(F.min(order).alias("any"), F.min(F.when(~reads, order)).alias("changes"))
    first = F.when(reads, F.least(F.col("changes"), order)).otherwise(F.col("any"))
    late = touched.join(least, "item").where(F.col(key) != first["k"]).select(key).distinct()
    return pending.join(late, key, "left_anti").select(key)


def settled_pairs(remap: DataFrame) -> DataFrame:
    """``old, new`` with chains followed: every entity goes to the one that its chain ends at. Of several ends, or where a
    chain closes to a ring, the lowest id stays. Pairs of an entity with itself are dropped."""
    shared_dir(remap.sparkSession)
    pairs = remap.select("old", "new").where("old <> new").distinct().transform(settled)
    ends = pairs.select("new").join(pairs.select(F.col("old").alias("new")), "new", "left_semi")
    several = pairs.groupBy("old").count().where("count > 1").select(F.col("old").alias("new"))
    if ends.union(several).isEmpty():
        return pairs
    links = pairs.select(F.col("old").alias("src"), F.col("new").alias("dst"))
    label = components(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), links.union(links.select("dst", "src")))
    last = label.join(pairs.select(F.col("old").alias("node")).distinct().withColumn("goes", F.lit(True)), "node", "left")
    stays = last.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("goes").isNull(), F.col("node"))), F.min("node")).alias("new"))
    return last.join(stays, "component").where("node <> new").select(F.col("node").alias("old"), "new")


def pair(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


# ---- swaps --------------------------------------------------------------------------------------------------------


def swap(m: MeshFrame, edges: DataFrame, topology: bool = False) -> tuple[DataFrame, DataFrame]:
    """``FV`` with the common edge of two triangles replaced by the other diagonal for the edges (``eid``) asked, and what
    became of each: ``eid, round, outcome``.

    Requests may share triangles. The lower face gets the first end. An edge is refused, and says why, that isn't there
    (``no edge``), with ``topology`` isn't on a model face (``not on a model face``), isn't used by two faces in opposite
    directions (``faces``), of which both are triangles (``no triangles``), or whose other diagonal exists (``diagonal
    exists``); all as the mesh is when its turn comes."""
    shared_dir(m.V.sparkSession)
    asked = edges.select("eid").distinct()
    known = asked.join(m.E.select("eid", "v0", "v1", "gdim"), "eid", "left")
    fine = F.col("v0").isNotNull() & (F.col("gdim") == 2 if topology else F.lit(True))
    known = known.withColumn("outcome", F.when(F.col("v0").isNull(), "no edge").when(~fine, "not on a model face")).transform(settled)
    log = known.where("outcome is not null").select("eid", F.lit(0).alias("round"), "outcome")
    pending = known.where("outcome is null").select("eid", "v0", "v1")
    near = m.FE.join(pending.select("eid"), "eid", "left_semi").select("fid").distinct().transform(settled)
    loops = m.FV.join(near, "fid", "left_semi").select("fid", "pos", "vid").transform(settled)
    rest = m.FV.join(near, "fid", "left_anti").select("fid", "pos", "vid")
    # no swap changes the sides of other faces
    far = half_edges(rest).select(pair(F.col("v0"), F.col("v1")).alias("p")).distinct().transform(settled)
    for k in range(1, ROUNDS):
        if pending.isEmpty():
            return rest.union(loops), log
        n = F.count("*").over(Window.partitionBy("fid"))
        sides = half_edges(loops).withColumns({"p": pair(F.col("v0"), F.col("v1")), "n": n})
        third = loops.select("fid", F.pmod(F.col("pos") - 2, F.lit(3)).cast("int").alias("pos"), F.col("vid").alias("opp"))
        uses = sides.join(third, ["fid", "pos"], "left")
        ours = pending.withColumn("p", pair(F.col("v0"), F.col("v1"))).join(uses.select("p", "fid", F.col("v0").alias("from"), "n", "opp"), "p", "left")
        along = F.col("from") == F.col("v0")
        state = ours.groupBy("eid", "v0", "v1", "p").agg(
            F.count("fid").alias("k"),
            F.max("n").alias("n"),
            F.min("fid").alias("fa"),
            F.max("fid").alias("fb"),
            F.max(F.when(along, F.col("opp"))).alias("left"),
            F.max(F.when(~along, F.col("opp"))).alias("right"),
            F.collect_set("fid").alias("faces"),
        )
        state = state.withColumn("diagonal", F.when((F.col("k") == 2) & (F.col("n") == 3) & (F.col("left") != F.col("right")), pair(F.col("left"), F.col("right")))).transform(settled)
        item = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
        items = F.concat(
            F.transform("faces", lambda f: item(2, f, F.lit(0).cast("long"))),
            F.array(item(1, F.col("p.lo"), F.col("p.hi"))),
            F.when(F.col("diagonal").isNotNull(), F.array(item(1, F.col("diagonal.lo"), F.col("diagonal.hi")))).otherwise(F.array()),
        )
        turn = state.join(firsts(state, state.select("eid", F.explode(items).alias("item"))), "eid")
        taken = far.union(sides.select("p")).select(F.col("p").alias("diagonal"), F.lit(True).alias("taken")).distinct()
        why = F.when((F.col("k") != 2), "faces").when(F.col("n") != 3, "no triangles").when(F.col("left").isNull() | F.col("right").isNull() | (F.col("left") == F.col("right")), "faces").when(F.col("taken"), "diagonal exists").otherwise("swapped")
        done = turn.join(taken, "diagonal", "left").withColumn("outcome", why).transform(settled)
        made = done.where("outcome = 'swapped'").select(F.explode(F.array(F.struct(F.col("fa").alias("fid"), F.array("v0", "right", "left").alias("loop")), F.struct(F.col("fb").alias("fid"), F.array("v1", "left", "right").alias("loop")))).alias("t"))
        new = made.select("t.fid", F.posexplode("t.loop").alias("pos", "vid"))
        loops = loops.join(new.select("fid").distinct(), "fid", "left_anti").union(new).transform(settled)
        log = log.union(done.select("eid", F.lit(k).alias("round"), "outcome"))
        pending = pending.join(done.select("eid"), "eid", "left_anti").transform(settled)
    raise RuntimeError(f"swaps aren't done after {ROUNDS} rounds")


# ---- joins of faces -------------------------------------------------------------------------------------------------


def spanning(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id`` of the links (``id``, ``a``, ``b``) that join two pieces when links are taken in the order of their ids (the
    least spanning forest): in each round every piece takes its lowest link to another piece."""
    shared_dir(nodes.sparkSession)
    label = nodes.select("node", F.col("node").alias("piece")).distinct().transform(settled)
    taken = links.select("id").where("false")
    for _ in range(ROUNDS):
        of = lambda c, p: label.select(F.col("node").alias(c), F.col("piece").alias(p))
        open_ = links.join(of("a", "pa"), "a").join(of("b", "pb"), "b").where("pa <> pb").select("id", "pa", "pb").transform(settled)
        if open_.isEmpty():
            return taken
        both = open_.union(open_.select("id", "pb", "pa"))
        low = both.groupBy("pa").agg(F.min("id").alias("id")).select("id").distinct()
        chosen = open_.join(low, "id", "left_semi").transform(settled)
        taken = taken.union(chosen.select("id"))
        arcs = chosen.select(F.col("pa").alias("src"), F.col("pb").alias("dst"))
        merged = components(arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), arcs.union(arcs.select("dst", "src")))
        label = label.join(merged.select(F.col("node").alias("piece"), "component"), "piece", "left").select("node", F.coalesce("component", "piece").alias("piece")).transform(settled)
    raise RuntimeError(f"pieces are still apart after {ROUNDS} rounds")


def ranks(follows: DataFrame) -> DataFrame:
    """``node, rank`` of lists given by successors: ``follows`` has ``node`` and ``next``, null at the end of a list. The rank
    counts from the end (0). Pointers double every round."""
    shared_dir(follows.sparkSession)
    now = follows.select("node", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("rank")).transform(settled)
    for _ in range(64):
        if now.where("next is not null").isEmpty():
            return now.select("node", "rank")
        ahead = now.select(F.col("node").alias("next"), F.col("next").alias("further"), F.col("rank").alias("more"))
        now = now.join(ahead, "next", "left").select("node", F.col("further").alias("next"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")).transform(settled)
    raise ValueError("the successors form a ring")


def _forest(links: DataFrame, piece: DataFrame) -> DataFrame:
    """``id`` of the links that ``spanning`` takes, given what they join (``node``, ``component``). Where there is one link less
    than nodes, no links close a ring, and all are taken; rounds are left to the pieces that have rings."""
    of = links.join(piece.select(F.col("node").alias("a"), "component").hint("merge"), "a")
    sizes = of.groupBy("component").agg(F.count("*").alias("links")).join(piece.groupBy("component").agg(F.count("*").alias("nodes")).hint("merge"), "component")
    ringed = of.join(sizes.where("links >= nodes").select("component").hint("merge"), "component", "left_semi").select("id", "a", "b").transform(settled)
    if ringed.isEmpty():
        return links.select("id")
    trees = links.join(ringed.select("id").hint("merge"), "id", "left_anti").select("id")
    return trees.union(spanning(ringed.select(F.explode(F.array("a", "b")).alias("node")).distinct(), ringed))


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """``fid, pos, keep, size, at`` of whole loops, whose sides (``keep, fid, pos``) name the next one (``nfid, npos``, -1 behind the
    last): pointers double until all are at the end. ``at`` is negative where the end isn't reached."""
    pos, after = rows["pos"].to_numpy(np.int64), rows["npos"].to_numpy(np.int64)
    _, at = np.unique(np.concatenate([rows["fid"].to_numpy(), rows["nfid"].to_numpy()]), return_inverse=True)
    n, wide = len(rows), max(int(pos.max(initial=0)), int(after.max(initial=0))) + 1
    key, to = at[:n] * wide + pos, np.where(after < 0, -1, at[n:] * wide + after)
    order = np.argsort(key, kind="stable")
    place = np.minimum(np.searchsorted(key[order], to), n - 1)
    nxt, rank = np.where((after >= 0) & (key[order][place] == to), order[place], -1), (after >= 0).astype(np.int64)
    for _ in range(64):
        on = np.flatnonzero(nxt >= 0)
        if not len(on):
            break
        rank[on], nxt[on] = rank[on] + rank[nxt[on]], nxt[nxt[on]]
    _, loop, sizes = np.unique(rows["keep"].to_numpy(), return_inverse=True, return_counts=True)
    size = sizes[loop]
    return pd.DataFrame({"fid": rows["fid"], "pos": rows["pos"], "keep": rows["keep"], "size": size.astype(np.int32), "at": np.where(nxt >= 0, -1, size - 1 - rank).astype(np.int32)})


def _places(sides: DataFrame, short: int = SHORT) -> DataFrame:
    """``fid, pos, keep, size, at``: where sides (``keep, node, next``; ``next`` is null behind the last of a loop) stand in the
    loop ``keep``. Loops of at most ``short`` sides are put in order within tasks, longer ones by ``ranks``."""
    sides = sides.transform(settled)
    blocks = max(1, sides.count() // BLOCK_SIDES)
    size = sides.groupBy("keep").agg(F.count("*").cast("int").alias("size"))
    long = size.where(F.col("size") > short).transform(settled)
    flat = sides.join(long.hint("merge"), "keep", "left_anti").select("keep", "node.fid", "node.pos", F.coalesce("next.fid", F.lit(-1)).alias("nfid"), F.coalesce("next.pos", F.lit(-1)).alias("npos"))
    schema = "fid long, pos int, keep long, size int, at int"
    out = flat.groupBy(F.pmod(F.xxhash64("keep"), F.lit(blocks)).alias("block")).applyInPandas(lambda rows: _ordered(rows), schema)
    if not long.isEmpty():
        of_long = sides.join(long.hint("merge"), "keep")
        far = of_long.join(ranks(of_long.select("node", "next")).hint("merge"), "node")
        out = out.union(far.select("node.fid", "node.pos", "keep", "size", (F.col("size") - 1 - F.col("rank")).cast("int").alias("at")))
    out = out.transform(settled)
    if not out.where("at < 0").isEmpty():
        raise ValueError("the successors form a ring")
    return out


def join(m: MeshFrame, edges: DataFrame, topology: bool = False) -> tuple[MeshFrame, DataFrame]:
    """The bundle with the faces at each edge (``eid``) joined under the lowest id, in chains too, and what became of every
    request: ``eid, outcome``.

    Edges are taken in the order of their ids. One is refused that isn't there (``no edge``), isn't used by two faces in
    opposite directions (``faces``), whose faces lie between different cells (``cells``), with ``topology`` are on
    different model entities (``model entities``), or are one face by then (``one face``). The loop of a joined face begins
    behind its lowest joined edge in the face that gives the id. Tables of faces, edges, incidence, attribute values
    and sets follow; vertices stay."""
    shared_dir(m.V.sparkSession)
    asked = edges.select("eid").distinct().join(m.E.select("eid", F.lit(True).alias("there")), "eid", "left")
    use = m.FE.join(asked.select("eid"), "eid", "left_semi").transform(settled)
    ent = m.F.select("fid", F.struct("gdim", "gent").alias("ent"))
    cells = m.RF.groupBy("fid").agg(F.array_sort(F.collect_set("rid")).alias("cells"))  # a face has at most two
    none = F.array().cast("array<bigint>")
    seen = use.join(ent, "fid").join(cells, "fid", "left").withColumn("cells", F.coalesce("cells", none))
    two = seen.groupBy("eid").agg(F.count("*").alias("k"), F.count_distinct("dir").alias("d"), F.min("fid").alias("a"), F.max("fid").alias("b"), F.count_distinct("ent").alias("ents"), F.count_distinct("cells").alias("sides"))
    why = F.when(F.col("there").isNull(), "no edge").when((F.coalesce("k", F.lit(0)) != 2) | (F.col("d") != 2), "faces").when(F.col("a") == F.col("b"), "one face").when(F.col("sides") != 1, "cells")
    if topology:
        why = why.when(F.col("ents") != 1, "model entities")
    judged = asked.join(two, "eid", "left").withColumn("outcome", why).transform(settled)
    links = judged.where("outcome is null").select(F.col("eid").alias("id"), "a", "b")
    arcs = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    pieces = components(arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), arcs.union(arcs.select("dst", "src")))
    taken = _forest(links, pieces).transform(settled)
    piece = pieces.select(F.col("node").alias("fid"), F.col("component").alias("keep"))
    outcome = judged.join(taken.select(F.col("id").alias("eid"), F.lit("joined").alias("made")), "eid", "left").select("eid", F.coalesce("outcome", "made", F.lit("one face")).alias("outcome"))
    # half edges by (fid, pos); each leads to the next of its face, those that are joined on to what follows their twin
    n = m.F.select("fid", "n")
    half = F.struct(F.col("fid"), F.col("pos"))
    mine = m.FE.select("fid", "pos", "eid").join(piece, "fid").join(n, "fid").withColumns({"h": half, "nxt": F.struct(F.col("fid"), F.pmod(F.col("pos") + 1, F.col("n")).cast("int").alias("pos"))}).transform(settled)
    gone = mine.join(taken.select(F.col("id").alias("eid")), "eid").select("eid", "keep", "fid", "h", "nxt")
    twin = gone.select("eid", F.col("h").alias("th"), F.col("nxt").alias("to"))
    jump = gone.join(twin, "eid").where("h <> th").select("h", F.col("to")).transform(settled)
    for _ in range(64):
        behind = jump.join(jump.select(F.col("h").alias("to"), F.col("to").alias("on")), "to", "left")
        if behind.where("on is not null").isEmpty():
            break
        jump = behind.select("h", F.coalesce("on", "to").alias("to")).transform(settled)
    left = mine.join(gone.select("h"), "h", "left_anti")
    jumped = jump.select(F.col("h").alias("nxt"), "to")
    after = left.join(jumped, "nxt", "left").select("keep", F.col("h").alias("node"), F.coalesce("to", "nxt").alias("next"))
    start = gone.where("fid = keep").groupBy("keep").agg(F.min_by("nxt", "eid").alias("s"))
    start = start.join(jump.select(F.col("h").alias("s"), "to"), "s", "left").select("keep", F.coalesce("to", "s").alias("s"))
    place = _places(after.join(start, "keep").select("keep", "node", F.when(F.col("next") != F.col("s"), F.col("next")).alias("next")))
    size = place.where("at = 0").select("keep", "size")

    def moved(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in ("fid", "pos")]
        rest = df.join(piece.select("fid"), "fid", "left_anti").select("fid", "pos", *others)
        return rest.union(df.join(place, ["fid", "pos"]).select(F.col("keep").alias("fid"), F.col("at").alias("pos"), *others))

    lost = piece.where("fid <> keep").select("fid")
    size = size.select(F.col("keep").alias("fid"), "size")
    f = m.F.join(lost, "fid", "left_anti").join(size, "fid", "left").select("fid", F.coalesce("size", "n").alias("n"), "gdim", "gent")
    hit = m.RF.join(lost, "fid", "left_semi").select("rid").distinct()
    rf = m.RF.join(lost, "fid", "left_anti")
    near = rf.join(hit, "rid", "left_semi").withColumn("pos", F.row_number().over(Window.partitionBy("rid").orderBy("pos")) - 1)
    rf = rf.join(hit, "rid", "left_anti").unionByName(near).select("rid", "pos", "fid", "dir")
    dead = lost.select(F.lit(2).alias("dim"), F.col("fid").alias("id")).union(taken.select(F.lit(1).alias("dim"), "id"))
    e = m.E.join(taken.select(F.col("id").alias("eid")), "eid", "left_anti")
    tables = {t: m.tables[t].join(dead, ["dim", "id"], "left_anti").select(*m.tables[t].columns) for t in ("AV", "SM")}
    return m.with_tables(F=f, FE=moved(m.FE), FV=moved(m.FV), E=e, RF=rf, **tables), outcome


# ---- collapses ----------------------------------------------------------------------------------------------------


def merge_points(m: MeshFrame, remap: DataFrame) -> tuple[MeshFrame, DataFrame, DataFrame]:
    """The bundle, surface or solid, with vertices ``old`` become ``new`` (chains are followed), and all that follows from it:
    edges and faces that coincide are merged under the lowest id, the directions of their uses kept; edges of one vertex,
    faces of under three and cells that have a face twice are deleted. Attribute values of what goes are dropped and
    set members renamed. Also the merged pairs (``dim, old, new``) and the deleted entities (``dim, id``; merged ones not).
    """
    shared_dir(m.V.sparkSession)
    points = settled_pairs(remap).join(m.V.select(F.col("vid").alias("old")), "old", "left_semi").join(m.V.select(F.col("vid").alias("new")), "new", "left_semi").select("old", "new").transform(settled)

    def at(df: DataFrame, column: str, by: DataFrame = points) -> DataFrame:
        r = by.select(F.col("old").alias(column), F.col("new").alias("__n"))
        return df.join(r, column, "left").withColumn(column, F.coalesce("__n", column)).drop("__n")

    e = at(at(m.E, "v0"), "v1").withColumns({"lo": F.least("v0", "v1"), "hi": F.greatest("v0", "v1")}).transform(settled)
    none = e.where("lo = hi").select("eid")
    kept = e.where("lo < hi").groupBy("lo", "hi").agg(F.min("eid").alias("new"), F.min_by("v0", "eid").alias("from"))
    e_map = e.where("lo < hi").join(kept, ["lo", "hi"]).select(F.col("eid").alias("old"), "new", (F.col("v0") != F.col("from")).alias("turn")).transform(settled)
    loops = at(m.FV, "vid").select("fid", "pos", "vid")
    w = Window.partitionBy("fid").orderBy("pos")
    # an edge of one vertex leaves its loop, with the vertex at its beginning
    side = m.FE.join(none, "eid", "left_anti").select("fid", "pos", "eid", "dir")
    side = side.withColumns({"n": F.count("*").over(Window.partitionBy("fid")), "at": F.row_number().over(w) - 1}).transform(settled)
    alive = side.where("n >= 3")
    fe = alive.join(e_map.withColumnRenamed("old", "eid"), "eid").select("fid", F.col("at").alias("pos"), F.col("new").alias("eid"), F.when(F.col("turn"), 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir"))
    fv = loops.join(alive.select("fid", "pos", "at"), ["fid", "pos"]).select("fid", F.col("at").alias("pos"), "vid").transform(settled)
    flat = m.F.join(fv.select("fid").distinct(), "fid", "left_anti").select("fid")
    keys = fv.groupBy("fid").agg(F.array_sort(F.collect_list("vid")).alias("key"), F.count("*").cast("int").alias("n")).transform(settled)
    if m.R.isEmpty():  # faces of a surface stay apart, even where they coincide
        f_map = keys.select(F.col("fid").alias("old"), F.col("fid").alias("new"), F.lit(False).alias("turn"))
        rf, r, bad = m.RF, m.R, m.R.select("rid")
    else:
        same = keys.groupBy("key").agg(F.min("fid").alias("new"), F.count("*").alias("k"))
        pairs = keys.join(same, "key").select(F.col("fid").alias("old"), "new")
        sides = half_edges(fv)
        first = pairs.where("old <> new").join(sides.where("pos = 0").select(F.col("fid").alias("old"), "v0", "v1"), "old")
        alike = first.join(sides.select(F.col("fid").alias("new"), "v0", "v1"), ["new", "v0", "v1"], "left_semi").select("old", F.lit(False).alias("turn"))
        f_map = pairs.join(alike, "old", "left").select("old", "new", F.coalesce("turn", F.col("old") != F.col("new")).alias("turn")).transform(settled)
        use = m.RF.join(f_map.withColumnRenamed("old", "fid"), "fid").select("rid", "pos", F.col("new").alias("fid"), F.when(F.col("turn"), 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir"))
        bad = use.groupBy("rid", "fid").count().where("count > 1").select("rid").union(m.R.select("rid").join(use.select("rid"), "rid", "left_anti")).distinct().transform(settled)
        rf = use.join(bad, "rid", "left_anti").select("rid", (F.row_number().over(Window.partitionBy("rid").orderBy("pos")) - 1).alias("pos"), "fid", "dir")
        r = m.R.join(bad, "rid", "left_anti")
    lone = f_map.where("old <> new").select(F.col("old").alias("fid"))
    f = m.F.drop("n").join(keys.select("fid", "n"), "fid").join(lone, "fid", "left_anti").select("fid", "n", "gdim", "gent")
    rv = at(m.RV, "vid").join(bad, "rid", "left_anti").select("rid", "pos", "vid")
    merged = points.select(F.lit(0).alias("dim"), "old", "new").union(e_map.where("old <> new").select(F.lit(1), "old", "new")).union(f_map.where("old <> new").select(F.lit(2), "old", "new")).transform(settled)
    deleted = none.select(F.lit(1).alias("dim"), F.col("eid").alias("id")).union(flat.select(F.lit(2), "fid")).union(bad.select(F.lit(3), "rid")).transform(settled)
    off = merged.select("dim", F.col("old").alias("id")).union(deleted)
    named = m.SM.join(deleted, ["dim", "id"], "left_anti").join(merged.select("dim", F.col("old").alias("id"), "new"), ["dim", "id"], "left")
    sm = named.select("set", "pos", "dim", F.coalesce("new", "id").alias("id")).groupBy("set", "dim", "id").agg(F.min("pos").alias("pos")).select("set", "pos", "dim", "id")
    e_new = e.join(e_map.where("old <> new").select(F.col("old").alias("eid")), "eid", "left_anti").join(none, "eid", "left_anti").select(*m.E.columns)
    v = m.V.join(points.select(F.col("old").alias("vid")), "vid", "left_anti")
    av = m.AV.join(off, ["dim", "id"], "left_anti").select(*m.AV.columns)
    out = m.with_tables(V=v, E=e_new, F=f, FE=fe.join(lone, "fid", "left_anti"), FV=fv.join(lone, "fid", "left_anti"), R=r, RF=rf, RV=rv, AV=av, SM=sm)
    return out, merged, deleted


def collapse_pairs(m: MeshFrame, edges: DataFrame, topology: bool = True, link: bool = True, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices ``old, new`` that collapses of the edges (``eid``) merge, and what became of every request: ``eid, round,
    outcome``.

    The second vertex stays, or the one that ``keep`` (``eid``, ``vid``) names. With ``topology`` the one on the model entity
    of lower dimension stays, whatever ``keep`` says for others; ends on different entities of one dimension are refused
    (``model entities``), as is one that ``keep`` has stay though it is on the higher dimension. With ``link`` an edge is refused whose ends have a common neighbour
    without a triangle of the three, or that stand in one face without being neighbours there (``link``): the result would
    touch itself. An edge whose ends are one by then is ``gone``. Requests may share vertices; later ones are judged on
    what earlier ones made."""
    shared_dir(m.V.sparkSession)
    asked = edges.select("eid").distinct()
    known = asked.join(m.E.select("eid", "v0", "v1"), "eid", "left")
    if keep is not None:
        known = known.join(keep.select("eid", F.col("vid").alias("wish")), "eid", "left")
    else:
        known = known.withColumn("wish", F.lit(None).cast("long"))
    known = known.transform(settled)
    log = known.where("v0 is null").select("eid", F.lit(0).alias("round"), F.lit("no edge").alias("outcome"))
    pending = known.where("v0 is not null")
    place = m.V.select("vid", "gdim", "gent")
    remap = asked.where("false").select(F.col("eid").alias("old"), F.col("eid").alias("new"))
    # faces and edges that any request can reach: those at its ends
    ends = pending.select(F.explode(F.array("v0", "v1")).alias("vid")).distinct()
    if link:
        near = m.FV.join(m.FV.join(ends, "vid", "left_semi").select("fid").distinct(), "fid", "left_semi").select("fid", "pos", "vid").transform(settled)
        touch = ends.withColumnRenamed("vid", "v")
        arcs = m.E.select("v0", "v1").union(m.E.select("v1", "v0")).toDF("v", "w").join(touch, "v", "left_semi").transform(settled)
    for k in range(1, ROUNDS):
        ids = {"v0": "a", "v1": "b", "wish": "wish"}
        now = pending
        for c, d in ids.items():
            now = now.join(remap.select(F.col("old").alias(c), F.col("new").alias("__n")), c, "left").withColumn(d, F.coalesce("__n", c)).drop("__n")
        now = now.select("eid", "a", "b", "wish").transform(settled)
        if now.isEmpty():
            return remap, log
        one = now.where("a = b").select("eid", F.lit(k).alias("round"), F.lit("gone").alias("outcome"))
        state = now.where("a <> b")
        touched = state.select("eid", F.explode(F.array("a", "b")).alias("item"))
        if link:
            moved = lambda df, c: df.join(remap.select(F.col("old").alias(c), F.col("new").alias("__n")), c, "left").withColumn(c, F.coalesce("__n", c)).drop("__n")
            graph = moved(moved(arcs, "v"), "w").where("v <> w").select("v", "w").distinct().transform(settled)
            read = touched.join(graph, F.col("item") == F.col("v")).select("eid", F.col("w").alias("item")).distinct()
            touched = touched.withColumn("reads", F.lit(False)).union(read.withColumn("reads", F.lit(True)))
        turn = state.join(firsts(state, touched), "eid").transform(settled)
        side = lambda c, i: place.select(F.col("vid").alias(c), F.col("gdim").alias(f"d{i}"), F.col("gent").alias(f"g{i}"))
        seen = turn.join(side("a", 0), "a").join(side("b", 1), "b")
        stays = F.coalesce("wish", "b")
        higher = F.when(stays == F.col("b"), F.col("d1") > F.col("d0")).otherwise(F.col("d0") > F.col("d1"))
        clash = (F.col("d0") == F.col("d1")) & (F.col("g0") != F.col("g1")) | (F.col("wish").isNotNull() & higher) if topology else F.lit(False)
        if topology:
            stays = F.when(F.col("wish").isNull() & higher, F.col("a")).otherwise(stays)
        seen = seen.select("eid", "a", "b", stays.alias("new"), clash.alias("clash"))
        if link:
            common = turn.join(graph.select(F.col("v").alias("a"), "w"), "a").join(graph.select(F.col("v").alias("b"), "w"), ["b", "w"]).groupBy("eid").agg(F.count("*").alias("shared"))
            loops = moved(near, "vid").select("fid", "pos", "vid")
            w = Window.partitionBy("fid").orderBy("pos")
            before = F.coalesce(F.lag("vid").over(w), F.last("vid").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            clean = loops.withColumn("p", before).where("vid <> p").withColumn("n", F.count("*").over(Window.partitionBy("fid"))).where("n >= 3")
            has = lambda c: clean.select("fid", F.col("vid").alias(c), F.col("p").alias(f"p{c}"), "n")
            both = turn.join(has("a"), "a").join(has("b").drop("n"), ["fid", "b"])
            by_face = both.groupBy("eid", "fid").agg(F.max("n").alias("n"), F.max(((F.col("pb") == F.col("a")) | (F.col("pa") == F.col("b"))).cast("int")).alias("meet"), F.count("*").alias("times"))
            third = clean.where("n = 3").join(by_face.where("n = 3"), "fid").join(turn.select("eid", "a", "b"), "eid").where("vid <> a and vid <> b").groupBy("eid").agg(F.count_distinct("vid").alias("thirds"))
            apart = by_face.groupBy("eid").agg(F.max(((F.col("meet") == 0) | (F.col("times") > 1)).cast("int")).alias("apart"))
            seen = seen.join(common, "eid", "left").join(third, "eid", "left").join(apart, "eid", "left")
            zero = F.lit(0)
            torn = (F.coalesce("shared", zero) != F.coalesce("thirds", zero)) | (F.coalesce("apart", zero) == 1)
        else:
            torn = F.lit(False)
        done = seen.withColumn("outcome", F.when(F.col("clash"), "model entities").when(torn, "link").otherwise("collapsed")).transform(settled)
        made = done.where("outcome = 'collapsed'").select(F.when(F.col("new") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("old"), "new")
        # vertices that came to what goes now go on
        remap = remap.join(made.select(F.col("old").alias("new"), F.col("new").alias("on")), "new", "left").select("old", F.coalesce("on", "new").alias("new")).union(made).transform(settled)
        log = log.union(one).union(done.select("eid", F.lit(k).alias("round"), "outcome"))
        pending = pending.join(one.select("eid").union(done.select("eid")), "eid", "left_anti").transform(settled)
    raise RuntimeError(f"collapses aren't done after {ROUNDS} rounds")


def collapse(m: MeshFrame, edges: DataFrame, topology: bool = True, link: bool = True, keep: DataFrame | None = None) -> tuple[MeshFrame, DataFrame, DataFrame, DataFrame]:
    """The bundle after collapsing the edges (``eid``) asked, as ``collapse_pairs`` settles them, with the merged pairs (``dim,
    old, new``), the deleted entities (``dim, id``) and what became of every request (``eid, round, outcome``)."""
    pairs, log = collapse_pairs(m, edges, topology, link, keep)
    out, merged, deleted = merge_points(m, pairs)
    return out, merged, deleted, log
