"""Splits of simplex meshes and of polyhedra, and flags of deleted entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, number
from ..working import shared_dir, shuffled
from . import graph


def _new_points(v: DataFrame, keys: DataFrame, corners: list[str], major: str, *minor: str) -> DataFrame:
    """``keys`` with ``new``: ids after the largest, and the mean of their corners as ``x, y, z``."""
    top = v.agg(F.coalesce(F.max("vid"), F.lit(0)).alias("top"))
    made = number(keys, "k", major, *minor).crossJoin(F.broadcast(top)).withColumn("new", F.col("top") + F.col("k")).drop("k", "top")  # one row
    for i, c in enumerate(corners):
        made = made.join(v.select(F.col("vid").alias(c), *[F.col(a).alias(f"{a}{i}") for a in "xyz"]), c)
    n = len(corners)
    return made.select(*keys.columns, "new", *[(sum(F.col(f"{a}{i}") for i in range(n)) / n).alias(a) for a in "xyz"])


def split_simplex_edges(v: DataFrame, cells: DataFrame, key: str, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``V`` and cells (``key, pos, vid``; triangles or tetrahedra) with the edges (``a``, ``b``) cut in the middle.

    Each cell at an edge becomes two by substitution: the old id keeps ``a``, a new one (after the largest, in order
    of edge and cell) keeps ``b``. No cell may have two of the edges."""
    pts = _new_points(v, edges.select("a", "b"), ["a", "b"], "a", "b")
    at = cells.join(pts.select(F.col("a").alias("vid"), "b", "new"), "vid").select(key, F.col("vid").alias("a"), "b", "new")
    hit = at.join(cells.select(key, F.col("vid").alias("b")), [key, "b"])
    top = cells.agg(F.max(key).alias("top"))
    twin = number(hit, "k", "a", "b", key).crossJoin(F.broadcast(top)).select(key, "a", "b", "new", (F.col("top") + F.col("k")).alias("twin"))  # one row
    j = cells.join(twin, key, "left")
    one = j.select(key, "pos", F.when(F.col("vid") == F.col("b"), F.col("new")).otherwise(F.col("vid")).alias("vid"))
    two = j.where("twin is not null").select(F.col("twin").alias(key), "pos", F.when(F.col("vid") == F.col("a"), F.col("new")).otherwise(F.col("vid")).alias("vid"))
    points = pts.select(F.col("new").alias("vid"), "x", "y", "z", F.lit(4).alias("gdim"), F.lit(0).cast("long").alias("gent"))
    return v.select("vid", "x", "y", "z", "gdim", "gent").union(points), one.union(two)


def split_simplex_faces(v: DataFrame, rv: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``V`` and tetrahedra with faces (``a``, ``b``, ``c``) cut at their centres: each cell at a face becomes three, one
    per side of the face. No cell may have two of the faces."""
    pts = _new_points(v, faces.select("a", "b", "c"), ["a", "b", "c"], "a", "b", "c")
    hit = rv.select("rid", F.col("vid").alias("a")).join(pts.select("a", "b", "c", "new"), "a").join(rv.select("rid", F.col("vid").alias("b")), ["rid", "b"]).join(rv.select("rid", F.col("vid").alias("c")), ["rid", "c"])
    top = rv.agg(F.max("rid").alias("top"))
    twins = number(hit, "k", "rid").crossJoin(F.broadcast(top)).select("rid", "a", "b", "c", "new", F.col("top"), "k")  # one row
    out = F.posexplode(F.array("a", "b", "c")).alias("i", "out")
    three = twins.select("rid", "new", "top", "k", out).withColumn("id", F.when(F.col("i") == 0, F.col("rid")).otherwise(F.col("top") + 2 * (F.col("k") - 1) + F.col("i")))
    made = rv.join(three, "rid").select(F.col("id").alias("rid"), "pos", F.when(F.col("vid") == F.col("out"), F.col("new")).otherwise(F.col("vid")).alias("vid"))
    points = pts.select(F.col("new").alias("vid"), "x", "y", "z", F.lit(4).alias("gdim"), F.lit(0).cast("long").alias("gent"))
    return v.select("vid", "x", "y", "z", "gdim", "gent").union(points), rv.join(twins.select("rid"), "rid", "left_anti").select("rid", "pos", "vid").union(made)


def split_region(rf: DataFrame, fe: DataFrame, rid: int, loop: DataFrame, new_fid: int, new_rid: int) -> DataFrame:
    """``RF`` with a polyhedron cut along a closed loop of edges (``eid``) by a new face ``new_fid``: its faces fall into
    components that the loop's edges separate; the component of the smallest face id keeps the id. The new face is
    used outwards (1) by the old and inwards (0) by the new cell."""
    mine = rf.where(F.col("rid") == rid)
    sides = mine.select("fid").join(fe.select("fid", "eid"), "fid").join(loop, "eid", "left_anti")
    pairs = sides.join(sides.withColumnRenamed("fid", "dst"), "eid").where("fid <> dst").select(F.col("fid").alias("src"), "dst").distinct()
    parts = graph.components(mine.select(F.col("fid").alias("node")), pairs)
    low = parts.agg(F.min("component").alias("low"))
    cut = mine.join(parts, F.col("fid") == F.col("node")).crossJoin(F.broadcast(low))  # one row
    moved = cut.select(F.when(F.col("component") == F.col("low"), F.lit(rid)).otherwise(F.lit(new_rid)).cast("long").alias("rid"), "pos", "fid", "dir")
    spark = rf.sparkSession
    cap = spark.createDataFrame([(rid, 1 << 30, new_fid, 1), (new_rid, 1 << 30, new_fid, 0)], "rid long, pos int, fid long, dir int")
    made = moved.unionByName(cap).withColumn("pos", F.row_number().over(Window.partitionBy("rid").orderBy("pos")) - 1)
    return rf.where(F.col("rid") != rid).select("rid", "pos", "fid", "dir").unionByName(made)


def split_regions(m: MeshFrame, loops: DataFrame) -> tuple[MeshFrame, DataFrame]:
    """The bundle with cells cut along closed loops of their edges (``rid, pos, eid``; a loop a cell, in order), all at once,
    and what became of every request: ``rid, outcome, new_fid, new_rid``.

    The faces of a cell fall into the pieces that the loop separates; the piece of the smallest face id keeps the id, the
    other is a new cell. A new face, whose loop is the one given, closes both: its direction in the old cell is the one that
    opposes the faces at the loop's first edge. New ids follow the largest, in the order of cells. New faces and cells
    are classified like the cell. A request is refused whose edges aren't all the cell's (``edges``), form no closed loop
    (``open``) or don't separate its faces in two (``no cut``)."""
    shared_dir(m.V.sparkSession)
    m = m.shuffled()
    asked = loops.select("rid", "pos", "eid").transform(shuffled)
    w = Window.partitionBy("rid").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = asked.join(m.E.select("eid", "v0", "v1"), "eid", "left")
    p0, p1 = (F.coalesce(F.lag(c).over(w), F.last(c).over(whole)) for c in ("v0", "v1"))
    walk = ends.withColumns({"p0": p0, "p1": p1})
    # an edge begins where the one before it ends
    begin = F.when(F.col("v0").isin(F.col("p0"), F.col("p1")), F.col("v0")).when(F.col("v1").isin(F.col("p0"), F.col("p1")), F.col("v1"))
    walk = walk.withColumn("vid", begin).select("rid", F.row_number().over(w).alias("k"), "eid", "vid", (F.col("vid") == F.col("v0")).cast("int").alias("dir"), F.when(F.col("vid") == F.col("v0"), F.col("v1")).otherwise(F.col("v0")).alias("to")).transform(shuffled)
    after = F.coalesce(F.lead("vid").over(Window.partitionBy("rid").orderBy("k")), F.first("vid").over(Window.partitionBy("rid").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    closed = walk.withColumn("next", after).groupBy("rid").agg(F.count("*").alias("n"), F.min((F.col("to") == F.col("next")).cast("int")).alias("shut"), F.count("vid").alias("known"), F.count_distinct("vid").alias("points"))
    mine = m.RF.join(asked.select("rid").distinct(), "rid").transform(shuffled)
    use = mine.select("rid", "fid", F.col("dir").alias("out")).join(m.FE.select("fid", "eid", "dir"), "fid").transform(shuffled)
    at_loop = use.join(asked.select("rid", "eid"), ["rid", "eid"], "left_semi")
    own = at_loop.groupBy("rid").agg(F.count_distinct("eid").alias("own"))
    nodes = number(mine.select("rid", "fid").distinct(), "node", "rid", "fid").transform(shuffled)
    at = use.join(asked.select("rid", "eid"), ["rid", "eid"], "left_anti").join(nodes, ["rid", "fid"]).select("rid", "eid", "node")
    low = at.groupBy("rid", "eid").agg(F.min("node").alias("low"))  # an edge joins all faces of the cell that have it
    pairs = at.join(low, ["rid", "eid"]).where("node <> low").select(F.col("node").alias("src"), F.col("low").alias("dst"))
    label = graph.components(nodes.select("node"), pairs.union(pairs.select("dst", "src")))
    pieces = nodes.join(label, "node").select("rid", "fid", "component").transform(shuffled)
    many = pieces.groupBy("rid").agg(F.count_distinct("component").alias("pieces"), F.min("component").alias("keep"))
    judged = asked.select("rid").distinct().join(closed, "rid", "left").join(own, "rid", "left").join(many, "rid", "left")
    zero = F.lit(0)
    why = F.when(F.coalesce("own", zero) != F.col("n"), "edges").when((F.col("n") < 3) | (F.col("known") < F.col("n")) | (F.col("points") < F.col("n")) | (F.col("shut") == 0), "open").when(F.coalesce("pieces", zero) != 2, "no cut").otherwise("cut")
    judged = judged.withColumn("outcome", why).transform(shuffled)
    tops = m.F.agg(F.coalesce(F.max("fid"), F.lit(0)).alias("tf")).crossJoin(m.R.agg(F.coalesce(F.max("rid"), F.lit(0)).alias("tr")))  # one row
    made = number(judged.where("outcome = 'cut'").select("rid", "keep", "n"), "j", "rid").crossJoin(F.broadcast(tops)).select("rid", "keep", "n", (F.col("tf") + F.col("j")).alias("new_fid"), (F.col("tr") + F.col("j")).alias("new_rid")).transform(shuffled)
    outcome = judged.select("rid", "outcome").join(made.select("rid", "new_fid", "new_rid"), "rid", "left")
    cut = made.join(walk, "rid")
    fe = cut.select(F.col("new_fid").alias("fid"), (F.col("k") - 1).cast("int").alias("pos"), "eid", "dir")
    fv = cut.select(F.col("new_fid").alias("fid"), (F.col("k") - 1).cast("int").alias("pos"), "vid")
    # how the kept piece runs along the loop's first edge, looked at from outside
    first = cut.where("k = 1").select("rid", "eid", F.col("dir").alias("given"), "new_fid", "new_rid", "keep")
    kept = at_loop.join(first, ["rid", "eid"]).join(pieces, ["rid", "fid"]).where("component = keep")
    side = kept.groupBy("rid", "new_fid", "new_rid").agg(F.max((F.when(F.col("out") == 1, F.col("dir")).otherwise(1 - F.col("dir")) != F.col("given")).cast("int")).alias("dir"))
    ends_ = side.select(F.explode(F.array(F.struct(F.col("rid"), F.col("dir")), F.struct(F.col("new_rid").alias("rid"), (1 - F.col("dir")).alias("dir")))).alias("u"), "new_fid")
    cap = ends_.select("u.rid", F.lit(1 << 30).alias("pos"), F.col("new_fid").alias("fid"), "u.dir")
    moved = mine.join(made.select("rid", "keep", "new_rid"), "rid").join(pieces, ["rid", "fid"]).select(F.when(F.col("component") == F.col("keep"), F.col("rid")).otherwise(F.col("new_rid")).alias("rid"), "pos", "fid", "dir")
    both = moved.unionByName(cap).withColumn("pos", F.row_number().over(Window.partitionBy("rid").orderBy("pos", "fid")) - 1).transform(shuffled)
    gone = made.select("rid")
    ent = m.R.join(made, "rid")
    tables = {
        "F": m.F.unionByName(ent.select(F.col("new_fid").alias("fid"), F.col("n").cast("int").alias("n"), "gdim", "gent")),
        "FE": m.FE.select("fid", "pos", "eid", "dir").unionByName(fe),
        "FV": m.FV.select("fid", "pos", "vid").unionByName(fv),
        "R": m.R.join(gone, "rid", "left_anti").unionByName(ent.select("rid", F.lit("POLYHEDRON").alias("rtype"), "gdim", "gent")).unionByName(ent.select(F.col("new_rid").alias("rid"), F.lit("POLYHEDRON").alias("rtype"), "gdim", "gent")),
        "RF": m.RF.join(gone, "rid", "left_anti").select("rid", "pos", "fid", "dir").unionByName(both),
    }
    corners = both.join(tables["FV"].select("fid", "vid"), "fid").select("rid", "vid").distinct()
    corners = corners.select("rid", (F.row_number().over(Window.partitionBy("rid").orderBy("vid")) - 1).alias("pos"), "vid")
    tables["RV"] = m.RV.join(gone, "rid", "left_anti").select("rid", "pos", "vid").unionByName(corners)
    return m.with_tables(**tables), outcome


def flag_deleted(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Entities kept but flagged (``deleted``), so that they can be restored."""
    base = df if "deleted" in df.columns else df.withColumn("deleted", F.lit(False))
    hit = gone.select(F.col("id").alias(key)).distinct().withColumn("__h", F.lit(True))
    return base.join(hit, key, "left").withColumn("deleted", F.col("deleted") | F.coalesce("__h", F.lit(False))).drop("__h")


def restore(df: DataFrame, key: str, back: DataFrame) -> DataFrame:
    hit = back.select(F.col("id").alias(key)).distinct().withColumn("__h", F.lit(True))
    return df.join(hit, key, "left").withColumn("deleted", F.col("deleted") & ~F.coalesce("__h", F.lit(False))).drop("__h")


def dimension(entities: DataFrame) -> DataFrame:
    """``dim`` of entities, -1 for deleted ones."""
    return entities.withColumn("dim", F.when(F.col("deleted"), -1).otherwise(F.col("dim")))
