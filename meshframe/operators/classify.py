"""Classification on a geometric model from cells down, and topology checks.

New model ids are dense ranks of signatures; they equal those of any other order up to relabelling.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame
from ..schema import UNKNOWN_DIM, UNKNOWN_ID
from ..working import settled
from .geometry import dihedral_cosines
from .graph import components


def _ranked(df: DataFrame, *signature: str) -> DataFrame:
    """Signatures are one row per model entity, far fewer than mesh entities: these rows alone meet in one window."""
    keys = df.select(*signature).distinct()
    return df.join(keys.withColumn("gent", F.dense_rank().over(Window.orderBy(*signature)).cast("long")), list(signature))


def fill_region_ids(m: MeshFrame) -> DataFrame:
    """``rid, gdim, gent``: cells without a model id (0 or less) get one id beyond all others."""
    top = m.R.agg(F.greatest(F.max("gent"), F.lit(0)).alias("top"))
    return m.R.crossJoin(F.broadcast(top)).select("rid", F.lit(3).alias("gdim"), F.when(F.col("gent") <= 0, F.col("top") + 1).otherwise(F.col("gent")).alias("gent"))  # one row


#: Surfaces are cut along edges whose faces meet at a sharper angle than this (degrees).
SMOOTH = 150.0


def classify_faces(m: MeshFrame, geometry: bool = False, keep: bool = False) -> DataFrame:
    """``fid, gdim, gent``: inside (3) between cells of one material, else on a boundary (2) per pair of materials.

    With ``keep``, boundary faces that have a positive id of dimension 2 keep it and new ids follow the largest. With
    ``geometry``, each boundary surface is cut along ``sharp_edges``: its pieces are connected over smooth edges."""
    regions = fill_region_ids(m)
    ids = m.RF.join(regions.select("rid", F.col("gent").alias("mat")), "rid").groupBy("fid").agg(F.count("*").alias("k"), F.min("mat").alias("a"), F.max("mat").alias("b"))
    f = m.F.select("fid", F.when((F.col("gdim") == 2) & (F.col("gent") > 0), F.col("gent")).alias("had")).join(ids, "fid", "left").select("fid", "had", F.coalesce("k", F.lit(0)).alias("k"), F.when(F.col("k") == 2, F.col("a")).otherwise(0).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    inside = f.where("k = 2 and a = b").select("fid", F.lit(3).alias("gdim"), F.col("a").cast("long").alias("gent"))
    border = f.where("not (k = 2 and a = b)")
    kept = border.where("had is not null").select("fid", F.lit(2).alias("gdim"), F.col("had").alias("gent")) if keep else None
    new = border.where("had is null") if keep else border
    signature = ["a", "b"]
    if geometry:
        pairs = _meetings(m, new.select("fid", F.struct("a", "b").alias("sig"))).where(F.col("cosine") <= float(np.cos(np.radians(SMOOTH))))
        links = pairs.select(F.col("f1").alias("src"), F.col("f2").alias("dst"))
        piece = components(new.select(F.col("fid").alias("node")), links.union(links.select("dst", "src")))
        new, signature = new.join(piece.withColumnRenamed("node", "fid"), "fid"), ["a", "b", "component"]
    out = inside.union(_ranked(new, *signature).select("fid", F.lit(2).alias("gdim"), "gent"))
    if keep:
        top = kept.agg(F.coalesce(F.max("gent"), F.lit(0)).alias("top"))
        shifted = out.crossJoin(F.broadcast(top)).select("fid", "gdim", F.when(F.col("gdim") == 2, F.col("gent") + F.col("top")).otherwise(F.col("gent")).alias("gent"))  # one row
        out = shifted.union(kept)
    return out


def _meetings(m: MeshFrame, faces: DataFrame) -> DataFrame:
    """``eid, f1, f2, cosine`` of edges where exactly two of ``faces`` (``fid``, ``sig``) meet and agree in ``sig``."""
    at = m.FE.join(faces, "fid")
    two = at.groupBy("eid").agg(F.count("*").alias("k"), F.min("fid").alias("f1"), F.max("fid").alias("f2"), F.count_distinct("sig").alias("s")).where("k = 2 and s = 1 and f1 < f2").select("eid", "f1", "f2")
    return dihedral_cosines(m).join(two, ["eid", "f1", "f2"])


def sharp_edges(m: MeshFrame, faces: DataFrame) -> DataFrame:
    """``eid`` of edges between two boundary faces of one surface (``fid, gdim, gent``) that meet sharper than SMOOTH."""
    return _meetings(m, faces.where("gdim = 2").select("fid", F.col("gent").alias("sig"))).where(F.col("cosine") > float(np.cos(np.radians(SMOOTH)))).select("eid").distinct()


def classify_edges(m: MeshFrame, faces: DataFrame | None = None, sharp: DataFrame | None = None) -> DataFrame:
    """``eid, gdim, gent`` from the classification of faces (``fid, gdim, gent``; by default that of the mesh). Edges in
    ``sharp`` (``eid``) lie on a curve even inside one surface."""
    faces = m.F.select("fid", "gdim", "gent") if faces is None else settled(faces)
    j = m.FE.select("eid", "fid").join(faces, "fid")
    on = F.when(F.col("gdim") == 2, F.col("gent"))
    e = j.groupBy("eid").agg(F.count_if(F.col("gdim") == 2).alias("k"), F.array_join(F.array_sort(F.collect_set(on)), ",").alias("sig"), F.min(on).alias("one"), F.min(F.when(F.col("gdim") == 3, F.col("gent"))).alias("vol"))
    e = settled(m.E.select("eid").join(e, "eid", "left").fillna({"k": 0, "sig": ""}))  # read for each kind of edge
    inside = e.where("k = 0 and vol is not null").select("eid", F.lit(3).alias("gdim"), F.col("vol").cast("long").alias("gent"))
    tagged = F.lit(False)
    if sharp is not None:
        e, tagged = e.join(sharp.select("eid", F.lit(True).alias("tag")), "eid", "left").fillna({"tag": False}), F.col("tag")
    same = (F.col("k") == 2) & ~F.col("sig").contains(",") & ~tagged
    surface = e.where(F.col("vol").isNotNull() | (F.col("k") > 0)).where("k > 0").where(same).select("eid", F.lit(2).alias("gdim"), F.col("one").cast("long").alias("gent"))
    curve = _ranked(e.where("k > 0").where(~same).union(e.where("k = 0 and vol is null")), "k", "sig").select("eid", F.lit(1).alias("gdim"), "gent")
    return inside.union(surface).union(curve)


def classify_vertices(m: MeshFrame, edges: DataFrame | None = None) -> DataFrame:
    """``vid, gdim, gent``: on a curve between two edges of one, a corner at other curve edges or none, else inside."""
    edges = m.E.select("eid", "gdim", "gent") if edges is None else edges
    ends = m.E.select("eid", F.explode(F.array("v0", "v1")).alias("vid")).join(edges, "eid")
    on = lambda d: F.when(F.col("gdim") == d, F.col("gent"))
    v = ends.groupBy("vid").agg(F.count_if(F.col("gdim") == 1).alias("m"), F.count_distinct(on(1)).alias("c"), F.min(on(1)).alias("curve"), F.count_distinct(on(2)).alias("s"), F.min(on(2)).alias("surface"), F.min(on(3)).alias("volume"))
    v = m.V.select("vid").join(v, "vid", "left").fillna({"m": 0, "c": 0, "s": 0})
    curve, surface, volume = (F.col("m") == 2) & (F.col("c") == 1), (F.col("m") == 0) & (F.col("s") == 1), (F.col("m") == 0) & (F.col("s") == 0) & F.col("volume").isNotNull()
    kind = F.when(curve, 1).when(surface, 2).when(volume, 3).otherwise(0)
    return v.select("vid", kind.alias("gdim"), F.when(curve, F.col("curve")).when(surface, F.col("surface")).when(volume, F.col("volume")).otherwise(F.col("vid")).cast("long").alias("gent"))


def infer_edge_class(m: MeshFrame) -> DataFrame:
    """``eid, gdim, gent`` from the end vertices: of the higher dimension; equal dimensions must agree in id."""
    a = m.V.select(F.col("vid").alias("v0"), F.col("gdim").alias("d0"), F.col("gent").alias("g0"))
    b = m.V.select(F.col("vid").alias("v1"), F.col("gdim").alias("d1"), F.col("gent").alias("g1"))
    d = F.when(F.col("d0") > F.col("d1"), F.col("d0")).when(F.col("d1") > F.col("d0"), F.col("d1")).when(F.col("g0") == F.col("g1"), F.col("d0")).otherwise(4)
    g = F.when(F.col("d0") > F.col("d1"), F.col("g0")).when(F.col("d1") > F.col("d0"), F.col("g1")).when(F.col("g0") == F.col("g1"), F.col("g0")).otherwise(0)
    return m.E.join(a, "v0").join(b, "v1").select("eid", d.alias("gdim"), g.alias("gent"))


def infer_face_class(m: MeshFrame) -> DataFrame:
    """``fid, gdim, gent`` from the edges and vertices: of the highest dimension among them, if that is 2 or more and they
    agree in its id; else unknown (4, 0)."""
    below = m.FE.join(m.E.select("eid", "gdim", "gent"), "eid").select("fid", "gdim", "gent").union(m.FV.join(m.V.select("vid", "gdim", "gent"), "vid").select("fid", "gdim", "gent"))
    return _from_below(m.F.select("fid"), below.where("gdim <= 3"), "fid", 2)


def infer_region_class(m: MeshFrame) -> DataFrame:
    """``rid, gdim, gent`` from inner faces, if they agree; else unknown (4, 0)."""
    below = m.RF.join(m.F.select("fid", "gdim", "gent"), "fid").select("rid", "gdim", "gent")
    return _from_below(m.R.select("rid"), below.where("gdim = 3"), "rid", 3)


def _from_below(entities: DataFrame, below: DataFrame, key: str, least: int) -> DataFrame:
    top = below.groupBy(key).agg(F.max("gdim").alias("d"))
    got = below.join(top, key).where("gdim = d").groupBy(key).agg(F.max("d").alias("d"), F.min("gent").alias("a"), F.max("gent").alias("b"))
    fine = F.coalesce((F.col("d") >= least) & (F.col("a") == F.col("b")) & (F.col("a") > 0), F.lit(False))
    return entities.join(got, key, "left").select(key, F.when(fine, F.col("d")).otherwise(UNKNOWN_DIM).alias("gdim"), F.when(fine, F.col("a")).otherwise(UNKNOWN_ID).cast("long").alias("gent"))


#: Rules on the rings of faces around the vertices of a surface.
RINGS = ("surface_vertex_without_face", "open_ring_at_surface_vertex", "ring_not_oriented_alike")


def _rings(m: MeshFrame) -> DataFrame:
    """``vid, open, turned`` of surface vertices with faces of their surface: at every edge two of these meet, running through
    it both ways (else ``open``, ``turned``). Uses of an edge are counted before they meet its ends, where an edge with
    equal ends counts twice."""
    uses = m.FE.join(m.F.where("gdim = 2").select("fid", F.col("gent").alias("vg")), "fid").groupBy("eid", "vg").agg(F.count("*").alias("k"), F.sum(2 * F.col("dir") - 1).alias("s"))
    end = lambda c, n: F.struct(F.col(c).alias("vid"), F.lit(n).alias("times"))
    ends = m.E.select("eid", F.explode(F.when(F.col("v0") == F.col("v1"), F.array(end("v0", 2))).otherwise(F.array(end("v0", 1), end("v1", 1)))).alias("e")).select("eid", "e.*")
    k = F.col("k") * F.col("times")
    around = uses.join(ends, "eid").groupBy("vid", "vg").agg(F.max(k != 2).alias("open"), F.max((k == 2) & (F.col("s") != 0)).alias("turned"))
    return m.V.where("gdim = 2").select("vid", F.col("gent").alias("vg")).join(around, ["vid", "vg"]).select("vid", "open", "turned")


def check(m: MeshFrame, asked: list[str] | None = None) -> DataFrame:
    """``rule, violations``: one row per rule (of those ``asked``, or all), 0 where it holds."""
    m = m.settled()
    ev = m.E.select("eid", "gdim", "gent", F.explode(F.array("v0", "v1")).alias("vid"))
    vj = ev.join(m.V.select("vid", F.col("gdim").alias("vd"), F.col("gent").alias("vg")), "vid")
    fj = m.FE.join(m.F.select("fid", F.col("gdim").alias("fd"), F.col("gent").alias("fg")), "fid")
    ej = fj.join(m.E.select("eid", "gdim", "gent"), "eid")
    known = (F.col("gdim") != 4) & (F.col("vd") != 4)
    turn = m.RF.groupBy("fid").agg(F.count("*").alias("k"), F.count_distinct("dir").alias("d"))
    sense = m.RF.withColumnRenamed("dir", "rdir").join(m.FE, "fid").groupBy("rid", "eid").agg(F.count("*").alias("k"), F.sum(F.when(F.col("dir") == F.col("rdir"), 1).otherwise(-1)).alias("s"))
    ring = _rings(m)
    if asked is None or set(asked) & set(RINGS):
        ring = settled(ring)  # a row for each vertex, read for three rules
    whole = m.FE.join(m.F.where("gdim = 2").select("fid"), "fid").groupBy("eid").agg(F.count("*").alias("outer"))
    fan = m.FE.join(turn.select("fid", F.col("k").alias("cells")), "fid").groupBy("eid").agg(F.count("*").alias("faces"), F.sum("cells").alias("uses"), F.count_if(F.col("cells") == 1).alias("ends"))
    rules = {
        "surface_vertex_without_face": m.V.where("gdim = 2").join(ring.select("vid").distinct(), "vid", "left_anti"),
        "open_ring_at_surface_vertex": ring.where("open").select("vid").distinct(),
        "ring_not_oriented_alike": ring.where("turned").select("vid").distinct(),
        "edge_without_its_vertex": ev.join(m.V.select("vid"), "vid", "left_anti"),
        # around an edge with two outer faces, cells are a chain between them: half of the uses beside the ends
        "outer_faces_not_joined_by_cells": fan.join(whole, "eid").where("outer = 2 and ends = 2 and uses <> 2 * faces - 2"),
        "cell_with_unknown_face": m.RF.join(m.F.select("fid"), "fid", "left_anti"),
        "vertex_without_edge": m.V.join(ev.select("vid").distinct(), "vid", "left_anti"),
        "curve_vertex_without_two_curve_edges": vj.where("vd = 1").groupBy("vid").agg(F.count_if((F.col("gdim") == 1) & (F.col("gent") == F.col("vg"))).alias("k")).where("k <> 2"),
        "edge_with_equal_ends": m.E.where("v0 = v1"),
        "edge_below_vertex": vj.where(known & (F.col("gdim") < F.col("vd"))),
        "edge_and_vertex_on_different_entities": vj.where(known & (F.col("gdim") == F.col("vd")) & (F.col("gent") != F.col("vg"))),
        "surface_edge_without_two_faces": ej.where("gdim = 2 and fd = 2 and fg = gent").groupBy("eid").agg(F.count("*").alias("k")).where("k <> 2"),
        "face_with_fewer_than_three_edges": m.F.where("n < 3"),
        "face_below_edge": ej.where("fd <> 4 and gdim <> 4 and fd < gdim"),
        "face_and_edge_on_different_entities": ej.where("fd <> 4 and fd = gdim and fg <> gent"),
        "inner_face_without_two_cells": m.F.where("gdim = 3").join(turn, "fid", "left").where("coalesce(k, 0) <> 2"),
        "face_used_alike_by_two_cells": turn.where("k = 2 and d = 1"),
        "face_with_more_than_two_cells": turn.where("k > 2"),
        "cell_with_fewer_than_four_faces": m.R.join(m.RF.groupBy("rid").agg(F.count("*").alias("k")), "rid", "left").where("coalesce(k, 0) < 4"),
        "cell_faces_not_mutually_oriented": sense.where("k <> 2 or s <> 0"),
        "open_loop": m.FE.join(m.E, "eid").select("fid", F.when(F.col("dir") == 1, F.col("v0")).otherwise(F.col("v1")).alias("a"), F.when(F.col("dir") == 1, F.col("v1")).otherwise(F.col("v0")).alias("b")).select("fid", F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("s")), F.struct(F.col("b").alias("v"), F.lit(-1).alias("s")))).alias("p")).groupBy("fid", "p.v").agg(F.sum("p.s").alias("s")).where("s <> 0"),
    }
    out = None
    for rule, bad in rules.items():
        if asked is not None and rule not in asked:
            continue
        row = bad.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
        out = row if out is None else out.union(row)
    return out
