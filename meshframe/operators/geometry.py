"""Measures of edges, faces and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, half_edges
from ..functions import vectors as vx


def _points(m: MeshFrame, key: str, out: str) -> DataFrame:
    return m.V.select(F.col("vid").alias(key), vx.vec("x", "y", "z").alias(out))


def edge_vectors(m: MeshFrame) -> DataFrame:
    """``eid, dx, dy, dz, len, lensqr`` from the first to the second vertex."""
    j = m.E.join(_points(m, "v0", "p0"), "v0").join(_points(m, "v1", "p1"), "v1").select("eid", vx.diff(F.col("p1"), F.col("p0")).alias("d"))
    return j.select("eid", F.col("d")[0].alias("dx"), F.col("d")[1].alias("dy"), F.col("d")[2].alias("dz"), vx.length(F.col("d")).alias("len"), vx.length_squared(F.col("d")).alias("lensqr"))


def edge_cosines(m: MeshFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``e1, e2, vid, cosine`` between edges that share a vertex (all such pairs e1 < e2, or those given)."""
    ends = m.E.select("eid", F.explode(F.array(F.struct(F.col("v0").alias("vid"), F.col("v1").alias("far")), F.struct(F.col("v1").alias("vid"), F.col("v0").alias("far")))).alias("p")).select("eid", "p.*")
    a = ends.select(F.col("eid").alias("e1"), "vid", F.col("far").alias("f1"))
    b = ends.select(F.col("eid").alias("e2"), "vid", F.col("far").alias("f2"))
    j = a.join(b, "vid").where("e1 < e2")
    if pairs is not None:
        j = j.join(pairs, ["e1", "e2"], "left_semi")
    j = j.join(_points(m, "vid", "p"), "vid").join(_points(m, "f1", "q1"), "f1").join(_points(m, "f2", "q2"), "f2")
    u, w = vx.normalize(vx.diff(F.col("q1"), F.col("p"))), vx.normalize(vx.diff(F.col("q2"), F.col("p")))
    return j.select("e1", "e2", "vid", u.alias("u"), w.alias("w")).select("e1", "e2", "vid", vx.dot(F.col("u"), F.col("w")).alias("cosine"))


def dihedral_cosines(m: MeshFrame) -> DataFrame:
    """``eid, f1, f2, cosine`` for each edge and pair of its faces (f1 < f2); coplanar neighbours give -1.

    A face's normal is the product of the edge and the vector to its next vertex (triangles) or vertex mean."""
    n = Window.partitionBy("fid")
    fv = m.FV.join(m.V.select("vid", "x", "y", "z"), "vid")
    loops = fv.select("fid", "pos", vx.vec("x", "y", "z").alias("p"), F.count("*").over(n).alias("n"), vx.vec(F.avg("x").over(n), F.avg("y").over(n), F.avg("z").over(n)).alias("mean"))
    third = loops.select("fid", F.pmod(F.col("pos") - 2, F.col("n")).cast("int").alias("pos"), F.when(F.col("n") == 3, F.col("p")).otherwise(F.col("mean")).alias("third"))
    sides = m.FE.join(third, ["fid", "pos"]).select("eid", "fid", "third")
    a = sides.select("eid", F.col("fid").alias("f1"), F.col("third").alias("t1"))
    b = sides.select("eid", F.col("fid").alias("f2"), F.col("third").alias("t2"))
    j = a.join(b, "eid").where("f1 < f2").join(m.E.select("eid", "v0", "v1"), "eid").join(_points(m, "v0", "p0"), "v0").join(_points(m, "v1", "p1"), "v1")
    e = vx.diff(F.col("p1"), F.col("p0"))
    n1 = vx.cross(e, vx.diff(F.col("t1"), F.col("p0")))
    n2 = vx.cross(vx.negate(e), vx.diff(F.col("t2"), F.col("p1")))
    made = j.select("eid", "f1", "f2", n1.alias("n1"), n2.alias("n2")).select("eid", "f1", "f2", vx.normalize(F.col("n1")).alias("n1"), vx.negate(vx.normalize(F.col("n2"))).alias("n2"))
    return made.select("eid", "f1", "f2", vx.dot(F.col("n1"), F.col("n2")).alias("cosine"))


def face_conditions(m: MeshFrame) -> DataFrame:
    """``fid, pos, cond`` of each corner: (a^2 + b^2) / (4 A) of its two sides; infinite where the area is 0."""
    w = Window.partitionBy("fid").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fv = m.FV.join(m.V.select("vid", vx.vec("x", "y", "z").alias("p")), "vid")
    c = fv.select("fid", "pos", "p", F.coalesce(F.lead("p").over(w), F.first("p").over(whole)).alias("q"), F.coalesce(F.lag("p").over(w), F.last("p").over(whole)).alias("r"))
    least = F.lit(1e-28)
    sq = lambda a, b: F.greatest(vx.length_squared(vx.diff(F.col(a), F.col(b))), least)
    s = c.select("fid", "pos", sq("q", "p").alias("l10"), sq("r", "p").alias("l20"), sq("r", "q").alias("l21"))
    area = 0.25 * F.sqrt(F.greatest(4 * F.col("l10") * F.col("l20") - F.pow(F.col("l10") + F.col("l20") - F.col("l21"), 2), F.lit(0.0)))
    return s.withColumn("a", area).select("fid", "pos", F.when(F.col("a") > 0, (F.col("l10") + F.col("l20")) / (4 * F.col("a"))).otherwise(F.lit(float("inf"))).alias("cond"))


def face_coordinates(m: MeshFrame) -> DataFrame:
    """``fid, xyz``: the loop's points in order."""
    j = m.FV.join(m.V, "vid")
    return j.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda s: F.array(s["x"], s["y"], s["z"])).alias("xyz"))


def region_coordinates(m: MeshFrame) -> DataFrame:
    j = m.RV.join(m.V, "vid")
    return j.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda s: F.array(s["x"], s["y"], s["z"])).alias("xyz"))


def centroids(m: MeshFrame, solid: bool = False) -> DataFrame:
    """``id, x, y, z``: means of the elements' vertices."""
    inc, key = (m.RV, "rid") if solid else (m.FV, "fid")
    return inc.join(m.V.select("vid", "x", "y", "z"), "vid").groupBy(F.col(key).alias("id")).agg(*[F.avg(c).alias(c) for c in "xyz"])


def tet_volumes(m: MeshFrame) -> DataFrame:
    """``rid, volume`` (signed) of cells with four vertices."""
    t = region_coordinates(m).where(F.size("xyz") == 4)
    at = lambda i: F.col("xyz")[i]
    return t.select("rid", (vx.dot(vx.cross(vx.diff(at(1), at(0)), vx.diff(at(2), at(0))), vx.diff(at(3), at(0))) / 6).alias("volume"))


def region_volumes(m: MeshFrame) -> DataFrame:
    """``rid, volume, star_shaped``: sums of tetrahedra from the cell's centre over the triangles between each side
    of a face and the face's centre; star-shaped where all of them are positive."""
    cc = centroids(m, solid=True).select(F.col("id").alias("rid"), vx.vec("x", "y", "z").alias("c"))
    fc = centroids(m).select(F.col("id").alias("fid"), vx.vec("x", "y", "z").alias("fc"))
    sides = half_edges(m.FV).join(_points(m, "v0", "a"), "v0").join(_points(m, "v1", "b"), "v1").join(fc, "fid")
    t = m.RF.join(sides, "fid").join(cc, "rid")
    sign = F.when(F.col("dir") == 1, 1.0).otherwise(-1.0)
    v = sign * vx.dot(vx.cross(vx.diff(F.col("a"), F.col("c")), vx.diff(F.col("b"), F.col("c"))), vx.diff(F.col("fc"), F.col("c"))) / 6
    return t.select("rid", v.alias("v")).groupBy("rid").agg(F.sum("v").alias("volume"), (F.min("v") > 0).alias("star_shaped"))
