"""Structured grids, conversion of simplex meshes, and renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import MeshFrame, number
from ..schema import UNKNOWN_DIM

#: Cells of a split triangle (0-2 corners, 3-5 side middles in loop order, 6 centre) and of a split
#: tetrahedron (0-3 corners, 4-9 middles of 01 02 03 12 13 23, 10-13 centres of the faces opposite 0-3, 14 centre).
QUADS_OF_TRI = [[0, 3, 6, 5], [3, 1, 4, 6], [5, 6, 4, 2]]
HEXES_OF_TET = [[0, 4, 13, 5, 6, 12, 14, 11], [1, 7, 13, 4, 8, 10, 14, 12], [2, 5, 13, 7, 9, 11, 14, 10], [3, 6, 11, 9, 8, 12, 14, 10]]


def _along(k, n: int, low: float, high: float):
    """Coordinate of grid line ``k``; the last one is exactly the upper bound."""
    return F.when(k == n, F.lit(float(high))).otherwise(F.lit(float(low)) + k * F.lit((high - low) / n))


def grid2d(spark: SparkSession, nx: int, ny: int, low=(0.0, 0.0), high=(1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """``V`` and ``FV`` of a grid of quads: vertices row by row, faces column by column, all classified: corners 0
    (1-4 counter-clockwise from the lower left), sides 1 (bottom, right, top, left), inside 2."""
    k = spark.range((nx + 1) * (ny + 1)).withColumnRenamed("id", "k")
    i, j = F.col("k") % (nx + 1), F.expr(f"k div {nx + 1}")
    ex, ey = (i == 0) | (i == nx), (j == 0) | (j == ny)
    corner = F.when((j == 0) & (i == 0), 1).when((j == 0) & (i == nx), 2).when((j == ny) & (i == nx), 3).otherwise(4)
    side = F.when(j == 0, 1).when(i == nx, 2).when(j == ny, 3).otherwise(4)
    v = k.select(
        (F.col("k") + 1).alias("vid"), _along(i, nx, low[0], high[0]).alias("x"), _along(j, ny, low[1], high[1]).alias("y"), F.lit(0.0).alias("z"),
        F.when(ex & ey, 0).when(ex | ey, 1).otherwise(2).alias("gdim"), F.when(ex & ey, corner).when(ex | ey, side).otherwise(1).cast("long").alias("gent"),
    )
    f = spark.range(nx * ny).select((F.col("id") + 1).alias("fid"), F.expr(f"id div {ny}").alias("i"), (F.col("id") % ny).alias("j"))
    at = lambda di, dj: (F.col("j") + dj) * (nx + 1) + F.col("i") + di + 1
    fv = f.select("fid", F.posexplode(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))).alias("pos", "vid"))
    return v, fv


def structured2d(spark: SparkSession, nx: int, ny: int, low=(0.0, 0.0), high=(1.0, 1.0)) -> MeshFrame:
    return MeshFrame.from_faces(*grid2d(spark, nx, ny, low, high))


def grid3d(spark: SparkSession, nx: int, ny: int, nz: int, low=(0.0, 0.0, 0.0), high=(1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """``V`` and ``RV`` of a box of hexahedra; a vertex's dimension is its number of indices that aren't extreme."""
    n = (nx + 1) * (ny + 1) * (nz + 1)
    k = spark.range(n).withColumnRenamed("id", "q")
    i, j, l = F.col("q") % (nx + 1), F.expr(f"(q div {nx + 1}) % {ny + 1}"), F.expr(f"q div {(nx + 1) * (ny + 1)}")
    inner = sum(((c > 0) & (c < m)).cast("int") for c, m in ((i, nx), (j, ny), (l, nz)))
    place = lambda c, m: F.when(c == 0, 0).when(c == m, 1).otherwise(2)
    v = k.select(
        (F.col("q") + 1).alias("vid"), _along(i, nx, low[0], high[0]).alias("x"), _along(j, ny, low[1], high[1]).alias("y"), _along(l, nz, low[2], high[2]).alias("z"),
        inner.alias("gdim"), (place(i, nx) + 3 * place(j, ny) + 9 * place(l, nz) + 1).cast("long").alias("gent"),
    )
    r = spark.range(nx * ny * nz).select((F.col("id") + 1).alias("rid"), F.expr(f"id div {ny * nz}").alias("i"), F.expr(f"(id div {nz}) % {ny}").alias("j"), (F.col("id") % nz).alias("l"))
    at = lambda di, dj, dl: ((F.col("l") + dl) * (ny + 1) + F.col("j") + dj) * (nx + 1) + F.col("i") + di + 1
    loop = [(0, 0), (1, 0), (1, 1), (0, 1)]
    rv = r.select("rid", F.posexplode(F.array(*(at(a, b, c) for c in (0, 1) for a, b in loop))).alias("pos", "vid"))
    return v, rv


def structured3d(spark: SparkSession, nx: int, ny: int, nz: int, low=(0.0, 0.0, 0.0), high=(1.0, 1.0, 1.0)) -> MeshFrame:
    return MeshFrame.from_regions(*grid3d(spark, nx, ny, nz, low, high), rtype="HEX")


def split_quads(v: DataFrame, fv: DataFrame) -> DataFrame:
    """``FV`` of triangles: each quad cut from its first to its third vertex into 2 * fid - 1 and 2 * fid."""
    q = fv.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("pos", "vid"))).alias("l")).where(F.size("l") == 4)
    at = lambda i: F.col("l")[i]["vid"]
    tri = lambda a, b, c: F.array(at(a), at(b), at(c))
    t = q.select("fid", F.posexplode(F.array(tri(0, 1, 2), tri(0, 2, 3))).alias("k", "t"))
    return t.select((2 * F.col("fid") - 1 + F.col("k")).alias("fid"), F.posexplode("t").alias("pos", "vid"))


def tri_to_quad(m: MeshFrame) -> MeshFrame:
    """Three quads of each triangle. New vertices follow the old: one per edge, then one per face, in id order;
    they take the classification of what they lie on. Refuses other faces."""
    bad = F.when(F.col("n") != 3, F.raise_error(F.lit("only triangles can be split")).cast("int")).otherwise(0)
    faces = m.F.select("fid", "gdim", "gent", bad.alias("ok")).where("ok = 0")
    top = m.V.agg(F.max("vid").alias("top"))
    n_edges = m.E.agg(F.count("*").alias("ne"))
    mid = number(m.E, "k", "eid").crossJoin(F.broadcast(top)).withColumn("mid", F.col("top") + F.col("k"))  # one row
    cen = number(faces, "k", "fid").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(n_edges)).withColumn("cen", F.col("top") + F.col("ne") + F.col("k"))
    p = m.V.select("vid", "x", "y", "z")
    a, b = (p.select(F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]) for i in (0, 1))
    edge_v = mid.join(a, "v0").join(b, "v1").select(F.col("mid").alias("vid"), *[((F.col(f"{c}0") + F.col(f"{c}1")) / 2).alias(c) for c in "xyz"], "gdim", "gent")
    loops = m.FV.join(p, "vid")
    face_v = loops.groupBy("fid").agg(*[(F.sum(c) / 3).alias(c) for c in "xyz"]).join(cen, "fid").select(F.col("cen").alias("vid"), "x", "y", "z", "gdim", "gent")
    corner = m.FV.select("fid", F.col("pos").alias("lp"), "vid")
    sides = m.FE.join(mid.select("eid", "mid"), "eid").select("fid", (F.col("pos") + 3).alias("lp"), F.col("mid").alias("vid"))
    centre = cen.select("fid", F.lit(6).alias("lp"), F.col("cen").alias("vid"))
    spark = m.V.sparkSession
    tpl = F.broadcast(spark.createDataFrame([(q, pos, lp) for q, loop in enumerate(QUADS_OF_TRI) for pos, lp in enumerate(loop)], "q int, pos int, lp int"))  # 12 rows
    fv = corner.union(sides).union(centre).join(tpl, "lp").select((3 * (F.col("fid") - 1) + F.col("q") + 1).alias("fid"), "pos", "vid")
    v = m.V.select("vid", "x", "y", "z", "gdim", "gent").union(edge_v).union(face_v)
    return MeshFrame.from_faces(v, fv)


def tet_to_hex(v: DataFrame, rv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``V`` and ``RV`` of four hexahedra per tetrahedron: new points on edges, faces and cells, in the order of their
    sorted corner ids."""
    corner = lambda i: F.col("c")[i]
    cells = rv.groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("c"))
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    tris = [tuple((i + d) % 4 for d in (1, 2, 3)) for i in range(4)]
    points = [[i] for i in range(4)] + [list(x) for x in pairs] + [list(x) for x in tris] + [[0, 1, 2, 3]]
    local = cells.select("rid", F.posexplode(F.array(*(F.array_sort(F.array(*(corner(i) for i in p))) for p in points))).alias("lp", "key"))
    keys = local.where(F.size("key") > 1).select("key").distinct().withColumns({"n": F.size("key"), "a": F.col("key")[0]})
    top = v.agg(F.max("vid").alias("top"))
    new = number(keys.withColumn("major", F.col("n").cast("long") * (1 << 40) + F.col("a")), "k", "major", "key", block=1 << 24).crossJoin(F.broadcast(top)).select("key", (F.col("top") + F.col("k")).alias("vid"))  # one row
    p = v.select("vid", "x", "y", "z")
    made = new.select("vid", F.explode("key").alias("at")).join(p.withColumnRenamed("vid", "at"), "at").groupBy("vid").agg(*[F.avg(c).alias(c) for c in "xyz"]).select("vid", "x", "y", "z", F.lit(UNKNOWN_DIM).alias("gdim"), F.lit(0).cast("long").alias("gent"))
    placed = local.where(F.size("key") == 1).select("rid", "lp", F.col("key")[0].alias("vid")).union(local.join(new, "key").select("rid", "lp", "vid"))
    tpl = F.broadcast(v.sparkSession.createDataFrame([(h, pos, lp) for h, loop in enumerate(HEXES_OF_TET) for pos, lp in enumerate(loop)], "h int, pos int, lp int"))  # 32 rows
    out = placed.join(tpl, "lp").select((4 * (F.col("rid") - 1) + F.col("h") + 1).alias("rid"), "pos", "vid")
    return v.select("vid", "x", "y", "z", "gdim", "gent").union(made), out


def boundary_only(m: MeshFrame) -> MeshFrame:
    """Without cells and without entities classified on the highest dimension that occurs."""
    spark = m.V.sparkSession
    top = 3 if not m.R.isEmpty() else 2
    e, f = m.E.where(F.col("gdim") < top), m.F.where(F.col("gdim") < top)
    empty = MeshFrame.empty(spark)
    return m.with_tables(V=m.V.where(F.col("gdim") < top), E=e, F=f, FE=m.FE.join(f.select("fid"), "fid", "left_semi"), FV=m.FV.join(f.select("fid"), "fid", "left_semi"), R=empty.R, RF=empty.RF, RV=empty.RV)


def renumber(df: DataFrame, key: str, name: str = "new_id") -> DataFrame:
    """``key, name``: dense ids from 1 in the order of the old."""
    return number(df.select(key), name, key)
