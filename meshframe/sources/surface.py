"""OFF, STL and OpenDX writers, and their lines as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MeshFrame, number
from ..functions import vectors as vx
from .records import write_lines


def off_lines(m: MeshFrame, first_id: int = 0) -> DataFrame:
    """``sect, ord, line``; vertices count from ``first_id`` (0 as the format says)."""
    spark = m.V.sparkSession
    head = spark.createDataFrame([(0, 0, "OFF"), (0, 1, f"{m.V.count()} {m.F.count()} 0")], "sect int, ord long, line string")
    vn = number(m.V, "k", "vid", start=first_id)
    v = vn.select(F.lit(1), "k", F.concat_ws(" ", "x", "y", "z"))
    f = m.FV.join(vn.select("vid", "k"), "vid").groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("l"))
    return head.union(v).union(f.select(F.lit(2), "fid", F.concat_ws(" ", F.size("l").cast("string"), F.concat_ws(" ", F.transform("l", lambda s: s["k"].cast("string"))))))


def stl_lines(m: MeshFrame, name: str = "mesh") -> DataFrame:
    """``sect, ord, line``: one multi-line record per facet; refuses faces that aren't triangles."""
    spark = m.V.sparkSession
    tri = m.FV.join(m.V.select("vid", vx.vec("x", "y", "z").alias("p")), "vid").groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("p"))
    tri = tri.withColumn("p", F.when(F.size("p") == 3, F.col("p")).otherwise(F.raise_error(F.lit("STL has triangles only")).cast("array<array<double>>")))
    at = lambda i: F.col("p")[i]
    tri = tri.withColumn("n", vx.normalize(vx.cross(vx.diff(at(1), at(0)), vx.diff(at(2), at(0)))))
    xyz = lambda c: F.concat_ws(" ", c[0].cast("string"), c[1].cast("string"), c[2].cast("string"))
    corners = [F.concat(F.lit("   vertex "), xyz(at(i))) for i in range(3)]
    body = F.concat_ws("\n", F.concat(F.lit(" facet normal "), xyz(F.col("n"))), F.lit("  outer loop"), *corners, F.lit("  endloop"), F.lit(" endfacet"))
    head = spark.createDataFrame([(0, 0, f"solid {name}"), (2, 0, f"endsolid {name}")], "sect int, ord long, line string")
    return head.union(tri.select(F.lit(1), "fid", body))


def dx_lines(m: MeshFrame) -> DataFrame:
    """``sect, ord, line`` of triangles or quads, tetrahedra or hexahedra, in text form (each format's own corner order is
    the tensor one: the last two corners of a loop of four change places)."""
    spark, solid = m.V.sparkSession, not m.R.isEmpty()
    inc, key, elements = (m.RV, "rid", m.R) if solid else (m.FV, "fid", m.F)
    vn = number(m.V, "k", "vid", start=0)
    loops = inc.join(vn.select("vid", "k"), "vid").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k"))), lambda s: s["k"]).alias("l"))
    sizes = sorted(r[0] for r in loops.select(F.size("l")).distinct().collect())  # a few kinds of elements
    kinds = {(False, 3): "triangles", (False, 4): "quads", (True, 4): "tetrahedra", (True, 8): "cubes"}
    if len(sizes) != 1 or (solid, sizes[0]) not in kinds:
        raise ValueError("OpenDX files here hold triangles, quads, tetrahedra or hexahedra, one kind each")
    n = sizes[0]
    place = {3: [0, 1, 2], 8: [0, 1, 3, 2, 4, 5, 7, 6]}.get(n, [0, 1, 2, 3] if solid else [0, 1, 3, 2])
    nv, ne = m.V.count(), elements.count()
    head = [
        (0, 0, f"object 1 class array type float rank 1 shape 3 items {nv} data follows"),
        (2, 0, 'attribute "dep" string "positions"'),
        (2, 1, f"object 2 class array type int rank 1 shape {n} items {ne} data follows"),
        (4, 0, f'attribute "element type" string "{kinds[solid, n]}"'),
        (4, 1, 'attribute "ref" string "positions"'),
        (4, 2, 'object "mesh" class field'),
        (4, 3, 'component "positions" value 1'),
        (4, 4, 'component "connections" value 2'),
        (4, 5, "end"),
    ]
    v = vn.select(F.lit(1), "k", F.concat_ws(" ", "x", "y", "z"))
    cells = loops.select(F.lit(3), key, F.concat_ws(" ", *[F.col("l")[p].cast("string") for p in place]))
    return spark.createDataFrame(head, "sect int, ord long, line string").union(v).union(cells)


def write_dx(m: MeshFrame, path: str, single: bool = False) -> None:
    write_lines(dx_lines(m), path, single)


def write_off(m: MeshFrame, path: str, first_id: int = 0, single: bool = False) -> None:
    write_lines(off_lines(m, first_id), path, single)


def write_stl(m: MeshFrame, path: str, name: str = "mesh", single: bool = False) -> None:
    write_lines(stl_lines(m, name), path, single)
