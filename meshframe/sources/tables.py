"""Attributes and sets from plain text, and the X3D writer."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MeshFrame, number
from ..operators import attributes, sets
from .records import read, record, write_lines



def parse_attributes(text: str) -> Iterator[dict]:
    """Blocks ``name NODE|CELL n`` of n (id, value) pairs; n = -1 is one value per entity in order, to the next name."""
    words = text.split()
    at = 1
    for _ in range(int(words[0])):
        name, kind, n = words[at], words[at + 1], int(words[at + 2])
        at += 3
        k = 0
        while (k < n) if n >= 0 else (at < len(words) and words[at][0] in "+-.0123456789"):
            i = int(words[at]) if n >= 0 else k + 1
            at += n >= 0
            yield record("AV", name=name, text=kind, id=i, vals=[float(words[at])])
            at += 1
            k += 1


def import_attributes(m: MeshFrame, path: str) -> MeshFrame:
    spark, solid = m.V.sparkSession, not m.R.isEmpty()
    got = read(spark, path, parse_attributes).withColumn("dim", F.when(F.col("text") == "NODE", 0).otherwise(3 if solid else 2)).persist()
    for name, dim in got.select("name", "dim").distinct().collect():  # one row an attribute
        m = attributes.define(m, name, "DOUBLE", dim)
    return attributes.set_values(m, got.select("name", "dim", "id", F.col("vals")[0].alias("dval")))


def parse_sets(text: str) -> Iterator[dict]:
    """Blocks ``id type n`` of n entity ids."""
    words = text.split()
    at = 1
    for _ in range(int(words[0])):
        name, kind, n = words[at], words[at + 1], int(words[at + 2])
        for pos in range(n):
            yield record("SM", name=f"{kind.lower()}set_{name}", text=kind, pos=pos, id=int(words[at + 3 + pos]))
        at += 3 + n


def import_sets(m: MeshFrame, path: str) -> MeshFrame:
    spark, solid = m.V.sparkSession, not m.R.isEmpty()
    dim = F.when(F.col("text") == "NODE", 0).when(F.col("text") == "SIDE", 2 if solid else 1).otherwise(3 if solid else 2)
    got = read(spark, path, parse_sets).withColumn("dim", dim).persist()
    for name, d in sorted(tuple(r) for r in got.select("name", "dim").distinct().collect()):  # one row a set
        m = sets.put(m, name, d, got.where(F.col("name") == name).select("pos", "dim", "id"))
    return m


def x3d_lines(m: MeshFrame) -> DataFrame:
    """``sect, ord, line`` of a solid mesh: every cell lists faces of its own, outward."""
    spark = m.V.sparkSession
    vn = number(m.V, "k", "vid")
    loops = m.FV.join(vn.select("vid", "k"), "vid").groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k"))), lambda s: s["k"]).alias("l"))
    use = number(m.RF, "u", "rid", "pos")
    other = use.select("fid", F.col("u").alias("o"), F.col("rid").alias("r2"))
    j = use.join(loops, "fid").join(other, "fid").groupBy("u", "rid", "pos", "fid", "dir", "l").agg(F.max(F.when(F.col("r2") != F.col("rid"), F.col("o"))).alias("across"))
    loop = F.when(F.col("dir") == 1, F.col("l")).otherwise(F.reverse("l"))
    faces = j.select(F.lit(3), "u", F.concat_ws(" ", "u", F.size("l").cast("string"), F.concat_ws(" ", F.transform(loop, lambda x: x.cast("string"))), F.lit("1 1"), F.coalesce("across", F.lit(0)).cast("string")))
    cells = use.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "u"))).alias("l"))
    cn = number(m.R, "c", "rid").select("rid", "c")
    body = cells.join(cn, "rid").select(F.lit(5), "c", F.concat_ws(" ", "c", F.size("l").cast("string"), F.concat_ws(" ", F.transform("l", lambda s: s["u"].cast("string")))))
    head = [(0, 0, "header"), (0, 1, f"   nodes {m.V.count()}"), (0, 2, f"   faces {m.RF.count()}"), (0, 3, f"   elements {m.R.count()}"), (0, 4, "end_header"), (0, 5, "nodes"), (2, 0, "end_nodes"), (2, 1, "faces"), (4, 0, "end_faces"), (4, 1, "cells"), (6, 0, "end_cells")]
    nodes = vn.select(F.lit(1), "k", F.concat_ws(" ", "k", "x", "y", "z"))
    return spark.createDataFrame(head, "sect int, ord long, line string").union(nodes).union(faces).union(body)


def write_x3d(m: MeshFrame, path: str, single: bool = False) -> None:
    write_lines(x3d_lines(m), path, single)


