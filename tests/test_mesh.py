"""Meshes built from literals: golden values, invariants and round trips."""

import pytest
from pyspark.sql import functions as F

from meshframe.frame import MeshFrame
from meshframe.functions import lists as ls
from meshframe.operators import adjacency as adj
from meshframe.operators import classify, generate, geometry, modify, parallel
from meshframe.sources import foreign, native, surface


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


@pytest.fixture(scope="module")
def quads(spark):
    return generate.structured2d(spark, 3, 2)


@pytest.fixture(scope="module")
def hexes(spark):
    return generate.structured3d(spark, 2, 1, 1)


def test_counts(quads, hexes):
    assert rows(quads.counts()) == [(0, 12), (1, 17), (2, 6), (3, 0)]
    assert rows(hexes.counts()) == [(0, 12), (1, 20), (2, 11), (3, 2)]
    assert rows(hexes.V.groupBy("gdim").count()) == [(0, 8), (1, 4)]


def test_two_cells(hexes):
    assert rows(adj.region_neighbors(hexes), "rid", "nbr") == [(1, 2), (2, 1)]
    assert rows(adj.region_type(hexes)) == [(1, "HEX"), (2, "HEX")]
    shared = adj.face_regions(hexes).groupBy("fid").count().where("count = 2").first().fid
    assert rows(adj.face_regions(hexes).where(F.col("fid") == shared)) == [(shared, 0, 1), (shared, 1, 2)]
    volumes = rows(geometry.region_volumes(hexes))
    assert [round(v, 9) for _, v, _ in volumes] == [0.5, 0.5] and all(s for _, _, s in volumes)
    cosines = {round(r.cosine, 6) for r in geometry.dihedral_cosines(hexes).collect()}
    assert cosines <= {-1.0, 0.0, -0.0, 1.0} and -1.0 in cosines


def test_checks_hold(hexes, quads):
    bad = {r.rule: r.violations for r in classify.check(hexes.with_tables(F=hexes.F.withColumn("gdim", F.lit(4)))).collect()}
    assert not any(bad[k] for k in bad if k.startswith(("cell", "face_used", "face_with", "edge_with", "open")))
    doubled = quads.with_tables(FE=quads.FE.where("pos <> 0"))
    assert {r.rule: r.violations for r in classify.check(doubled).collect()}["open_loop"] > 0


def test_classification(hexes):
    m = hexes.with_tables(R=hexes.R.withColumn("gent", F.col("rid")))
    f = classify.classify_faces(m)
    assert f.where("gdim = 2").count() == 11 and f.select("gent").distinct().count() == 3


def test_native_round_trip(spark, hexes, tmp_path):
    from meshframe.operators import attributes

    m = attributes.define(hexes, "t", "VECTOR", 0, 2)
    m = attributes.set_vectors(m, m.V.select(F.lit("t").alias("name"), F.lit(0).alias("dim"), F.col("vid").alias("id"), F.array("x", "y").alias("vval")))
    native.write_mesh(m, f"file://{tmp_path}/m", "MESH")
    back = native.read_mesh(spark, f"file://{tmp_path}/m")
    assert rows(back.counts()) == rows(m.counts())
    assert rows(back.V) == rows(m.V) and rows(back.FE) == rows(m.FE, *back.FE.columns) and rows(back.RF) == rows(m.RF, *back.RF.columns)
    assert rows(back.AV.select("id", F.array_join(F.col("vval").cast("array<string>"), ","))) == rows(m.AV.select("id", F.array_join(F.col("vval").cast("array<string>"), ",")))


def test_gmv_round_trip(spark, quads, hexes, tmp_path):
    for k, m in enumerate((quads, hexes)):
        foreign.write_gmv(m, f"file://{tmp_path}/g{k}")
        back = foreign.read_gmv(spark, f"file://{tmp_path}/g{k}")
        assert rows(back.counts()) == rows(m.counts())


def test_x3d(spark, tmp_path):
    nodes = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)]
    faces = [(1, 3, 2), (1, 2, 4), (2, 3, 4), (3, 1, 4), (2, 4, 3), (2, 3, 5), (3, 4, 5), (4, 2, 5)]
    cells = [(1, 2, 3, 4), (5, 6, 7, 8)]
    text = ["header", f"   nodes {len(nodes)}", f"   faces {len(faces)}", f"   elements {len(cells)}", "end_header", "nodes"]
    text += [f"{i} {x} {y} {z}" for i, (x, y, z) in enumerate(nodes, 1)] + ["end_nodes", "faces"]
    text += [f"{i} 3 {a} {b} {c} 1 1 0" for i, (a, b, c) in enumerate(faces, 1)] + ["end_faces", "cells"]
    text += [f"{i} 4 " + " ".join(map(str, c)) for i, c in enumerate(cells, 1)] + ["end_cells"]
    (tmp_path / "m.x3d").write_text("\n".join(text))
    m = foreign.read_x3d(spark, f"file://{tmp_path}/m.x3d")
    assert rows(m.counts()) == [(0, 5), (1, 9), (2, 7), (3, 2)]
    assert rows(adj.region_type(m)) == [(1, "TET"), (2, "TET")]
    assert {r.rule: r.violations for r in classify.check(m).collect()}["cell_faces_not_mutually_oriented"] == 0


def test_surface_writers(spark, quads, tmp_path):
    tri = MeshFrame.from_faces(quads.V, generate.split_quads(quads.V, quads.FV))
    surface.write_off(tri, f"file://{tmp_path}/o")
    surface.write_stl(tri, f"file://{tmp_path}/s")
    off = "".join(p.read_text() for p in (tmp_path / "o").glob("part*")).split("\n")
    assert off[:3] == ["OFF", "12 12 0", "0.0 0.0 0.0"] and off[14].startswith("3 ")
    stl = "".join(p.read_text() for p in (tmp_path / "s").glob("part*"))
    assert stl.count("endfacet") == 12 and stl.startswith("solid") and stl.rstrip().endswith("endsolid mesh")
    with pytest.raises(Exception, match="triangles only"):
        surface.stl_lines(quads).collect()


def test_modifications(spark, quads):
    one = quads.F.where("fid = 1").select("fid")
    v, fv = modify.fan_split(quads, one)
    m = MeshFrame.from_faces(v, fv)
    assert rows(m.counts()) == [(0, 13), (1, 21), (2, 9), (3, 0)]
    inner = quads.FE.groupBy("eid").count().where("count = 2").orderBy("eid").limit(1).select("eid")
    j = MeshFrame.from_faces(quads.V, modify.join_faces(quads, inner))
    assert rows(j.counts()) == [(0, 12), (1, 16), (2, 5), (3, 0)]
    cut = modify.split_face(quads.FV, spark.createDataFrame([(1, 1, 6, 100)], "fid long, a long, b long, new long"))
    assert rows(cut.where("fid in (1, 100)").groupBy("fid").count()) == [(1, 3), (100, 3)]
    more = modify.insert_vertex(quads.FV, spark.createDataFrame([(1, 1, 77)], "fid long, at int, new long"))
    assert [r.vid for r in more.where("fid = 1").orderBy("pos").collect()][1] == 77
    gone = modify.delete(quads, 2, spark.createDataFrame([(1,)], "id long"))
    assert gone.FV.where("fid = 1").count() == 0 and gone.F.count() == 5


def test_gather_vectors(spark):
    c = spark.createDataFrame([(1, 0, 0, [1.0, 0.0]), (1, 1, 0, [0.0, 3.0]), (2, 1, 1, [5.0, 5.0])], "gid long, part int, master_part int, val array<double>")
    got = {(r.gid, r.part): r.val for r in parallel.gather_scatter(c, "val", "MAX").collect()}
    assert got == {(1, 0): [0.0, 3.0], (1, 1): [0.0, 3.0], (2, 1): [5.0, 5.0]}
    total = {(r.gid, r.part): r.val for r in parallel.gather_scatter(c, "val", "SUM").collect()}
    assert total[(1, 0)] == [1.0, 3.0]
    with pytest.raises(ValueError):
        parallel.gather_scatter(c.withColumn("val", F.lit(1)), "val", "AVG")


def test_lists(spark):
    df = spark.createDataFrame([([3, 1, 2, 1],)], "a array<int>")
    a = F.col("a")
    got = df.select(ls.locate(a, F.lit(9)), ls.remove(a, F.lit(1)), ls.insert_before(a, F.lit(7), F.lit(2)), ls.rotate(a, F.lit(2)), ls.rotate(a, F.lit(2), True), ls.replace_at(a, 0, F.lit(8)), ls.append_new(a, F.lit(3))).first()
    assert list(got) == [-1, [3, 2, 1], [3, 1, 7, 2, 1], [2, 1, 3, 1], [2, 1, 3, 1], [8, 1, 2, 1], [3, 1, 2, 1]]
