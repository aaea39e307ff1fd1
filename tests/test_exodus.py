"""Exodus files: written, read back and compared; partial reads, partitioned files and the element graph."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.frame import MeshFrame
from meshframe.operators import adjacency, attributes, generate, sets
from meshframe.sources import exodus, netcdf


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def decorated(spark, m, dim):
    m = attributes.define(m, "heat", "DOUBLE", 0)
    m = attributes.define(m, "flow", "VECTOR", dim, 3)
    df, key = m.table(dim)
    m = attributes.set_values(m, m.V.select(F.lit("heat").alias("name"), F.lit(0).alias("dim"), F.col("vid").alias("id"), (F.col("x") * 2).alias("dval")))
    m = attributes.set_values(m, df.select(F.lit("flow").alias("name"), F.lit(dim).alias("dim"), F.col(key).alias("id"), F.array(*[(F.col(key) * k).cast("double") for k in (1, 2, 3)]).alias("vval")))
    m = sets.put(m, "nodeset_5", 0, spark.createDataFrame([(0, 0, 1), (1, 0, 4)], "pos int, dim int, id long"))
    side = m.FV.where("fid <= 3").select("fid").distinct() if dim == 3 else m.E.where("eid <= 3").select("eid")
    return sets.put(m, "sideset_7", dim - 1, side.select(F.monotonically_increasing_id().cast("int").alias("pos"), F.lit(dim - 1).alias("dim"), F.col(side.columns[0]).alias("id")))


def sides(m, dim):
    key = m.FV.groupBy(F.col("fid").alias("id")).agg(F.array_sort(F.collect_set("vid")).alias("key")) if dim == 2 else m.E.select(F.col("eid").alias("id"), F.array("lo", "hi").alias("key"))
    return sorted(tuple(r[0]) for r in m.SM.where(f"set = 'sideset_7' and dim = {dim}").join(key, "id").select("key").collect())


@pytest.mark.parametrize("kind", ["hex", "quad", "mixed", "polygon"])
def test_round_trip(spark, tmp_path, kind):
    if kind == "hex":
        m = generate.structured3d(spark, 3, 2, 2)
    elif kind == "quad":
        m = generate.structured2d(spark, 4, 3)
    elif kind == "polygon":
        v = spark.createDataFrame([(i + 1, float(x), float(y), 0.0, 4, 0) for i, (x, y) in enumerate([(0, 0), (1, 0), (2, 1), (1, 2), (0, 1), (3, 0)])], "vid long, x double, y double, z double, gdim int, gent long")
        m = MeshFrame.from_faces(v, spark.createDataFrame([(1, p, x) for p, x in enumerate([1, 2, 3, 4, 5])] + [(2, p, x) for p, x in enumerate([2, 6, 3])], "fid long, pos int, vid long"))
    else:
        points = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1), (0.5, 0.5, 2), (2, 0, 0), (2, 0, 1)]
        v = spark.createDataFrame([(i + 1, *map(float, p), 4, 0) for i, p in enumerate(points)], "vid long, x double, y double, z double, gdim int, gent long")
        cells = [(1, "HEX", [1, 2, 3, 4, 5, 6, 7, 8]), (2, "PYRAMID", [5, 6, 7, 8, 9]), (3, "PRISM", [2, 10, 3, 6, 11, 7])]
        r = spark.createDataFrame([(i, t, 3, i % 2 + 1) for i, t, _ in cells], "rid long, rtype string, gdim int, gent long")
        m = MeshFrame.from_regions(v, spark.createDataFrame([(i, p, x) for i, _, c in cells for p, x in enumerate(c)], "rid long, pos int, vid long"), r=r)
        assert m.F.count() == 6 + 5 + 5 - 2
    dim = 3 if kind in ("hex", "mixed") else 2
    m = decorated(spark, m, dim)
    done = exodus.write_exodus(m, str(tmp_path), "box").collect()
    back = exodus.read_exodus(spark, done[0].path)
    assert rows(back.V, "x", "y", "z") == rows(m.V, "x", "y", "z")
    n = F.col("rid") if dim == 3 else F.col("fid")
    inc, was, df, df0 = (back.RV, m.RV, back.R, m.R) if dim == 3 else (back.FV, m.FV, back.F, m.F)
    new = {r.id: r.gid for r in back.G.where(f"dim = {dim}").collect()}
    assert sorted((new[r[0]], r[1], r[2]) for r in inc.select(n, "pos", "vid").collect()) == rows(was, n, "pos", "vid")
    assert sorted((new[r[0]], r[1]) for r in df.select(n, "gent").collect()) == sorted((r[0], max(1, r[1])) for r in df0.select(n, "gent").collect())
    assert back.F.count() == m.F.count() and back.E.count() == m.E.count()
    assert rows(back.AV.where("name = 'heat'"), "id", "dval") == rows(m.AV.where("name = 'heat'"), "id", "dval")
    flow = {new[r.id]: r.vval for r in back.AV.where("name = 'flow'").collect()}
    components = 3
    assert flow == {r.id: r.vval[:components] for r in m.AV.where("name = 'flow'").collect()}
    assert rows(back.AD.where("name in ('heat', 'flow')"), "name", "atype", "ncomp") == [("flow", "VECTOR" if dim == 3 else back.AD.where("name = 'flow'").first().atype, 3), ("heat", "DOUBLE", 1)]
    assert rows(back.SM.where("set = 'nodeset_5'"), "id") == [(1,), (4,)]
    assert sides(back, dim - 1) == sides(m, dim - 1) and len(sides(m, dim - 1)) == 3
    assert {r.set for r in back.SD.where("set like 'matset%'").collect()} == {f"matset_{max(1, r.gent)}" for r in df0.select("gent").distinct().collect()}
    graph, centres = exodus.element_graph(spark, done[0].path, coordinates=True)
    assert sorted((new[a], new[b]) for a, b in rows(graph, "src", "dst")) == rows(adjacency.element_graph(m, dim == 3), "src", "dst")
    assert centres.count() == df0.count()


def test_parts_and_partial(spark, tmp_path):
    m = generate.structured3d(spark, 4, 2, 2)
    parts = m.R.select(F.col("rid").alias("id"), (F.col("rid") > 8).cast("int").alias("part"))
    done = exodus.write_exodus(m, str(tmp_path), "cut", parts).orderBy("part").collect()
    assert [(r.part, r.n_elements) for r in done] == [(0, 8), (1, 8)]
    both = exodus.records(spark, [r.path for r in done])
    assert rows(both.where("t = 'R'").groupBy("part").count(), "part", "count") == [(0, 8), (1, 8)]
    assert sorted(r.ref for r in both.where("t = 'R'").collect()) == list(range(1, 17))
    some = exodus.read_exodus(spark, done[0].path, elements=spark.createDataFrame([(2,), (3,)], "id long"))
    assert some.R.count() == 2 and some.V.count() == some.RV.select("vid").distinct().count() < 18
    assert exodus.read_exodus(spark, done[1].path).R.count() == 8


def test_mesh_of_several_files(spark, tmp_path):
    m = generate.structured3d(spark, 4, 2, 2)
    parts = m.R.select((F.col("rid")).alias("id"), (F.col("rid") % 3).cast("int").alias("part"))
    paths = [r.path for r in exodus.write_exodus(m, str(tmp_path), "cut", parts).collect()]
    graph, centres = exodus.element_graph(spark, paths, coordinates=True)
    assert len(paths) == 3 and rows(graph, "src", "dst") == rows(adjacency.element_graph(m, True), "src", "dst")
    assert rows(centres, "id") == rows(m.R, "rid")
    back = exodus.read_parts(spark, paths)
    assert rows(back.RV, "rid", "pos", "vid") == rows(m.RV, "rid", "pos", "vid")
    assert rows(back.V, "vid", "x", "y", "z") == rows(m.V, "vid", "x", "y", "z") and back.F.count() == m.F.count()


def test_box_files_hold_so_many_cells(spark, tmp_path, monkeypatch):
    from meshframe.plans import parted

    spark.range(20).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(parted, "CELLS", 20)
    paths = parted._box_files(spark, str(tmp_path))
    assert [exodus.records(spark, p).where("t = 'R'").count() for p in sorted(paths)] == [20, 20, 10]
    graph = parted.exodus_element_graph(spark, str(tmp_path))
    assert rows(graph, "src", "dst") == rows(adjacency.element_graph(parted.ad.box(spark, str(tmp_path)), True), "src", "dst")


def test_netcdf_records():
    data = netcdf.build({"t": 0, "n": 3, "s": 5}, {"title": "x"}, {"a": (["t", "n"], np.arange(6.0).reshape(2, 3), {"unit": "m"}), "b": (["n"], np.array([1, 2, 3], "i4"), {}), "c": (["t"], np.array([7.0, 8.0]), {}), "w": (["n", "s"], np.array([list(x.ljust(5, b"\0")) for x in (b"ab", b"", b"xyz")], "u1").view("S1"), {})})
    f = netcdf.Reader(data)
    assert f.get("a").tolist() == [[0, 1, 2], [3, 4, 5]] and f.get("b").tolist() == [1, 2, 3] and f.get("c").tolist() == [7, 8]
    assert f.strings("w") == ["ab", "", "xyz"] and f.attributes == {"title": "x"} and f.vars["a"][4] == {"unit": "m"}
    with pytest.raises(ValueError):
        netcdf.Reader(b"\x89HDF\r\n\x1a\n")
