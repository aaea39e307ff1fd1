"""Attributes and sets that follow distribution, and meshes in parts woven together again."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meshframe.frame import MeshFrame
from meshframe.operators import distribute as dis
from meshframe.operators import generate, parallel
from meshframe.schema import SCHEMAS


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


@pytest.fixture(scope="module")
def box(spark):
    m = generate.structured3d(spark, 2, 2, 2).settled("V", "E", "F", "FE", "FV", "R", "RF", "RV")
    cell = m.R.select(F.lit("heat").alias("name"), F.lit(3).alias("dim"), F.col("rid").alias("id"), F.lit(None).cast("int").alias("ival"), (F.col("rid") * 1.5).alias("dval"), F.lit(None).cast("array<double>").alias("vval"), F.lit(None).cast("struct<dim:int,id:bigint>").alias("ref"))
    point = m.V.select(F.lit("speed").alias("name"), F.lit(0).alias("dim"), F.col("vid").alias("id"), F.lit(None).cast("int").alias("ival"), F.lit(None).cast("double").alias("dval"), F.array("x", "y").alias("vval"), F.lit(None).cast("struct<dim:int,id:bigint>").alias("ref"))
    ad = spark.createDataFrame([("heat", "DOUBLE", 1, 3), ("speed", "VECTOR", 2, 0)], SCHEMAS["AD"])
    sm = m.F.where("fid % 3 = 0").select(F.lit("some").alias("set"), (F.col("fid") / 3 - 1).cast("int").alias("pos"), F.lit(2).alias("dim"), F.col("fid").alias("id"))
    sm = sm.union(m.V.where("vid > 20").select(F.lit("tips").alias("set"), (F.lit(27) - F.col("vid")).cast("int"), F.lit(0), "vid"))
    sd = spark.createDataFrame([("some", 2), ("tips", 0)], SCHEMAS["SD"])
    g = m.R.select(F.lit(3).alias("dim"), F.col("rid").alias("id"), (F.col("rid") + 100).alias("gid"))
    return m.with_tables(AV=cell.union(point), AD=ad, SM=sm, SD=sd, G=g)


@pytest.fixture(scope="module")
def parts(spark, box):
    return box.R.select(F.col("rid").alias("id"), ((F.col("rid") - 1) % 4).cast("int").alias("part")).checkpoint()


def test_values_and_sets_reach_every_copy(box, parts):
    p = dis.distribute(box, parts)
    copies = defaultdict(set)
    for r in p.all_copies().collect():
        copies[r.dim, r.id].add(r.part)
    values = rows(p.tables["AV"], "part", "name", "dim", "id")
    assert values == sorted((k, r.name, r.dim, r.id) for r in box.AV.collect() for k in copies[r.dim, r.id])
    assert rows(p.tables["SM"], "part", "set", "pos", "dim", "id") == sorted((k, r.set, r.pos, r.dim, r.id) for r in box.SM.collect() for k in copies[r.dim, r.id])
    assert rows(p.tables["AD"]) == rows(box.AD) and rows(p.tables["SD"]) == rows(box.SD)
    assert rows(p.tables["G"], "part", "id", "gid") == sorted((k, r.id, r.gid) for r in box.G.collect() for k in copies[3, r.id])
    one = p.part(2)
    assert rows(one.AV, "name", "dim", "id") == [v[1:] for v in values if v[0] == 2] and rows(one.AD) == rows(box.AD)
    sub = p.submesh()
    held = {(r.dim, r.part, r.id) for r in sub.all_copies().collect()}
    assert rows(sub.tables["AV"], "part", "name", "dim", "id") == [v for v in values if (v[2], v[0], v[3]) in held]
    both = sub.concat(p)
    assert rows(both.tables["AV"], "part", "name", "dim", "id") == values and rows(both.tables["SM"], "part", "set", "pos", "dim", "id") == rows(p.tables["SM"], "part", "set", "pos", "dim", "id")


def test_boundary_flags(box, parts):
    p = dis.distribute(box, parts)
    part = {r.id: r.part for r in parts.collect()}
    for dim, inc, key in ((0, box.RV, "vid"), (2, box.RF, "fid")):
        reach = defaultdict(set)
        for r in inc.collect():
            reach[r[key]].add(part[r.rid])
        assert all(r.on_bdry == (r.part in reach[r.gid] and len(reach[r.gid]) > 1) for r in p.on_boundary(dim).collect())


def test_two_updates(spark, box, parts):
    p = dis.distribute(box, parts)
    for step in (1, 2):
        # owners change what they own (in the second step some only), ghosts hear of it
        mine = p.tables["AV"].join(p.all_copies().where("part = master_part").select("dim", "part", "id"), ["dim", "part", "id"])
        if step == 2:
            mine = mine.where("id % 2 = 0")
        new = mine.withColumns({"dval": F.col("dval") + 10 * step + F.col("part"), "vval": F.transform("vval", lambda x: x - step)}).select(*p.tables["AV"].columns).checkpoint()
        stale = dis.set_values(p, new)
        changed = new.select("name", "dim", "id")
        p = dis.update_attributes(stale, changed=changed)
        p = dis.PartedMesh(p.tables | {"AV": p.tables["AV"].checkpoint()})
        whole = dis.update_attributes(stale)
        assert rows(p.tables["AV"], "part", "name", "id", "dval", "vval") == rows(whole.tables["AV"], "part", "name", "id", "dval", "vval")
    owner = {(r.dim, r.id): r.master_part for r in p.all_copies().collect()}
    old = {(r.name, r.id): (r.dval, r.vval) for r in box.AV.collect()}
    for r in p.tables["AV"].collect():
        d, v = old[r.name, r.id]
        k, n = owner[r.dim, r.id], 2 if r.id % 2 == 0 else 1
        assert r.dval == (None if d is None else d + (30 + 2 * k if n == 2 else 10 + k)) and r.vval == (None if v is None else [x - (3 if n == 2 else 1) for x in v])
    only = dis.update_attributes(stale, names=["speed"])
    assert rows(only.tables["AV"].where("name = 'heat'"), "part", "id", "dval") == rows(stale.tables["AV"].where("name = 'heat'"), "part", "id", "dval")


def test_gather(box, parts):
    p = dis.distribute(box, parts)
    p = dis.set_values(p, p.tables["AV"].where("name = 'heat'").withColumn("dval", F.col("part") + 1.0))
    got = dis.gather_attribute(p, "heat", 3, "dval", "SUM").tables["AV"].where("name = 'heat'")
    held = defaultdict(list)
    for r in p.copies(3).collect():
        held[r.gid].append(r.part + 1.0)
    assert rows(got, "part", "id", "dval") == sorted((int(k) - 1, i, sum(v)) for i, v in held.items() for k in v)


def test_points_in_chains(spark):
    pts = [(2, 1, 0.0, 0, 0), (0, 5, 0.8e-12, 0, 0), (1, 9, 1.6e-12, 0, 0), (1, 2, 5.0, 5, 5), (0, 1, 5.0, 5, 5.1)]
    df = spark.createDataFrame([(a, b, float(x), float(y), float(z)) for a, b, x, y, z in pts], "part int, id long, x double, y double, z double")
    assert rows(parallel.match_points(df)) == [(0, 1, 0, 1), (0, 5, 0, 5), (1, 2, 1, 2), (1, 9, 0, 5), (2, 1, 0, 5)]
    assert rows(parallel.match_points(df.limit(0))) == []


def keyed(tables, place):
    """Cells, faces and edges by the places of their vertices, so that numberings can be compared."""
    pt = {r.vid: place(r) for r in tables["V"].collect()}
    edge = {r.eid: (pt[r.v0], pt[r.v1]) for r in tables["E"].collect()}
    loop = defaultdict(dict)
    for r in tables["FV"].collect():
        loop[r.fid][r.pos] = pt[r.vid]
    loops = {f: tuple(v[k] for k in sorted(v)) for f, v in loop.items()}
    key = {f: tuple(sorted(v)) for f, v in loops.items()}
    fe = sorted((key[r.fid], r.pos, edge[r.eid], r.dir) for r in tables["FE"].collect())
    cell = defaultdict(set)
    for r in tables["RF"].collect():
        cell[r.rid] |= set(key[r.fid])
    rf = sorted((tuple(sorted(cell[r.rid])), r.pos, key[r.fid], r.dir) for r in tables["RF"].collect())
    return {"edges": sorted(edge.values()), "loops": sorted(loops.values()), "fe": fe, "rf": rf}


@pytest.mark.parametrize("by_gids", [False, True])
def test_solid_in_eight_parts(spark, box, by_gids):
    parts = box.R.select(F.col("rid").alias("id"), (F.col("rid") - 1).cast("int").alias("part")).checkpoint()
    cut = dis.apart(box, parts)
    assert cut["V"].count() == 64 and cut["F"].count() == 48 and cut["E"].count() == 96
    gids = None
    if by_gids:
        ids = box.V.select("x", "y", "z", F.col("vid").alias("gid"))
        gids = cut["V"].join(ids, ["x", "y", "z"]).select("part", "vid", "gid")
    p = dis.weave_meshes(cut, gids=gids)
    place = lambda r: (r.x, r.y, r.z)
    whole = keyed(box.tables, place)
    own = {n: t.where("part = master_part").drop(*dis.HELD) for n, t in p.tables.items() if "master_part" in t.columns}
    own |= {n: p.tables[n].drop("part").distinct() for n in ("FE", "FV", "RF", "RV")}
    assert keyed(own, place) == whole
    # 27 vertices, 54 edges, 36 faces and 8 cells, each owned once; all parts meet in the middle, so each holds all cells
    assert [own[n].count() for n in "VEFR"] == [27, 54, 36, 8]
    assert rows(p.tables["R"].groupBy("part").count()) == [(k, 8) for k in range(8)]
    want = dis.distribute(box, parts)
    assert rows(dis.labelled_counts(p)) == rows(dis.labelled_counts(want))
    if by_gids:
        assert rows(own["V"], "vid", "x", "y", "z") == rows(box.V, "vid", "x", "y", "z")
    # values and sets came along
    at = {r.vid: (r.x, r.y, r.z) for r in own["V"].collect()}
    for r in p.tables["AV"].where("name = 'speed'").collect():
        assert tuple(r.vval) == at[r.id][:2]
    assert p.tables["SM"].where("set = 'some'").select("id").distinct().count() == box.SM.where("set = 'some'").count()
    assert rows(p.tables["SM"].select("set", "pos").distinct()) == rows(box.SM.select("set", "pos"))


def test_faces_that_are_turned(spark):
    """Two cells whose common face and edges run opposite ways in their parts."""
    a = MeshFrame.from_lists(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], regions=[[1, 2, 3, 4]])
    b = MeshFrame.from_lists(spark, [(1, 1, 1), (0, 0, 1), (0, 1, 0), (1, 0, 0)], regions=[[4, 3, 2, 1]])
    tables = {n: a.tables[n].withColumn("part", F.lit(0)).unionByName(b.tables[n].withColumn("part", F.lit(1))) for n in ("V", "E", "F", "FE", "FV", "R", "RF", "RV")}
    p = dis.weave_meshes(tables)
    own = {n: p.tables[n].where("part = master_part") for n in "VEFR"}
    assert [own[n].count() for n in "VEFR"] == [5, 9, 7, 2]
    both = p.tables["RF"].where("part = 0").groupBy("fid").agg(F.count("*").alias("k"), F.sum("dir").alias("d")).where("k = 2")
    assert rows(both, "d") == [(1,)]
    loops, ends = defaultdict(dict), {r.eid: (r.v0, r.v1) for r in p.tables["E"].collect()}
    for r in p.tables["FV"].where("part = 0").collect():
        loops[r.fid][r.pos] = r.vid
    for r in p.tables["FE"].where("part = 0").collect():
        x, y = loops[r.fid][r.pos], loops[r.fid][(r.pos + 1) % 3]
        assert ends[r.eid] == ((x, y) if r.dir else (y, x))


def test_woven_tables_are_joined_by_shuffles(box, parts):
    """No table that grows with the mesh is sent through the driver, however small its files are."""
    for tables in (dis.distribute(box, parts).tables, dis.apart(box, parts)):
        for name in ("R", "RF", "RV", "F", "FE", "FV", "E", "V"):
            assert "BroadcastHashJoin" not in tables[name]._jdf.queryExecution().toString(), name
