"""Simplex splits, polyhedra, flags, text imports and the X3D round trip."""

from pyspark.sql import functions as F

from meshframe.frame import MeshFrame
from meshframe.operators import attributes, classify, generate, geometry, sets, simplex
from meshframe.sources import foreign, tables


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


def tets(spark):
    v = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4, 0), (2, 1.0, 0.0, 0.0, 4, 0), (3, 0.0, 1.0, 0.0, 4, 0), (4, 0.0, 0.0, 1.0, 4, 0), (5, 0.0, 0.0, -1.0, 4, 0)], "vid long, x double, y double, z double, gdim int, gent long")
    rv = spark.createDataFrame([(r, p, x) for r, c in ((1, (1, 2, 3, 4)), (2, (1, 3, 2, 5))) for p, x in enumerate(c)], "rid long, pos int, vid long")
    return v, rv


def volume(spark, v, rv):
    return [r.volume for r in geometry.tet_volumes(MeshFrame.empty(spark).with_tables(V=v, RV=rv)).collect()]


def test_simplex_splits(spark):
    v, rv = tets(spark)
    whole = sum(volume(spark, v, rv))
    for made, n in ((simplex.split_simplex_edges(v, rv, "rid", spark.createDataFrame([(1, 2)], "a long, b long")), 4), (simplex.split_simplex_faces(v, rv, spark.createDataFrame([(1, 2, 3)], "a long, b long, c long")), 6)):
        parts = volume(spark, *made)
        assert len(parts) == n and min(parts) > 0 and abs(sum(parts) - whole) < 1e-12
        m = MeshFrame.from_regions(*made, "TET")
        bad = {r.rule: r.violations for r in classify.check(m).collect()}
        assert bad["cell_faces_not_mutually_oriented"] == 0 and bad["face_used_alike_by_two_cells"] == 0


def test_split_region(spark):
    m = generate.structured3d(spark, 2, 1, 1)
    inner = m.RF.groupBy("fid").count().where("count = 2").first().fid
    loop = m.FE.where(F.col("fid") == inner).select("eid")
    one = m.RF.where(F.col("fid") != inner).withColumn("rid", F.lit(1).cast("long"))
    cut = simplex.split_region(one, m.FE, 1, loop, inner, 2)
    assert rows(cut.groupBy("rid").count()) == [(1, 6), (2, 6)]


def test_flags(spark):
    m = generate.structured2d(spark, 1, 1)
    gone = spark.createDataFrame([(2,)], "id long")
    f = simplex.flag_deleted(m.V, "vid", gone)
    assert [r.vid for r in f.where("deleted").collect()] == [2]
    assert simplex.restore(f, "vid", gone).where("deleted").count() == 0


def test_text_imports(spark, tmp_path):
    m = generate.structured2d(spark, 2, 1)
    (tmp_path / "a").write_text("2\ntemp NODE 2\n1 5.5\n4 6.5\nload CELL -1\n1.0\n2.0\n")
    (tmp_path / "s").write_text("1\n7 NODE 3\n1 2 6\n")
    m = tables.import_sets(tables.import_attributes(m, f"file://{tmp_path}/a"), f"file://{tmp_path}/s")
    assert rows(attributes.get_values(m, "temp", 0).where("status = 1"), "id", "dval") == [(1, 5.5), (4, 6.5)]
    assert rows(attributes.get_values(m, "load", 2), "id", "dval") == [(1, 1.0), (2, 2.0)]
    assert rows(sets.members(m, "nodeset_7"), "pos", "id") == [(0, 1), (1, 2), (2, 6)]


def test_x3d_round_trip(spark, tmp_path):
    m = generate.structured3d(spark, 2, 2, 1)
    tables.write_x3d(m, f"file://{tmp_path}/x")
    back = foreign.read_x3d(spark, f"file://{tmp_path}/x")
    assert rows(back.counts()) == rows(m.counts())
    assert {r.rule: r.violations for r in classify.check(back).collect()}["cell_faces_not_mutually_oriented"] == 0
