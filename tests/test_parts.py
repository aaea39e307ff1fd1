"""Distribution, tools, formats and small operators on literal meshes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe import tools
from meshframe.frame import MeshFrame
from meshframe.functions import lists
from meshframe.operators import classify, distribute, generate, graph, modify, sets
from meshframe.sources import formats, surface


def rows(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


def test_lists_and_dx(spark):
    m = MeshFrame.from_lists(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (2, 0, 0)], faces=[[1, 2, 3, 4], [2, 5, 3]])
    assert rows(m.counts()) == [(0, 5), (1, 6), (2, 2), (3, 0)]
    solid = MeshFrame.from_lists(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], regions=[[1, 2, 3, 4]])
    assert rows(solid.R, "rid", "rtype") == [(1, "TET")]
    with pytest.raises(ValueError):
        MeshFrame.from_lists(spark, [])
    text = [r.line for r in surface.dx_lines(solid).orderBy("sect", "ord").collect()]
    assert "0 1 2 3" in text and text[0].endswith("items 4 data follows") and text[-1] == "end"
    with pytest.raises(ValueError):
        surface.dx_lines(m)  # two kinds of elements
    a = spark.createDataFrame([([5, 3, 8],)], "a array<int>")
    assert a.select(lists.search(F.col("a"), lambda x: x < 5)).first()[0] == 3


def test_set_edits(spark):
    a = spark.createDataFrame([(0, 0, 7), (1, 0, 8), (2, 0, 7)], "pos int, dim int, id long")
    assert rows(sets.remove_at(a, 1), "pos", "id") == [(0, 7), (1, 7)]
    assert rows(sets.replace(a, (0, 7), (0, 9)), "pos", "id") == [(0, 9), (1, 8), (2, 7)]
    assert rows(sets.replace(a, (1, 7), (0, 9)), "pos", "id") == rows(a, "pos", "id")
    assert rows(sets.insert(a, spark.createDataFrame([(0, 1), (0, 2)], "dim int, id long"), 1), "pos", "id") == [(0, 7), (1, 1), (2, 2), (3, 8), (4, 7)]


def test_distribute(spark):
    m = generate.structured3d(spark, 4, 1, 1)
    parts = m.R.select(F.col("rid").alias("id"), F.when(F.col("rid") <= 2, 0).otherwise(1).alias("part"))
    p = distribute.distribute(m, parts)
    one = p.part(0)
    assert rows(one.R, "rid") == [(1,), (2,), (3,)] and one.RF.count() == 18 and one.V.count() == 16
    assert rows(p.tables["R"], "part", "rid", "ptype") == [(0, 1, 0), (0, 2, 1), (0, 3, 3), (1, 2, 3), (1, 3, 1), (1, 4, 0)]
    middle = p.tables["F"].join(m.RF.groupBy("fid").agg(F.collect_set("rid").alias("rs")).where(F.array_contains("rs", 2) & F.array_contains("rs", 3)), "fid")
    assert rows(middle, "part", "master_part", "ptype") == [(0, 0, 1), (1, 0, 3)]
    s = p.submesh()
    assert rows(s.tables["R"], "part", "rid") == [(0, 2), (1, 3)]
    both = p.concat(s)
    assert both.tables["R"].count() == 6 and both.tables["V"].count() == p.tables["V"].count()


def test_weave_by_gids(spark):
    v = spark.createDataFrame([(0, i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)], 1)] + [(1, i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(1, 0), (2, 0), (2, 1), (1, 1)], 1)], "part int, vid long, x double, y double, z double")
    loops = spark.createDataFrame([(p, 1, k, k + 1) for p in (0, 1) for k in range(4)], "part int, fid long, pos int, vid long")
    gids = spark.createDataFrame([(0, 1, 10), (0, 2, 20), (0, 3, 30), (0, 4, 40), (1, 1, 20), (1, 2, 50), (1, 3, 60), (1, 4, 30)], "part int, vid long, gid long")
    a, b = distribute.weave(v, loops), distribute.weave(v, loops, gids=gids)
    for p in (a, b):
        assert rows(distribute.labelled_counts(p).where("dim = 2")) == [(2, 0, 1, 1), (2, 0, 3, 1), (2, 1, 1, 1), (2, 1, 3, 1)]
        assert p.copies(0).select("gid").distinct().count() == 6 and p.copies(1).select("gid").distinct().count() == 7


def test_tools(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/grid.gmv"
    assert tools.main(["generate", path, "3", "2"]) == 0
    assert tools.main(["convert", path, f"file://{tmp_path}/grid", "--classify"]) == 0
    m = formats.read(spark, f"file://{tmp_path}/grid")
    assert rows(m.counts()) == [(0, 12), (1, 17), (2, 6), (3, 0)] and m.V.where("gdim = 1").count() == 10
    assert tools.main(["check", f"file://{tmp_path}/grid"]) == 0
    assert tools.main(["partition", path, f"file://{tmp_path}/parts.gmv", "--parts", "2", "--method", "strips"]) == 0
    back = formats.read(spark, f"file://{tmp_path}/parts.gmv")
    assert rows(back.AV.groupBy(F.coalesce("ival", F.col("dval").cast("int"))).count()) == [(0, 3), (1, 3)]
    assert tools.main(["convert", path, f"{tmp_path}/two.exo", "--parts", "2"]) == 0
    assert len(list(tmp_path.glob("two.2.*"))) == 2 and formats.format_of(f"{tmp_path}/two.2.1") == "exodus"
    with pytest.raises(ValueError):
        formats.read(spark, "x.stl")


def test_profile_and_medians(spark):
    m = generate.structured2d(spark, 12, 2)
    g = m.E.select(F.col("v0").alias("src"), F.col("v1").alias("dst"))
    g = g.union(g.select("dst", "src"))
    new = {r.node: r.new_id for r in graph.renumber_profile(m.V.select(F.col("vid").alias("node")), g).collect()}
    assert sorted(new.values()) == list(range(1, 40))
    assert max(abs(new[r.src] - new[r.dst]) for r in g.collect()) <= 6 < max(abs(r.src - r.dst) for r in g.collect())
    r = np.random.default_rng(4)
    values = [(p, float(v)) for p, vs in ((0, r.normal(size=101)), (1, r.integers(0, 3, 50)), (2, [5.0]), (3, 1e-300 * r.random(20)), (4, [0.0, 1e9, 1e-9, 2e-9])) for v in vs]
    df = spark.createDataFrame(values, "part int, v double")
    got = {x.part: x.cut for x in graph._medians(df, 8, 6).collect()}
    assert got == pytest.approx({p: float(np.median([v for q, v in values if q == p])) for p in range(5)}, rel=1e-12)


def test_directions_and_merges(spark):
    m = generate.structured3d(spark, 2, 1, 1)
    uses = m.RF.where("rid = 1 and pos = 0").select("rid", "fid", F.lit(0).alias("dir"))
    assert modify.set_face_directions(m, uses).RF.where("dir = 0").count() == m.RF.where("dir = 0").count() + 1
    e = m.V.where("vid < 3").select(F.col("vid").alias("old"), (F.col("vid") + 1).alias("new"))
    assert modify.mergeable(m, 0, e).count() == 1  # vertex 1 is a corner of its own
    joined = modify.join_regions(m, m.F.select("fid"))
    assert rows(joined.groupBy("rid").count()) == [(1, 10)]
    broken = m.with_tables(RF=m.RF.union(spark.createDataFrame([(1, 9, 999, 1)], m.RF.schema)))
    bad = {r.rule: r.violations for r in classify.check(broken).where("violations > 0").collect()}
    assert bad["cell_with_unknown_face"] == 1
