"""Exact partitions, columns by topology, cells cut by loops, numbering of many components, order of set insertions."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meshframe.operators import classify, distribute, generate, graph, partition, sets, simplex


def cut(points, n, axes, weight=None):
    """Plain bisection of (id, coordinates, weight)."""
    out, open_ = {}, [(points, n, 0, 0)]
    while open_:
        pts, k, base, turn = open_.pop()
        if k == 1:
            out |= {p[0]: base for p in pts}
            continue
        low = -(-k // 2)
        pts = sorted(pts, key=lambda p: (p[1][turn % axes], p[0]))
        share, total, at = sum(p[2] for p in pts) * low / k, 0.0, 0
        if weight is None:
            at = len(pts) * low // k
        else:
            while at < len(pts) and total < share:
                total += pts[at][2]
                at += 1
        open_ += [(pts[:at], low, base, turn + 1), (pts[at:], k - low, base + low, turn + 1)]
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_exact_parts(spark, n):
    pts = [(i, (float(i * 7 % 6), float(i * 5 % 7), float(i % 3)), 1.0) for i in range(1, 40)]
    df = spark.createDataFrame([(i, *c) for i, c, _ in pts], "id long, x double, y double, z double")
    got = {r.id: r.part for r in partition.cut_into(df, n, ("x", "y", "z")).collect()}
    assert got == cut(pts, n, 3)
    assert max(Counter(got.values()).values()) - min(Counter(got.values()).values()) <= 2


def test_weighted_parts(spark):
    pts = [(i, (float(i * 7 % 11), float(i * 5 % 13)), float(1 + i % 4)) for i in range(60)]
    df = spark.createDataFrame([(i, *c, w) for i, c, w in pts], "id long, x double, y double, w double")
    got = {r.id: r.part for r in partition.cut_into(df, 5, weight="w").collect()}
    assert got == cut(pts, 5, 2, "w")
    assert partition.cut_into(df.limit(0), 3).count() == 0
    m = generate.structured2d(spark, 6, 6)
    assert sorted(Counter(r.part for r in distribute.partition(m, 5).collect()).values()) == [7, 7, 7, 7, 8]


def test_columns(spark):
    m = generate.structured3d(spark, 3, 2, 4).settled()
    v = m.V.withColumns({"x": F.col("x") + 0.1 * (0.1 + 0.2) * F.col("z"), "y": F.col("y") - 0.07 * F.col("z")})
    got = {r.id: (r.base, r.height) for r in partition.columns(m.with_tables(V=v)).collect()}
    assert Counter(b for b, _ in got.values()) == {b: 4 for b in {b for b, _ in got.values()}} and sorted(h for _, h in got.values()) == sorted(list(range(4)) * 6)
    parts = m.R.select(F.col("rid").alias("id"), (F.col("rid") % 3).cast("int").alias("part"))
    told = {r.id: r.part for r in partition.whole_columns(m.with_tables(V=v), parts).collect()}
    assert told == {i: b % 3 for i, (b, _) in got.items()}


def test_cells_cut_at_once(spark):
    m = generate.structured3d(spark, 2, 1, 2).settled("V", "E", "F", "FE", "FV", "R", "RF", "RV")
    corner = defaultdict(dict)
    for r in m.RV.collect():
        corner[r.rid][r.pos] = r.vid
    eid = {frozenset((r.v0, r.v1)): r.eid for r in m.E.collect()}
    ring = [1, 2, 3, 7, 4, 5]
    rows = [(c, k, eid[frozenset((corner[c][a], corner[c][ring[(k + 1) % 6]]))]) for c in (1, 2, 4) for k, a in enumerate(ring)]
    rows += [(3, k, e) for k, (_, _, e) in enumerate(rows[:3])]  # edges of another cell
    out, log = simplex.split_regions(m, spark.createDataFrame(rows, "rid long, pos int, eid long"))
    told = {r.rid: (r.outcome, r.new_rid) for r in log.collect()}
    assert told == {1: ("cut", 5), 2: ("cut", 6), 4: ("cut", 7), 3: ("edges", None)}
    sizes = {r.rid: r["count"] for r in out.RF.groupBy("rid").count().collect()}
    assert sizes == {1: 4, 2: 4, 3: 6, 4: 4, 5: 4, 6: 4, 7: 4}
    wrong = {r.rule: r.violations for r in classify.check(out).collect() if r.violations}
    assert not {k for k in wrong if k.startswith(("cell", "face_used", "open"))}, wrong
    # every cell is closed and its sides run alike: along each of its edges two sides in opposite directions
    uses = out.RF.select("rid", "fid", F.col("dir").alias("out")).join(out.FE, "fid").groupBy("rid", "eid").agg(F.count("*").alias("k"), F.sum((F.col("out") == F.col("dir")).cast("int")).alias("d"))
    assert uses.where("k <> 2 or d <> 1").isEmpty()
    short = spark.createDataFrame([(1, 0, rows[0][2]), (1, 1, rows[1][2]), (1, 2, rows[2][2])], "rid long, pos int, eid long")
    same, log = simplex.split_regions(m, short)
    assert log.first().outcome == "open" and same.RF.count() == m.RF.count()


def test_numbering_of_all_components(spark):
    e = [(1, 7), (7, 3), (10, 20), (20, 30), (30, 5), (5, 15), (40, 41)]
    nodes = spark.createDataFrame([(i,) for i in (1, 7, 3, 10, 20, 30, 5, 15, 40, 41, 99)], "node long")
    edges = spark.createDataFrame(e + [(b, a) for a, b in e], "src long, dst long")
    got = {r.node: r.new_id for r in graph.renumber_profile(nodes, edges).collect()}
    assert sorted(got.values()) == list(range(1, 12))
    assert {got[i] for i in (10, 20, 30, 5, 15)} == set(range(1, 6)) and {got[i] for i in (1, 7, 3)} == {6, 7, 8} and {got[40], got[41]} == {9, 10} and got[99] == 11
    assert all(abs(got[a] - got[b]) == 1 for a, b in e)
    old = nodes.select("node", F.dense_rank().over(Window.orderBy("node")).alias("id"))
    size = lambda ids: graph.profiles(edges, ids).agg(F.sum("reach")).first()[0]
    assert size(nodes.select("node").join(spark.createDataFrame(list(got.items()), "node long, id long"), "node")) <= size(old)


def test_insertion_keeps_its_order(spark):
    a = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], "pos int, dim int, id long")
    new = spark.createDataFrame([(0, 0, 9), (1, 0, 5)], "pos int, dim int, id long")
    assert sorted((r.pos, r.id) for r in sets.insert(a, new, 1).collect()) == [(0, 1), (1, 9), (2, 5), (3, 2)]
