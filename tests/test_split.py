"""Splits that keep the whole bundle, against tables derived from scratch."""

from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from meshframe.frame import MeshFrame
from meshframe.operators import attributes, generate, geometry, sets, split

ALL = ("V", "E", "F", "FE", "FV", "R", "RF", "RV")


def lists(df, key, *columns):
    got = defaultdict(dict)
    for r in df.collect():
        assert r.pos not in got[r[key]]
        got[r[key]][r.pos] = tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
    for x in got.values():
        assert sorted(x) == list(range(len(x)))
    return {k: [x[i] for i in range(len(x))] for k, x in got.items()}


def sound(m):
    """Loops, edges, faces and cells of a bundle, after checking that its tables agree with each other."""
    m = m.settled(*ALL)
    fv, fe, rf, rv = lists(m.FV, "fid", "vid"), lists(m.FE, "fid", "eid", "dir"), lists(m.RF, "rid", "fid", "dir"), lists(m.RV, "rid", "vid")
    ends = {r.eid: (r.v0, r.v1) for r in m.E.collect()}
    assert all((r.lo, r.hi) == tuple(sorted((r.v0, r.v1))) for r in m.E.collect())
    assert len(ends) == m.E.count() and len({frozenset(x) for x in ends.values()}) == len(ends)
    assert {r.fid: r.n for r in m.F.collect()} == {f: len(x) for f, x in fv.items()} and m.F.count() == len(fv)
    known = {r.vid for r in m.V.collect()}
    assert len(known) == m.V.count() and {x for e in ends.values() for x in e} <= known
    assert set(fe) == set(fv)
    for f, loop in fv.items():
        for i, (eid, d) in enumerate(fe[f]):
            a, b = loop[i], loop[(i + 1) % len(loop)]
            assert ends[eid] == ((a, b) if d == 1 else (b, a)), (f, i)
    assert {r.rid for r in m.R.collect()} == set(rf) == set(rv)
    for r, uses in rf.items():
        assert {v for f, _ in uses for v in fv[f]} == set(rv[r])
        # a closed surface whose faces run alike
        half = Counter((a, b) if d == 1 else (b, a) for f, d in uses for a, b in zip(fv[f], fv[f][1:] + fv[f][:1]))
        assert set(half.values()) == {1} and all((b, a) in half for a, b in half)
    by_face = defaultdict(list)
    for uses in rf.values():
        for f, d in uses:
            by_face[f].append(d)
    assert all(len(d) == 1 or sorted(d) == [0, 1] for d in by_face.values())
    return fv, ends, rf, rv


def derived(m):
    """The same surface derived from its vertices and loops alone: edges by vertices."""
    again = MeshFrame.from_faces(m.V, m.FV)
    pairs = lambda e: sorted((r.lo, r.hi) for r in e.collect())
    used = m.E.join(m.FE.select("eid").distinct(), "eid", "left_semi")
    assert pairs(again.E) == pairs(used)


def box(spark):
    return generate.structured3d(spark, 2, 2, 2).settled(*ALL)


def test_edges_of_a_box(spark):
    m = box(spark)
    ask = m.E.where("eid % 3 = 0").select("eid", (F.col("eid") % 4).cast("int").alias("n"))
    n = {r.eid: r.n for r in ask.collect() if r.n}
    extra = spark.createDataFrame([(99999, 2)], "eid long, n int")
    out, born = split.split_edges(m, ask.union(extra).union(ask))
    fv, ends, rf, rv = sound(out)
    derived(out)
    old_fv, old_ends, old_rf, old_rv = sound(m)
    assert len(ends) == len(old_ends) + sum(n.values()) and not set(n) & set(ends)
    assert {k: [x for x in y if x <= m.V.count()] for k, y in fv.items()} == old_fv and rf == old_rf
    place = {r.vid: (r.x, r.y, r.z) for r in out.V.collect()}
    for eid, k in n.items():
        pieces = sorted((r.k, r.new) for r in born.where(F.col("old") == eid).collect())
        walk = [ends[e] for _, e in pieces]
        assert len(walk) == k + 1 and walk[0][0] == old_ends[eid][0] and walk[-1][1] == old_ends[eid][1] and all(a[1] == b[0] for a, b in zip(walk, walk[1:]))
        a, b = place[walk[0][0]], place[walk[-1][1]]
        for i, (_, v) in enumerate(walk[:-1], 1):
            assert place[v] == pytest.approx([p + i * (q - p) / (k + 1) for p, q in zip(a, b)])
    kinds = {r.rid: r.rtype for r in out.R.collect()}
    assert all((kinds[r] == "POLYHEDRON") == (len(rv[r]) > 8) and (len(rv[r]) > 8 or rv[r] == old_rv[r]) for r in rv)


def test_places_given(spark):
    m = generate.structured2d(spark, 1, 1)
    at = spark.createDataFrame([(1, 1, 0.25, 7.0, 0.0)], "eid long, k int, x double, y double, z double")
    out, _ = split.split_edges(m, spark.createDataFrame([(1, 1)], "eid long, n int"), at)
    assert out.V.where("vid = 5").select("x", "y").first() == (0.25, 7.0)
    sound(out)
    out, _ = split.split_faces(m, spark.createDataFrame([(1,)], "fid long"), at.select(F.col("eid").alias("fid"), "x", "y", "z"))
    assert out.V.where("vid = 5").select("x", "y").first() == (0.25, 7.0)
    sound(out)


def test_nothing_asked(spark):
    m = box(spark)
    none = m.E.where("false").select("eid", F.lit(1).alias("n"))
    for out, born in (split.split_edges(m, none), split.split_faces(m, m.F.where("false")), split.bisect_simplices(m, none)[:2]):
        assert born.isEmpty() and sound(out) == sound(m)
    out, born, log = split.bisect_simplices(m, spark.createDataFrame([(1,), (777,)], "eid long"))
    assert sorted((r.eid, r["round"], r.outcome) for r in log.collect()) == [(1, 0, "no simplices"), (777, 0, "no edge")] and sound(out) == sound(m)


def test_faces_of_a_box(spark):
    m = box(spark)
    some = m.F.where("fid % 2 = 0").select("fid")
    gone = {r.fid for r in some.collect()}
    out, born = split.split_faces(m, some.union(some))
    fv, ends, rf, rv = sound(out)
    derived(out)
    old_fv, old_ends, old_rf, _ = sound(m)
    assert set(fv) & set(old_fv) == set(old_fv) - gone and len(fv) == len(old_fv) + 3 * len(gone) and len(ends) == len(old_ends) + 4 * len(gone)
    of = {r.new: r.old for r in born.collect()}
    for r, uses in rf.items():
        assert list(dict.fromkeys((of.get(f, f), d) for f, d in uses)) == old_rf[r]


def kuhn(spark, nx, ny, nz):
    """Six tetrahedra of each cell of a grid."""
    at = lambda p: (p[2] * (ny + 1) + p[1]) * (nx + 1) + p[0]
    points = [(i, j, k) for k in range(nz + 1) for j in range(ny + 1) for i in range(nx + 1)]
    cells = []
    for i in range(nx):
        for j in range(ny):
            for k in range(nz):
                for order in permutations(range(3)):
                    p, ids = [i, j, k], [at((i, j, k)) + 1]
                    for axis in order:
                        p[axis] += 1
                        ids.append(at(p) + 1)
                    odd = sum(order[a] > order[b] for a in range(3) for b in range(a + 1, 3)) % 2
                    cells.append([ids[1], ids[0], *ids[2:]] if odd else ids)
    return MeshFrame.from_lists(spark, points, regions=cells).settled(*ALL)


@pytest.mark.parametrize("every", [1, 3])
def test_tetrahedra_cut_in_rounds(spark, every):
    m = kuhn(spark, 1 if every == 1 else 2, 1, 1)
    ask = m.E.where(F.col("eid") % every == 0).select("eid")
    out, born, log = split.bisect_simplices(m, ask)
    told = {r.eid: r.outcome for r in log.collect()}
    assert told == {r.eid: "split" for r in ask.collect()} and (every > 1 or log.agg(F.max("round")).first()[0] > 1)
    fv, ends, rf, rv = sound(out)
    assert {len(x) for x in fv.values()} == {3} and {len(x) for x in rf.values()} == {4}
    again = MeshFrame.from_regions(out.V, out.RV, r=out.R)
    afv, aends, arf, _ = sound(again)
    assert {frozenset(x) for x in aends.values()} == {frozenset(x) for x in ends.values()}
    # cells have the faces that their vertices say, at their places and as they say
    face = lambda f, d, by: (frozenset(by[f]), by[f] if d == 1 else by[f][::-1])
    turn = lambda x: min(tuple(x[i:] + x[:i]) for i in range(3))
    for r in rf:
        assert [turn(face(f, d, fv)[1]) for f, d in rf[r]] == [turn(face(f, d, afv)[1]) for f, d in arf[r]]
    size = lambda x: [r.volume for r in geometry.tet_volumes(x).collect()]
    assert min(size(out)) > 0 and sum(size(out)) == pytest.approx(sum(size(m)))
    assert out.V.count() == m.V.count() + ask.count()
    assert len(ends) - len(out.V.collect()) - len(fv) + len(rf) == -1  # a ball


def test_triangles_cut_in_rounds(spark):
    q = generate.structured2d(spark, 3, 2)
    m = MeshFrame.from_faces(q.V, generate.split_quads(q.V, q.FV)).settled(*ALL)
    out, born, log = split.bisect_simplices(m, m.E.select("eid"))
    assert {r.outcome for r in log.collect()} == {"split"}
    fv, ends, _, _ = sound(out)
    derived(out)
    inner = m.FE.count()
    assert len(fv) > m.F.count() + inner // 2 and len(ends) - len(fv) - out.V.count() == -1


def test_values_and_sets_follow(spark):
    q = generate.structured2d(spark, 2, 1)
    m = MeshFrame.from_faces(q.V, generate.split_quads(q.V, q.FV)).settled(*ALL)
    m = attributes.define(m, "w", "INT", 2)
    m = attributes.set_values(m, m.F.select(F.lit("w").alias("name"), F.lit(2).alias("dim"), F.col("fid").alias("id"), F.col("fid").cast("int").alias("ival")))
    m = sets.put(m, "s", 2, spark.createDataFrame([(0, 2, 3), (1, 2, 1), (2, 2, 4)], "pos int, dim int, id long"))
    out, born, _ = split.bisect_simplices(m, m.E.select("eid"))
    assert out.AV.isEmpty() and out.SM.isEmpty()
    full = split.inherit(m, out, born)
    at = {r.id: r.ival for r in full.AV.collect()}
    assert set(at) == {r.fid for r in out.F.collect()} and full.AV.count() == len(at)
    child = {}
    for r in born.where("dim = 2").collect():
        child.setdefault(r.old, {})[r.k] = r.new
    leaves = lambda f: [x for k in sorted(child[f]) for x in leaves(child[f][k])] if f in child else [f]
    for f in range(1, 5):
        assert {at[x] for x in leaves(f)} == {f}
    got = [r.id for r in full.SM.orderBy("pos").collect()]
    assert got == leaves(3) + leaves(1) + leaves(4)
    assert [r.pos for r in full.SM.orderBy("pos").collect()] == list(range(len(got)))
