"""Batches of edits whose requests meet, against making them one after another in plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from meshframe.frame import MeshFrame
from meshframe.operators import batch, classify, generate, modify


def loops_of(fv):
    out = defaultdict(list)
    for r in sorted(fv.select("fid", "pos", "vid").collect()):
        out[r.fid].append(r.vid)
    return dict(out)


def turned(loop):
    k = loop.index(min(loop))
    return tuple(loop[k:] + loop[:k])


def triangles(spark, nx, ny):
    q = generate.structured2d(spark, nx, ny)
    return MeshFrame.from_faces(q.V, generate.split_quads(q.V, q.FV)).settled("V", "E", "F", "FE", "FV")


def uses(loops):
    out = defaultdict(list)
    for f, loop in loops.items():
        for i, a in enumerate(loop):
            b = loop[(i + 1) % len(loop)]
            out[frozenset((a, b))].append((f, a, b, i))
    return out


def test_swaps_that_meet(spark):
    m = triangles(spark, 4, 3)
    want, ends = loops_of(m.FV), {r.eid: (r.v0, r.v1) for r in m.E.collect()}
    fv, log = batch.swap(m, m.E.select("eid").union(spark.range(900, 901)))
    told = sorted((r["round"], r.eid, r.outcome) for r in log.collect())
    assert Counter(e for _, e, _ in told) == Counter([*ends, 900]) and (0, 900, "no edge") in told
    for _, eid, outcome in (t for t in told if t[1] != 900):
        a, b = ends[eid]
        by = uses(want)
        sides = by[frozenset((a, b))]
        if len(sides) != 2:
            assert outcome == "faces"
            continue
        left = next(f for f, x, _, _ in sides if x == a)
        right = next(f for f, x, _, _ in sides if x == b)
        l, r = (next(v for v in want[f] if v not in (a, b)) for f in (left, right))
        if by.get(frozenset((l, r))):
            assert outcome == "diagonal exists"
            continue
        assert outcome == "swapped"
        want[min(left, right)], want[max(left, right)] = [a, r, l], [b, l, r]
    got = loops_of(fv)
    assert {f: turned(x) for f, x in got.items()} == {f: turned(x) for f, x in want.items()}
    assert Counter(o for *_, o in told)["swapped"] > 10
    made = MeshFrame.from_faces(m.V, fv)
    assert made.E.count() == m.E.count() and fv.select("fid", "pos").distinct().count() == fv.count() == 3 * m.F.count()


def test_swap_refusals(spark):
    q = generate.structured2d(spark, 2, 1).settled("E", "FE", "FV")
    fv, log = batch.swap(q, q.E.select("eid"))
    assert {r.outcome for r in log.collect()} == {"faces", "no triangles"} and loops_of(fv) == loops_of(q.FV)
    tet = MeshFrame.from_lists(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [[1, 3, 2], [1, 2, 4], [2, 3, 4], [1, 4, 3]])
    assert {r.outcome for r in batch.swap(tet, tet.E.select("eid"))[1].collect()} == {"diagonal exists"}
    assert {r.outcome for r in batch.swap(tet, tet.E.select("eid"), topology=True)[1].collect()} == {"not on a model face"}
    assert batch.swap(tet, tet.E.select("eid").where("false"))[0].count() == 12


def joined(loops, fe, edges):
    """Faces joined one after another in the order of edges."""
    sides = defaultdict(list)
    for fid, pos, eid, d in fe:
        sides[eid].append((fid, pos, d))
    half = {f: [(f, i) for i in range(len(x))] for f, x in loops.items()}
    home, out = {h: f for f, hs in half.items() for h in hs}, {}
    for e in sorted(edges):
        two = sides[e]
        if len(two) != 2 or {d for *_, d in two} != {0, 1}:
            out[e] = "faces"
            continue
        (fa, pa, _), (fb, pb, _) = two
        a, b = home[fa, pa], home[fb, pb]
        if a == b:
            out[e] = "one face"
            continue
        out[e] = "joined"
        (x, i), (y, j) = ((a, half[a].index((fa, pa))), (b, half[b].index((fb, pb))))
        ring = half[x][i + 1 :] + half[x][:i] + half[y][j + 1 :] + half[y][:j]
        keep = min(a, b)
        del half[a], half[b]
        half[keep] = ring
        for h in ring:
            home[h] = keep
    return {f: [loops[g][i] for g, i in ring] for f, ring in half.items()}, out


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_in_chains_and_rings(spark, seed):
    q = generate.structured2d(spark, 4, 3).settled("V", "E", "F", "FE", "FV")
    ids = [r.eid for r in q.E.collect()]
    some = random.Random(seed).sample(ids, 14)
    out, log = batch.join(q, spark.createDataFrame([(e,) for e in some], "eid long"))
    fe = [(r.fid, r.pos, r.eid, r.dir) for r in q.FE.collect()]
    want, outcome = joined(loops_of(q.FV), fe, some)
    assert {r.eid: r.outcome for r in log.collect()} == outcome
    got = loops_of(out.FV)
    ring = lambda x: min(tuple(x[k:] + x[:k]) for k in range(len(x)))
    assert {f: ring(x) for f, x in got.items()} == {f: ring(x) for f, x in want.items()}
    assert {r.fid: r.n for r in out.F.collect()} == {f: len(x) for f, x in got.items()}
    # edges stand between the vertices of their places, and none that was joined is left
    ends = {r.eid: (r.v0, r.v1) for r in out.E.collect()}
    for r in out.FE.collect():
        a, b = got[r.fid][r.pos], got[r.fid][(r.pos + 1) % len(got[r.fid])]
        assert ends[r.eid] == ((a, b) if r.dir == 1 else (b, a))
    assert set(ends) == set(ids) - {e for e, o in outcome.items() if o == "joined"}


def test_three_quads_in_a_row(spark):
    q = generate.structured2d(spark, 3, 1).settled("E", "FE", "FV", "F")
    inner = q.FE.groupBy("eid").count().where("count = 2").select("eid")
    out, log = batch.join(q, inner)
    assert {r.outcome for r in log.collect()} == {"joined"} and len(loops_of(out.FV)) == 1 and len(set(loops_of(out.FV)[1])) == 8
    assert loops_of(modify.join_faces(q, inner)) == loops_of(out.FV)


def test_chains_need_no_rounds(spark, monkeypatch):
    """Chains close no ring and their loops are short, so neither rounds of links nor doubling pointers over tables are run."""

    def never(*_):
        raise AssertionError("rounds over tables")

    monkeypatch.setattr(batch, "spanning", never)
    monkeypatch.setattr(batch, "ranks", never)
    q = generate.structured2d(spark, 12, 1).settled("V", "E", "F", "FE", "FV")
    inner = q.FE.groupBy("eid").count().where("count = 2").select("eid")
    out, log = batch.join(q, inner)
    fe = [(r.fid, r.pos, r.eid, r.dir) for r in q.FE.collect()]
    want, outcome = joined(loops_of(q.FV), fe, [r.eid for r in inner.collect()])
    assert loops_of(out.FV).keys() == want.keys() and {r.eid: r.outcome for r in log.collect()} == outcome
    assert turned(loops_of(out.FV)[1]) == turned(want[1])


def test_long_and_short_loops(spark):
    """Sides of loops stand where walking the loop meets them, whichever way loops of their length go."""
    lists = {7: 1, 9: 5, 4: 6}
    rows = [(k, (k * 10 + i % 2, i), (k * 10 + (i + 1) % 2, i + 1) if i + 1 < n else None) for k, n in lists.items() for i in range(n)]
    sides = spark.createDataFrame(rows, "keep long, node struct<fid:long,pos:int>, next struct<fid:long,pos:int>")
    want = sorted((k * 10 + i % 2, i, k, n, i) for k, n in lists.items() for i in range(n))
    for short in (0, 5, 100):
        assert sorted(map(tuple, batch._places(sides, short).collect())) == want
    ring = spark.createDataFrame([(1, (1, 0), (1, 1)), (1, (1, 1), (1, 0))], sides.schema)
    with pytest.raises(ValueError, match="ring"):
        batch._places(ring)


def test_join_in_solids(spark):
    m = generate.structured3d(spark, 2, 1, 1).settled()
    outer = m.RF.groupBy("fid").count().where("count = 1").select("fid")
    flat = m.FE.join(outer, "fid").groupBy("eid").count().where("count = 2").select("eid")
    out, log = batch.join(m, flat)
    kinds = Counter(r.outcome for r in log.collect())
    between = batch.join(m, m.E.select("eid"))[1].groupBy("outcome").count().collect()
    assert kinds["joined"] and set(kinds) <= {"joined", "one face", "cells", "faces"} and {r.outcome for r in between} >= {"faces"}
    known = {r.fid for r in out.F.collect()}
    assert {r.fid for r in out.RF.collect()} == known
    for r in out.RF.groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect():
        assert r.p == list(range(len(r.p)))


def test_chains_of_merges(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5), (9, 8), (9, 7), (4, 4)], "old long, new long")
    assert sorted(map(tuple, batch.settled_pairs(pairs).collect())) == [(1, 3), (2, 3), (6, 5), (8, 7), (9, 7)]
    q = generate.structured2d(spark, 3, 1)
    v, fv = modify.merge_vertices(q.V, q.FV, pairs.where("old < 3"))
    assert not {1, 2} & {r.vid for r in fv.collect()} and {1, 2} & {r.vid for r in v.collect()} == set()


def collapsed(loops, classes, ends, told, link):
    """Edges collapsed one after another; loops of triangles and others."""
    at = {}
    find = lambda v: find(at[v]) if v in at else v
    arcs = {frozenset(e) for e in ends.values()}
    for _, eid, outcome in told:
        a, b = map(find, ends[eid])
        if a == b:
            assert outcome == "gone", (eid, outcome)
            continue
        (da, ga), (db, gb) = classes[a], classes[b]
        if da == db and ga != gb:
            assert outcome == "model entities"
            continue
        if link:
            near = lambda v: {find(x) for e in arcs for x in e if any(find(y) == v for y in e)} - {v}  # noqa: B023, E731
            third, apart = set(), False
            for loop in loops.values():
                own = [find(v) for v in loop]
                own = [v for i, v in enumerate(own) if v != own[i - 1]]
                if len(own) >= 3 and a in own and b in own:
                    i, j = own.index(a), own.index(b)
                    if abs(i - j) not in (1, len(own) - 1):
                        apart = True
                    if len(own) == 3:
                        third |= set(own) - {a, b}
            if apart or len(near(a) & near(b)) != len(third):
                assert outcome == "link", (eid, outcome)
                continue
        assert outcome == "collapsed", (eid, outcome)
        old, new = (b, a) if da < db else (a, b)
        at[old] = new
    return {v: find(v) for v in at}


@pytest.mark.parametrize("link", [True, False])
def test_collapses_that_meet(spark, link):
    m = triangles(spark, 3, 3)
    some = m.E.where("eid % 3 < 2" if not link else "eid % 6 = 0")
    every = {r.eid: (r.v0, r.v1) for r in m.E.collect()}
    asked = {r.eid for r in some.collect()}
    classes = {r.vid: (r.gdim, r.gent) for r in m.V.collect()}
    out, merged, deleted, log = batch.collapse(m, some.select("eid"), link=link)
    told = sorted((r["round"], r.eid, r.outcome) for r in log.collect())
    assert Counter(e for _, e, _ in told) == Counter(asked)
    loops = loops_of(m.FV)
    goes = collapsed(loops, classes, every, told, link)
    assert goes == {r.old: r.new for r in merged.where("dim = 0").collect()}
    want = {}
    for f, loop in loops.items():
        own = [goes.get(v, v) for v in loop]
        own = [v for i, v in enumerate(own) if v != own[i - 1]]
        if len(own) >= 3:
            want[f] = own
    got = loops_of(out.FV)
    assert {f: turned(x) for f, x in got.items()} == {f: turned(x) for f, x in want.items()}
    assert {r.id for r in deleted.where("dim = 2").collect()} == set(loops) - set(want)
    pairs = {r.eid: frozenset((r.v0, r.v1)) for r in out.E.collect()}
    assert set(pairs.values()) == {e for e in (frozenset(goes.get(v, v) for v in x) for x in every.values()) if len(e) == 2} and len(set(pairs.values())) == len(pairs)
    for r in out.FE.collect():
        assert pairs[r.eid] == frozenset((got[r.fid][r.pos], got[r.fid][(r.pos + 1) % len(got[r.fid])]))
    if link:  # the surface stays one: every edge has one or two faces
        assert {r["count"] for r in out.FE.groupBy("eid").count().collect()} <= {1, 2}


def test_collapse_of_a_flat_layer(spark):
    """Columns of cells whose layer in the middle has no height: its upright edges collapse and its cells go."""
    m = generate.structured3d(spark, 2, 2, 3).settled()
    z = {r.vid: round(3 * r.z) for r in m.V.collect()}
    flat = [r.eid for r in m.E.collect() if {z[r.v0], z[r.v1]} == {1, 2}]
    ask = spark.createDataFrame([(e,) for e in flat], "eid long")
    out, merged, deleted, log = batch.collapse(m, ask, topology=False, link=False)
    assert {r.outcome for r in log.collect()} == {"collapsed"}
    assert out.R.count() == 8 and deleted.where("dim = 3").count() == 4 and out.V.count() == 27
    want = generate.structured3d(spark, 2, 2, 2)
    assert sorted(r["n"] for r in out.counts().collect()) == sorted(r["n"] for r in want.counts().collect())
    wrong = {r.rule: r.violations for r in classify.check(out).collect() if r.violations}
    assert not {k for k in wrong if k.startswith(("cell", "face_used", "open"))}, wrong
    assert sorted(r["count"] for r in out.RF.groupBy("fid").count().collect()) == sorted(r["count"] for r in want.RF.groupBy("fid").count().collect())
    both = out.RF.groupBy("fid").agg(F.count("*").alias("k"), F.count_distinct("dir").alias("d"))
    assert both.where("k = 2 and d < 2").isEmpty()


def test_kept_vertex(spark):
    m = triangles(spark, 3, 3)
    e = m.E.join(m.V.where("gdim = 2").select(F.col("vid").alias("v0")), "v0").join(m.V.where("gdim < 2").select(F.col("vid").alias("v1")), "v1").orderBy("eid").first()
    wish = lambda v: spark.createDataFrame([(e.eid, v)], "eid long, vid long")
    ask = spark.createDataFrame([(e.eid,)], "eid long")
    assert batch.collapse_pairs(m, ask, keep=wish(e.v0))[1].first().outcome == "model entities"
    pairs, log = batch.collapse_pairs(m, ask, topology=False, keep=wish(e.v0))
    assert pairs.collect() == [(e.v1, e.v0)] and log.first().outcome == "collapsed"
