"""Queries over batches of edits, weaving of solids, values on parts, exact partitions and numberings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frame import MeshFrame
from ..operators import batch, geometry, graph, modify, simplex, split
from ..operators import distribute as dis
from ..operators import partition as cut
from ..working import settled
from . import adapters as ad
from .catalogue import _BOX, QUAD, TRI, _long, _tets, query
from .parted import _BOXP, _boxed

# ---- batches of edits ------------------------------------------------------------------------------------------------


@query(TRI + """q AS (SELECT F0.fid, list(vid ORDER BY pos) AS l FROM F0 JOIN QV ON F0.fid = QV.fid GROUP BY F0.fid),
s AS (SELECT 2 * fid - 1 AS fid, [l[1], l[2], l[4]] AS loop FROM q UNION ALL SELECT 2 * fid, [l[3], l[4], l[2]] FROM q)
SELECT fid, k::BIGINT AS pos, loop[k + 1] AS vid FROM s, (SELECT unnest([0, 1, 2]) AS k)""")  # fmt: skip
def swap_diagonals(spark, d):
    """The diagonals of all quads: all are swapped."""
    m = ad.triangles(spark, d).settled("V", "E", "F", "FE", "FV")
    pair = m.FE.withColumn("q", F.expr("(fid + 1) div 2")).groupBy("eid").agg(F.count("*").alias("k"), F.count_distinct("q").alias("quads")).where("k = 2 and quads = 1")
    return batch.swap(m, pair.select("eid"))[0].select("fid", *_long("pos"), "vid")


@query(QUAD + """w AS (SELECT DISTINCT j FROM F0),
p AS (SELECT j, 0 AS pos, 1 AS x, j + 1 AS y FROM w UNION ALL SELECT j, 1, 0, j + 1 FROM w
  UNION ALL SELECT j, 2 + k, k, j FROM w, (SELECT unnest(range(0, (SELECT nx + 1 FROM sz))) AS k)
  UNION ALL SELECT j, nx + 3 + t, nx - t, j + 1 FROM w, sz, (SELECT unnest(range(0, (SELECT nx - 1 FROM sz))) AS t))
SELECT (j + 1)::BIGINT AS fid, pos::BIGINT AS pos, (y * 20 + x + 1)::BIGINT AS vid FROM p""")  # fmt: skip
def join_rows(spark, d):
    """The quads of each row of the grid joined into one face, in chains of as many requests as the grid is wide."""
    m = ad.grid(spark, d).settled("V", "E", "F", "FE", "FV")
    _, ny = ad.grid_size(spark, d)
    across = m.FE.groupBy("eid").agg(F.min("fid").alias("a"), F.max("fid").alias("b")).where(F.col("b") == F.col("a") + ny)
    return batch.join(m, across.select("eid"))[0].FV.select("fid", *_long("pos"), "vid")


@query(QUAD + "x AS (SELECT 1) SELECT QV.fid, pos::BIGINT AS pos, vid FROM QV JOIN F0 USING (fid) WHERE i >= 2")
def merge_chains(spark, d):
    """The first two vertices of every row of the grid are merged into their right neighbours, in chains of two."""
    m = ad.grid(spark, d)
    pairs = m.V.where((F.col("vid") - 1) % ad.WIDTH < 2).select(F.col("vid").alias("old"), (F.col("vid") + 1).alias("new"))
    return modify.merge_vertices(m.V, m.FV, pairs)[1].select("fid", *_long("pos"), "vid")


_FLAT = _BOX + """lay AS (SELECT U.rid, U.lf, R.l, list_sort([CASE WHEN v <= 36 THEN v + 36 ELSE v END for v in U.key]) AS k FROM U JOIN R USING (rid) WHERE R.l >= 1)"""


@query(_FLAT + """ SELECT lay.rid, lay.lf::BIGINT AS pos, array_to_string(k, ' ') AS corners, CASE WHEN l = 1 AND lf = 0 THEN 1 ELSE RF.dir END AS dir
FROM lay JOIN RF ON RF.rid = lay.rid AND RF.pos = lay.lf""")  # fmt: skip
def collapse_layer(spark, d):
    """The upright edges of the lowest layer of the box collapse: its cells go, and its bottom becomes the next layer's."""
    m = ad.box(spark, d).settled("V", "E", "F", "FE", "FV", "R", "RF", "RV")
    out, _, _, _ = batch.collapse(m, m.E.where("hi - lo = 36 and lo <= 36").select("eid"), topology=False, link=False)
    corners = out.FV.groupBy("fid").agg(F.array_join(F.array_sort(F.collect_list("vid")), " ").alias("corners"))
    return out.RF.join(corners, "fid").select("rid", *_long("pos"), "corners", "dir")


@query(_BOX + "x AS (SELECT 1) SELECT 0 AS dim, 36 AS merged, 0 AS deleted UNION ALL SELECT 1, 60, 36 UNION ALL SELECT 2, 25, 60 UNION ALL SELECT 3, 0, 25")
def collapse_layer_log(spark, d):
    """What the collapse of a layer merges and deletes, by kind: 36 edges and the 60 sides on them go, the top merges."""
    m = ad.box(spark, d).settled("V", "E", "F", "FE", "FV", "R", "RF", "RV")
    _, merged, deleted, _ = batch.collapse(m, m.E.where("hi - lo = 36 and lo <= 36").select("eid"), topology=False, link=False)
    kinds = spark.range(4).select(F.col("id").cast("int").alias("dim"))
    a, b = (x.groupBy("dim").agg(F.count("*").cast("int").alias(n)) for x, n in ((merged, "merged"), (deleted, "deleted")))
    return kinds.join(a, "dim", "left").join(b, "dim", "left").fillna(0)


@query(_BOX + """mf AS (SELECT max(fid) AS mf FROM F1), mr AS (SELECT max(rid) AS mr FROM R),
p AS (SELECT RF.*, pos IN (0, 2, 5) AS a, min(fid) OVER (PARTITION BY rid) AS low FROM RF), q AS (SELECT *, max(CASE WHEN fid = low THEN a::INTEGER END) OVER (PARTITION BY rid) AS ka FROM p),
c AS (SELECT CASE WHEN a::INTEGER = ka THEN rid ELSE mr + rid END AS rid, pos AS o, fid, dir FROM q, mr
  UNION ALL SELECT CASE t WHEN 0 THEN rid ELSE mr + rid END, 99, mf + rid, CASE WHEN t = 0 THEN ka ELSE 1 - ka END FROM (SELECT DISTINCT rid, ka FROM q), mf, mr, (SELECT unnest([0, 1]) AS t))
SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY o) - 1 AS pos, fid, dir::INTEGER AS dir FROM c""")  # fmt: skip
def split_every_region(spark, d):
    """Every cell of the box cut along the six edges that avoid two opposite corners."""
    m = ad.box(spark, d).settled("V", "E", "F", "FE", "FV", "R", "RF", "RV").shuffled()
    ring = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(((1, 2), (2, 3), (3, 7), (7, 4), (4, 5), (5, 1)))], "k int, a int, b int")
    end = lambda c: m.RV.select("rid", F.col("pos").alias(c), F.col("vid").alias(f"v{c}"))
    sides = end("a").join(F.broadcast(ring), "a").join(end("b"), ["rid", "b"])  # six rows
    loops = sides.select("rid", F.col("k").alias("pos"), F.least("va", "vb").alias("lo"), F.greatest("va", "vb").alias("hi")).join(m.E.select("eid", "lo", "hi"), ["lo", "hi"])
    return simplex.split_regions(m, loops.select("rid", "pos", "eid"))[0].RF.select("rid", *_long("pos"), "fid", "dir")


# ---- splits that keep all tables ------------------------------------------------------------------------------------

_SIDES = _BOX + """nv AS (SELECT 36 * (nz + 1) AS nv FROM sz), nf AS (SELECT max(fid) AS nf FROM F1),
L1 AS (SELECT fid, U.loop FROM F1 JOIN U ON F1.rid = U.rid AND F1.lf = U.lf),
S AS (SELECT fid, k, loop[k + 1] AS v0, loop[(k + 1) % 4 + 1] AS v1 FROM L1, (SELECT unnest(range(0, 4)) AS k)),"""
_BOX_TABLES = ("V", "E", "F", "FE", "FV", "R", "RF", "RV")


def _with_ends(m: MeshFrame):
    """``fid, pos, lo, hi, dir``: how faces use edges, which their vertices name; ``dir`` is 1 from the lower to the higher."""
    j = m.FE.join(m.E.select("eid", "v0", "lo", "hi"), "eid")
    return j.select("fid", *_long("pos"), "lo", "hi", F.when(F.col("v0") == F.col("lo"), F.col("dir")).otherwise(1 - F.col("dir")).alias("dir"))


def _upright(spark, d):
    m = ad.box(spark, d).settled(*_BOX_TABLES)
    return split.split_edges(m, m.E.where("hi - lo = 36").select("eid", F.when(F.col("lo") % 2 == 0, 2).otherwise(1).alias("n")))


_UPRIGHT = _SIDES + """X AS (SELECT lo, lo + 36 AS hi, CASE WHEN lo % 2 = 0 THEN 2 ELSE 1 END AS n FROM (SELECT unnest(range(1, (SELECT nv - 35 FROM nv))) AS lo)),
N AS (SELECT lo, hi, n, k, nv + row_number() OVER (ORDER BY lo, k) AS vid FROM X, nv, (SELECT unnest([1, 2]) AS k) WHERE k <= n),
P AS (SELECT fid, k, 0 AS s, v0 AS vid FROM S UNION ALL SELECT fid, S.k, CASE WHEN v0 = lo THEN N.k ELSE n + 1 - N.k END, vid FROM S JOIN N ON least(v0, v1) = lo AND greatest(v0, v1) = hi),
FW AS (SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY k, s) - 1 AS pos, vid FROM P)"""


@query(_UPRIGHT + " SELECT fid, pos, vid FROM FW")
def split_upright_loops(spark, d):
    """Loops of the box after one or two new vertices on every upright edge."""
    return _upright(spark, d)[0].FV.select("fid", *_long("pos"), "vid")


@query(_UPRIGHT + """, G AS (SELECT fid, pos, vid AS v0, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS v1 FROM FW WINDOW w AS (PARTITION BY fid ORDER BY pos))
SELECT fid, pos, least(v0, v1) AS lo, greatest(v0, v1) AS hi, (v0 < v1)::INTEGER AS dir FROM G""")  # fmt: skip
def split_upright_edges(spark, d):
    """How the faces use the pieces."""
    return _with_ends(_upright(spark, d)[0])


@query(_UPRIGHT + """, C AS (SELECT DISTINCT rid, vid FROM RF JOIN FW USING (fid)) SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY vid) - 1 AS pos, vid, 'POLYHEDRON' AS rtype FROM C""")
def split_upright_cells(spark, d):
    """The vertices of the cells, which are polyhedra now."""
    out = _upright(spark, d)[0]
    return out.RV.join(out.R.select("rid", "rtype"), "rid").select("rid", *_long("pos"), "vid", "rtype")


def _all_faces(spark, d):
    m = ad.box(spark, d).settled(*_BOX_TABLES)
    return split.split_faces(m, m.F)


@query(_SIDES + "x AS (SELECT 1) SELECT rid, 4 * pos + k AS pos, nf + 4 * (fid - 1) + k + 1 AS fid, dir FROM RF, nf, (SELECT unnest(range(0, 4)) AS k)")
def split_faces_cells(spark, d):
    """How the cells of the box use the triangles, when every face is cut around its middle."""
    return _all_faces(spark, d)[0].RF.select("rid", *_long("pos"), "fid", "dir")


@query(_SIDES + """T3 AS (SELECT nf + 4 * (fid - 1) + k + 1 AS fid, v0, v1, nv + fid AS mid FROM S, nf, nv),
H AS (SELECT fid, 0 AS pos, v0 AS lo, mid AS hi, 0 AS dir FROM T3 UNION ALL SELECT fid, 1, least(v0, v1), greatest(v0, v1), (v0 < v1)::INTEGER FROM T3 UNION ALL SELECT fid, 2, v1, mid, 1 FROM T3)
SELECT fid, pos::BIGINT AS pos, lo, hi, dir FROM H""")  # fmt: skip
def split_faces_edges(spark, d):
    """How these triangles use edges."""
    return _with_ends(_all_faces(spark, d)[0])


_FIVE = "(VALUES (0,0,0),(0,1,1),(0,2,3),(0,3,4),(1,0,1),(1,1,2),(1,2,3),(1,3,6),(2,0,1),(2,1,4),(2,2,5),(2,3,6),(3,0,3),(3,1,4),(3,2,6),(3,3,7),(4,0,1),(4,1,3),(4,2,4),(4,3,6)) t(t, k, lv)"


@query(_BOX + f"""C AS (SELECT 5 * (rid - 1) + t + 1 AS rid, k AS pos, vid FROM RV JOIN {_FIVE} ON RV.pos = lv),
X AS (SELECT lo, 36 * (nz + 1) + row_number() OVER (ORDER BY lo) AS mid FROM sz, (SELECT unnest(range(1, (SELECT 36 * nz + 1 FROM sz))) AS lo) WHERE (lo - 1) % 6 % 2 = 0 AND (lo - 1) // 6 % 6 % 2 = 0),
H AS (SELECT a.rid, lo, mid, (SELECT count(*) FROM R) * 5 + 2 * row_number() OVER (ORDER BY a.rid) AS new FROM C a JOIN X ON a.vid = lo JOIN C b ON b.rid = a.rid AND b.vid = lo + 36)
SELECT rid, pos::BIGINT AS pos, vid FROM C WHERE rid NOT IN (SELECT rid FROM H)
UNION ALL SELECT new - 1, pos::BIGINT, CASE WHEN vid = lo + 36 THEN mid ELSE vid END FROM C JOIN H USING (rid)
UNION ALL SELECT new, pos::BIGINT, CASE WHEN vid = lo THEN mid ELSE vid END FROM C JOIN H USING (rid)""")  # fmt: skip
def bisect_tetrahedra(spark, d):
    """Every other upright edge of the box in both directions cut in the middle, with all tetrahedra at it."""
    v, rv = _tets(spark, d)
    m = MeshFrame.from_regions(v, rv, "TET", settle=True).settled(*_BOX_TABLES)
    some = m.E.where("hi - lo = 36 and (lo - 1) % 6 % 2 = 0 and ((lo - 1) div 6) % 6 % 2 = 0")
    return split.bisect_simplices(m, some.select("eid"))[0].RV.select("rid", *_long("pos"), "vid")


# ---- parts -----------------------------------------------------------------------------------------------------------


def _woven(spark, d):
    m, parts = _boxed(spark, d)
    m = m.settled("V", "E", "F", "FE", "FV", "R", "RF", "RV")
    return dis.weave_meshes(dis.apart(m, parts.transform(settled)))


@query(_BOXP + "x AS (SELECT 1) SELECT part, RF.rid, pos::BIGINT AS pos, fid, dir FROM RF JOIN L USING (rid)")
def weave_solid(spark, d):
    """The box in parts that know of each other only the places of their vertices, woven together again: cells, faces and
    directions of every part, ghosts too, are those of the undivided box."""
    return _woven(spark, d).tables["RF"].select("part", "rid", *_long("pos"), "fid", "dir")


_FEB = """FVB AS (SELECT fid, unnest(range(0, len(loop))) AS pos, unnest(loop) AS v0, unnest(list_concat(loop[2:], loop[:1])) AS v1 FROM F1 JOIN U ON F1.rid = U.rid AND F1.lf = U.lf),
EE AS (SELECT part, fid, pos, least(v0, v1) AS lo, greatest(v0, v1) AS hi, (v0 < v1)::INTEGER AS dir FROM FVB JOIN (SELECT DISTINCT part, fid FROM RF JOIN L USING (rid)) USING (fid)),"""


@query(_BOXP + _FEB + "x AS (SELECT 1) SELECT part, fid, pos::BIGINT AS pos, lo, hi, dir FROM EE")
def weave_solid_edges(spark, d):
    """The same for edges: between which vertices (by place) they run and how faces use them."""
    t = _woven(spark, d).tables
    at = lambda c: t["V"].select("part", F.col("vid").alias(c), (F.col("z") * 36 + F.col("y") * 6 + F.col("x") + 1).cast("long").alias(f"n{c}")).hint("merge")
    ends = t["E"].select("part", "eid", "v0", "v1").join(at("v0"), ["part", "v0"]).join(at("v1"), ["part", "v1"]).select("part", "eid", F.col("nv0").alias("lo"), F.col("nv1").alias("hi"))
    return t["FE"].join(ends.hint("merge"), ["part", "eid"]).select("part", "fid", *_long("pos"), "lo", "hi", "dir")


@query(_BOXP + """own AS (SELECT 3 AS dim, L.part, L.rid AS id, P.part AS mp FROM L JOIN P ON P.id = L.rid UNION ALL SELECT 0, DV.part, DV.gid, MV.mp FROM DV JOIN MV USING (gid))
SELECT dim, part, id, (id * 0.5 + mp + CASE WHEN id % 2 = 0 THEN 1000 * (mp + 1) ELSE 0 END)::DOUBLE AS dval FROM own""")  # fmt: skip
def distribute_values(spark, d):
    """Values of cells and vertices dealt out with the box. Owners change all of theirs, then those of even ids; after two
    updates (the second sends what changed) every copy, ghosts too, has its owner's value."""
    m, parts = _boxed(spark, d)
    m = m.settled("V", "E", "F", "FE", "FV", "R", "RF", "RV")
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("ival", "int"), ("dval", "double"), ("vval", "array<double>"), ("ref", "struct<dim:int,id:bigint>"))]
    value = lambda t, key, dim: t.select(F.lit("t").alias("name"), F.lit(dim).alias("dim"), F.col(key).alias("id"), *blank).withColumn("dval", F.col("id") * 0.5)
    p = dis.distribute(m.with_tables(AV=value(m.R, "rid", 3).union(value(m.V, "vid", 0))), parts.transform(settled))
    p = dis.PartedMesh(p.tables | {"AV": p.tables["AV"].transform(settled)})
    mine = p.all_copies().where("part = master_part").select("dim", "part", "id")

    def step(p, change, where):
        new = p.tables["AV"].join(mine, ["dim", "part", "id"], "left_semi").where(where).withColumn("dval", change)
        out = dis.update_attributes(dis.set_values(p, new), changed=new.select("name", "dim", "id"))
        return dis.PartedMesh(p.tables | {"AV": out.tables["AV"].transform(settled)})

    p = step(p, F.col("dval") + F.col("part"), "true")
    p = step(p, F.col("dval") + 1000 * (F.col("part") + 1), "id % 2 = 0")
    return p.tables["AV"].select("dim", "part", "id", "dval")


@query(_BOXP + "sh AS (SELECT part, RF.fid FROM RF JOIN P ON rid = id), b AS (SELECT fid FROM sh GROUP BY fid HAVING count(DISTINCT part) > 1) SELECT DISTINCT sh.part, sh.fid AS gid FROM sh JOIN b USING (fid)")
def faces_on_boundaries(spark, d):
    """Faces between elements that two parts own."""
    m, parts = _boxed(spark, d)
    return dis.distribute(m.settled(), parts).on_boundary(2).where("on_bdry").select("part", "gid")


def _bisection(head: str, centres: str, n: int, axes: str, levels: int) -> str:
    by = " ".join(f"WHEN {i} THEN {a}" for i, a in enumerate(axes))
    return head.replace("WITH", "WITH RECURSIVE", 1) + f"""c AS ({centres}),
b AS (SELECT *, 0 AS part, {n} AS k, 0 AS lev FROM c UNION ALL
  SELECT id, x, y, z, part + CASE WHEN r > low THEN (k + 1) // 2 ELSE 0 END, CASE WHEN k = 1 THEN 1 WHEN r > low THEN k // 2 ELSE (k + 1) // 2 END, lev + 1
  FROM (SELECT *, CASE WHEN k = 1 THEN n ELSE n * ((k + 1) // 2) // k END AS low FROM
    (SELECT *, row_number() OVER (PARTITION BY part ORDER BY CASE lev % {len(axes)} {by} END, id) AS r, count(*) OVER (PARTITION BY part) AS n FROM b WHERE lev < {levels})))
SELECT id, part::INTEGER AS part FROM b WHERE lev = {levels}"""


@query(_bisection(_BOX, "SELECT rid AS id, i + 0.5 AS x, j + 0.5 AS y, l + 0.5 AS z FROM R", 5, "xyz", 3))
def bisect_five(spark, d):
    """The cells of the box in five parts, along three axes."""
    return cut.cut_into(geometry.centroids(ad.box(spark, d), True), 5, ("x", "y", "z"))


@query(_bisection(QUAD, "SELECT fid AS id, i + 0.5 AS x, j + 0.5 AS y, 0 AS z FROM F0", 12, "xy", 4))
def bisect_twelve(spark, d):
    return cut.cut_into(geometry.centroids(ad.grid(spark, d)).select("id", "x", "y"), 12)


@query(_BOX + "x AS (SELECT 1) SELECT rid AS id, ((i * ny + j) * nz + 1) AS base, l::BIGINT AS height FROM R, sz")
def columns_of_cells(spark, d):
    """Columns of a box whose layers are shifted against each other, so that no coordinates agree."""
    m = ad.box(spark, d).settled("F", "FV", "RF")
    shifted = m.V.withColumns({"x": F.col("x") + F.col("z") * 0.013 + (F.col("vid") % 7) * 0.02, "y": F.col("y") - F.col("z") * 0.017 + (F.col("vid") % 5) * 0.02})
    return cut.columns(m.with_tables(V=shifted))


@query("SELECT count(*) AS n, count(*) AS n_ids, 1::BIGINT AS lo, count(*) AS hi, true AS no_wider FROM part")
def profile_of_pieces(spark, d):
    """Parts that orders hold together, in pieces of a hundred part numbers: all are numbered once, and the profile doesn't
    grow."""
    piece = lambda c: F.expr(f"{c} div 100")
    nodes = ad.read(spark, d, "part").select(F.col("p_partkey").alias("node")).transform(settled)
    e = ad.loops(spark, d).E.where(piece("v0") == piece("v1")).select(F.col("v0").alias("src"), F.col("v1").alias("dst"))
    e = e.union(e.select("dst", "src")).join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").transform(settled)
    new = graph.renumber_profile(nodes, e).transform(settled)
    size = lambda ids, name: graph.profiles(e, ids).agg(F.sum("reach").alias(name))
    both = size(new.select("node", F.col("new_id").alias("id")), "after").crossJoin(size(nodes.select("node", F.col("node").alias("id")), "before"))  # one row each
    told = new.agg(F.count("*").alias("n"), F.count_distinct("new_id").alias("n_ids"), F.min("new_id").alias("lo"), F.max("new_id").alias("hi"))
    return told.crossJoin(both.select((F.col("after") <= F.col("before")).alias("no_wider")))  # one row each
