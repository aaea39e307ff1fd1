"""Queries over the mesh views, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import MeshFrame
from ..operators import adjacency as adj
from ..operators import attributes as att
from ..operators import classify as cls
from ..operators import generate as gen
from ..operators import geometry as geo
from ..operators import graph as gr
from ..operators import modify as mod
from ..operators import parallel as par
from ..operators import sets
from ..working import settled
from . import adapters as ad

# ---- SQL of the views -------------------------------------------------------------------------------------------
_GRID = """
WITH sz AS (SELECT 19 AS nx, (SELECT count(*) // 20 - 1 FROM part) AS ny),
V AS (SELECT k + 1 AS vid, (k % 20)::DOUBLE AS x, (k // 20)::DOUBLE AS y, coalesce(p_retailprice / 1000, 0) AS z,
  CASE WHEN (k % 20 IN (0, nx)) AND (k // 20 IN (0, ny)) THEN 0 WHEN (k % 20 IN (0, nx)) OR (k // 20 IN (0, ny)) THEN 1 ELSE 2 END AS gdim,
  CASE WHEN (k % 20 IN (0, nx)) AND (k // 20 IN (0, ny)) THEN (CASE WHEN k // 20 = 0 THEN (CASE WHEN k % 20 = 0 THEN 1 ELSE 2 END) ELSE (CASE WHEN k % 20 = nx THEN 3 ELSE 4 END) END)
       WHEN k // 20 = 0 THEN 1 WHEN k % 20 = nx THEN 2 WHEN k // 20 = ny THEN 3 WHEN k % 20 = 0 THEN 4 ELSE 1 END::BIGINT AS gent
  FROM sz, (SELECT unnest(range(0, (SELECT 20 * (ny + 1) FROM sz)))::BIGINT AS k) LEFT JOIN part ON p_partkey = k),
F0 AS (SELECT f + 1 AS fid, f // ny AS i, f % ny AS j FROM sz, (SELECT unnest(range(0, (SELECT nx * ny FROM sz)))::BIGINT AS f)),
QV AS (SELECT fid, pos, (j + (CASE WHEN pos >= 2 THEN 1 ELSE 0 END)) * 20 + i + (CASE WHEN pos IN (1, 2) THEN 1 ELSE 0 END) + 1 AS vid FROM F0, (SELECT unnest([0, 1, 2, 3]) AS pos)),
"""
_QUAD = "FV AS (SELECT fid, pos, vid FROM QV),"
_TRI = """FV AS (SELECT 2 * q.fid - 1 + t AS fid, p AS pos, q.vid FROM QV q JOIN (VALUES (0,0,0),(0,1,1),(0,2,2),(1,0,0),(1,1,2),(1,2,3)) m(t, p, lp) ON q.pos = m.lp),"""
_LOOP = """
WITH V AS (SELECT p_partkey AS vid, (p_partkey % 20)::DOUBLE AS x, (p_partkey // 20)::DOUBLE AS y, p_retailprice / 1000 AS z, 2 AS gdim, 1::BIGINT AS gent FROM part),
FV0 AS (SELECT l_orderkey AS fid, l_partkey AS vid, min(l_linenumber) AS ln FROM lineitem GROUP BY ALL),
FV1 AS (SELECT fid, vid, row_number() OVER (PARTITION BY fid ORDER BY ln, vid) - 1 AS pos, count(*) OVER (PARTITION BY fid) AS n FROM FV0),
FV AS (SELECT fid, pos, vid FROM FV1 WHERE n >= 3),
"""
_EDGES = """
H AS (SELECT fid, pos, vid AS v0, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS v1 FROM FV WINDOW w AS (PARTITION BY fid ORDER BY pos)),
E AS (SELECT row_number() OVER (ORDER BY lo, hi) AS eid, lo AS v0, hi AS v1, lo, hi FROM (SELECT DISTINCT least(v0, v1) AS lo, greatest(v0, v1) AS hi FROM H)),
FE AS (SELECT fid, pos, eid, (H.v0 = lo)::INTEGER AS dir FROM H JOIN E ON lo = least(H.v0, H.v1) AND hi = greatest(H.v0, H.v1)),
F AS (SELECT fid, count(*)::INTEGER AS n FROM FV GROUP BY fid),
"""
_BOX = """
WITH sz AS (SELECT 5 AS nx, 5 AS ny, (SELECT count(*) // 10 FROM supplier) AS nz),
R AS (SELECT r + 1 AS rid, r // (ny * nz) AS i, (r // nz) % ny AS j, r % nz AS l, CASE WHEN (r + 1) % 3 = 0 THEN 2 ELSE 1 END AS gent FROM sz, (SELECT unnest(range(0, (SELECT nx * ny * nz FROM sz)))::BIGINT AS r)),
RV AS (SELECT rid, pos, ((l + pos // 4) * 6 + j + (CASE WHEN pos % 4 >= 2 THEN 1 ELSE 0 END)) * 6 + i + (CASE WHEN pos % 4 IN (1, 2) THEN 1 ELSE 0 END) + 1 AS vid FROM R, (SELECT unnest(range(0, 8)) AS pos)),
T AS (SELECT * FROM (VALUES (0,0,0),(0,1,3),(0,2,2),(0,3,1),(1,0,4),(1,1,5),(1,2,6),(1,3,7),(2,0,0),(2,1,1),(2,2,5),(2,3,4),(3,0,1),(3,1,2),(3,2,6),(3,3,5),(4,0,2),(4,1,3),(4,2,7),(4,3,6),(5,0,3),(5,1,0),(5,2,4),(5,3,7)) t(lf, k, lv)),
U AS (SELECT rid, lf, list(vid ORDER BY k) AS loop, list_sort(list(vid)) AS key FROM RV JOIN T ON pos = lv GROUP BY rid, lf),
O AS (SELECT key, min({'rid': rid, 'lf': lf}) AS o FROM U GROUP BY key),
F1 AS (SELECT key, o.rid AS rid, o.lf AS lf, row_number() OVER (ORDER BY o.rid, o.lf) AS fid FROM O),
RF AS (SELECT U.rid, U.lf AS pos, fid, (U.rid = F1.rid)::INTEGER AS dir FROM U JOIN F1 USING (key)),
"""
QUAD, TRI, LOOP = _GRID + _QUAD + _EDGES, _GRID + _TRI + _EDGES, _LOOP + _EDGES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- scans, counts, lookups --------------------------------------------------------------------------------------
@query(LOOP + "k AS (SELECT eid, count(*) AS n FROM FE GROUP BY eid) SELECT n AS n_faces, count(*) AS n_edges FROM k GROUP BY n")
def edge_face_count(spark, d):
    m = ad.loops(spark, d)
    return m.FE.groupBy("eid").agg(F.count("*").alias("n_faces")).groupBy("n_faces").agg(F.count("*").alias("n_edges"))


@query(QUAD + "x AS (SELECT 1) SELECT 0 AS dim, count(*) AS n FROM V UNION ALL SELECT 1, count(*) FROM E UNION ALL SELECT 2, count(*) FROM F UNION ALL SELECT 3, 0")
def entity_counts(spark, d):
    return ad.grid(spark, d).counts()


@query(QUAD + "x AS (SELECT 1) SELECT vid, x, y, z, gdim, gent FROM V WHERE vid = 137")
def vertex_lookup(spark, d):
    return ad.grid(spark, d).lookup(0, 137)


@query(QUAD + "x AS (SELECT 1) SELECT eid, v0, v1 FROM E ORDER BY eid LIMIT 1 OFFSET 41")
def edge_at(spark, d):
    return ad.grid(spark, d).at(1, 41).select("eid", "v0", "v1")


@query(QUAD + "x AS (SELECT 1) SELECT gdim, gent, count(*) AS n FROM V GROUP BY ALL")
def vertex_classes(spark, d):
    return ad.grid(spark, d).V.groupBy("gdim", "gent").agg(F.count("*").alias("n"))


@query(LOOP + "x AS (SELECT 1) SELECT fid, CASE n WHEN 3 THEN 'TRI' WHEN 4 THEN 'QUAD' ELSE 'POLYGON' END AS ftype FROM F")
def face_types(spark, d):
    return adj.face_type(ad.loops(spark, d))


# ---- adjacency ---------------------------------------------------------------------------------------------------
@query(QUAD + "p AS (SELECT v0 AS vid, v1 AS nbr FROM E UNION ALL SELECT v1, v0 FROM E) SELECT vid, nbr FROM p")
def vertex_neighbors(spark, d):
    return adj.vertex_neighbors(ad.grid(spark, d))


@query(LOOP + "p AS (SELECT v0 AS vid, v1 AS nbr FROM E UNION ALL SELECT v1, v0 FROM E) SELECT vid, count(*) AS n FROM p GROUP BY vid")
def vertex_valence(spark, d):
    return adj.degree(adj.vertex_neighbors(ad.loops(spark, d)), "vid", "nbr")


@query(QUAD + "x AS (SELECT 1) SELECT v0 AS vid, eid FROM E UNION SELECT v1, eid FROM E")
def vertex_edges(spark, d):
    return adj.vertex_edges(ad.grid(spark, d))


@query(LOOP + "x AS (SELECT 1) SELECT DISTINCT vid, fid FROM FV")
def vertex_faces(spark, d):
    return adj.vertex_faces(ad.loops(spark, d))


@query(_BOX + "x AS (SELECT 1) SELECT DISTINCT vid, rid FROM RV")
def vertex_regions(spark, d):
    return adj.vertex_regions(ad.box(spark, d))


@query(LOOP + "x AS (SELECT 1) SELECT eid, 0 AS pos, v0 AS vid FROM E UNION ALL SELECT eid, 1, v1 FROM E")
def edge_vertices(spark, d):
    return adj.edge_vertices(ad.loops(spark, d))


@query(LOOP + "x AS (SELECT 1) SELECT eid, fid, dir FROM FE")
def edge_faces(spark, d):
    return adj.edge_faces(ad.loops(spark, d))


@query(LOOP + "x AS (SELECT 1) SELECT fid, pos::BIGINT AS pos, eid, dir FROM FE")
def face_edges(spark, d):
    return adj.face_edges(ad.loops(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query(LOOP + "s AS (SELECT fid, max(vid) AS vid FROM FV GROUP BY fid), a AS (SELECT FV.fid, FV.pos AS p0 FROM FV JOIN s USING (fid, vid)) SELECT FV.fid, (p0 - pos + n) % n AS k, vid FROM FV JOIN a USING (fid) JOIN F USING (fid)")
def face_loop_rotated(spark, d):
    m = ad.loops(spark, d)
    starts = m.FV.groupBy("fid").agg(F.max("vid").alias("vid"))
    return adj.face_loop(m, starts, reverse=True).select("fid", *_long("k"), "vid")


@query(LOOP + "x AS (SELECT 1) SELECT a.fid, b.fid AS nbr, a.eid FROM FE a JOIN FE b USING (eid) WHERE a.fid <> b.fid")
def face_neighbors(spark, d):
    return adj.face_neighbors(ad.loops(spark, d))


@query(LOOP + "x AS (SELECT 1) SELECT eid, count(*) AS n FROM FE GROUP BY eid HAVING count(*) > 2")
def non_manifold_edges(spark, d):
    return adj.non_manifold_edges(ad.loops(spark, d))


@query(LOOP + "p AS (SELECT fid, min(vid) AS a, max(vid) AS b FROM FV GROUP BY fid) SELECT a, b, coalesce(eid, 0) AS eid FROM (SELECT DISTINCT a, b FROM p) LEFT JOIN E ON lo = a AND hi = b")
def common_edge(spark, d):
    m = ad.loops(spark, d)
    return adj.common_edge(m, m.FV.groupBy("fid").agg(F.min("vid").alias("a"), F.max("vid").alias("b")).select("a", "b").distinct()).fillna({"eid": 0})


@query(LOOP + "g AS (SELECT eid AS grp, v0 AS vid FROM E UNION ALL SELECT eid, v1 FROM E) SELECT grp, fid FROM g JOIN FV USING (vid) GROUP BY grp, fid HAVING count(DISTINCT vid) = 2")
def common_face(spark, d):
    m = ad.loops(spark, d)
    return adj.containing(m.FV, "fid", "vid", m.E.select(F.col("eid").alias("grp"), F.explode(F.array("v0", "v1")).alias("vid")))


@query(LOOP + "x AS (SELECT 1) SELECT DISTINCT o_orderkey AS fid, l_partkey AS vid FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND (o_orderkey, l_partkey) IN (SELECT (fid, vid) FROM FV)")
def face_uses_vertex(spark, d):
    m = ad.loops(spark, d)
    asked = ad.read(spark, d, "orders").where("o_orderstatus = 'F'").join(ad.read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("fid"), F.col("l_partkey").alias("vid")).distinct()
    return adj.uses(m.FV, asked)


@query(LOOP + "k AS (SELECT fid, string_agg(vid, ',' ORDER BY vid) AS key FROM FV GROUP BY fid), c AS (SELECT key, min(fid) AS same FROM k GROUP BY key HAVING count(*) > 1) SELECT fid, same FROM k JOIN c USING (key)")
def same_faces(spark, d):
    return adj.same_faces(ad.loops(spark, d))


@query(QUAD + "x AS (SELECT 1) SELECT DISTINCT a.fid AS src, b.fid AS dst FROM FE a JOIN FE b USING (eid) WHERE a.fid <> b.fid")
def element_graph(spark, d):
    return adj.element_graph(ad.grid(spark, d))


@query(QUAD + "g AS (SELECT DISTINCT a.fid AS src, b.fid AS dst FROM FE a JOIN FE b USING (eid) WHERE a.fid <> b.fid), k AS (SELECT src, count(*) AS n FROM g GROUP BY src) SELECT fid AS src, (sum(coalesce(k.n, 0)) OVER (ORDER BY fid) - coalesce(k.n, 0))::BIGINT AS adjbeg, coalesce(k.n, 0) AS n FROM F LEFT JOIN k ON src = fid")
def graph_offsets(spark, d):
    m = ad.grid(spark, d)
    return adj.graph_offsets(adj.element_graph(m), m.F.select(F.col("fid").alias("id")))


@query(_BOX + "x AS (SELECT 1) SELECT rid, pos, fid, dir FROM RF")
def region_faces(spark, d):
    return adj.region_faces(ad.box(spark, d))


@query(_BOX + "x AS (SELECT 1) SELECT fid, 1 - dir AS side, rid FROM RF")
def face_regions(spark, d):
    return adj.face_regions(ad.box(spark, d))


@query(_BOX + "x AS (SELECT 1) SELECT a.rid, b.rid AS nbr, fid FROM RF a JOIN RF b USING (fid) WHERE a.rid <> b.rid")
def region_neighbors(spark, d):
    return adj.region_neighbors(ad.box(spark, d))


@query(_BOX + "x AS (SELECT 1) SELECT rid, pos::BIGINT AS pos, vid FROM RV")
def region_vertices(spark, d):
    return adj.region_vertices(ad.box(spark, d)).select("rid", *_long("pos"), "vid")


@query(_BOX + "x AS (SELECT 1) SELECT rid, 12::BIGINT AS n FROM R")
def region_edge_counts(spark, d):
    return adj.degree(adj.region_edges(ad.box(spark, d)), "rid", "eid")


@query(_BOX + "x AS (SELECT 1) SELECT rid, 'HEX' AS rtype FROM R")
def region_types(spark, d):
    return adj.region_type(ad.box(spark, d))


# ---- attributes --------------------------------------------------------------------------------------------------
def _attributed(spark, d) -> MeshFrame:
    m = att.define(att.define(ad.grid(spark, d), "qty", "DOUBLE", 0), "size", "INT", 0)
    li = ad.read(spark, d, "lineitem").groupBy((F.col("l_partkey") + 1).alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("dval"))
    m = att.set_values(m, li.where("dval > 750").select(F.lit("qty").alias("name"), F.lit(0).alias("dim"), "id", "dval"))
    p = ad.read(spark, d, "part").where("p_size > 20").select(F.lit("size").alias("name"), F.lit(0).alias("dim"), (F.col("p_partkey") + 1).alias("id"), F.col("p_size").alias("ival"))
    return att.set_values(m, p)


_ATT = _GRID + "q AS (SELECT l_partkey + 1 AS id, sum(l_quantity::BIGINT)::DOUBLE AS dval FROM lineitem GROUP BY l_partkey HAVING sum(l_quantity) > 750), s AS (SELECT p_partkey + 1 AS id, p_size AS ival FROM part WHERE p_size > 20)"


@query(_ATT + " SELECT vid AS id, (q.id IS NOT NULL)::INTEGER AS status, coalesce(dval, 0) AS dval FROM V LEFT JOIN q ON vid = q.id")
def attr_get_default(spark, d):
    return att.get_values(_attributed(spark, d), "qty", 0).select("id", "status", "dval")


@query(_ATT + ", u AS (SELECT vid AS id, (vid * 2)::INTEGER AS ival FROM V WHERE vid % 5 = 0) SELECT coalesce(u.id, s.id) AS id, coalesce(u.ival, s.ival) AS ival FROM s FULL JOIN u USING (id)")
def attr_upsert(spark, d):
    m = _attributed(spark, d)
    new = m.V.where("vid % 5 = 0").select(F.lit("size").alias("name"), F.lit(0).alias("dim"), F.col("vid").alias("id"), (F.col("vid") * 2).cast("int").alias("ival"))
    return att.set_values(m, new).AV.where("name = 'size'").select("id", "ival")


@query(_ATT + " SELECT id, dval FROM q WHERE id NOT IN (SELECT id FROM s)")
def attr_remove(spark, d):
    m = _attributed(spark, d)
    return att.remove_values(m, m.AV.where("name = 'size'").select("dim", "id")).AV.where("name = 'qty'").select("id", "dval")


@query(_ATT + " SELECT 'qty' AS name, count(*) AS n, 0.0::DOUBLE AS total FROM q UNION ALL SELECT 'size', count(*), sum(ival)::DOUBLE FROM s")
def attr_clear(spark, d):
    av = att.clear_values(_attributed(spark, d), "qty").AV
    return av.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("dval"), F.col("ival").cast("double"))).alias("total"))


@query(_GRID + "u AS (SELECT vid AS id, unnest([0, 1, 2]) AS k, x, y, gdim FROM V) SELECT id, k, CASE k WHEN 0 THEN x WHEN 1 THEN y ELSE gdim::DOUBLE END AS value FROM u")
def attr_vector(spark, d):
    m = att.define(ad.grid(spark, d), "velocity", "VECTOR", 0, 3)
    rows = m.V.select(F.lit("velocity").alias("name"), F.lit(0).alias("dim"), F.col("vid").alias("id"), F.array("x", "y", F.col("gdim").cast("double")).alias("vval"))
    return att.set_vectors(m, rows).AV.select("id", F.posexplode("vval").alias("k", "value"))


# ---- sets --------------------------------------------------------------------------------------------------------
def _sets(spark, d) -> MeshFrame:
    m = ad.grid(spark, d)
    p = ad.read(spark, d, "part").select((F.col("p_partkey")).alias("pos"), F.lit(0).alias("dim"), (F.col("p_partkey") + 1).alias("id"), "p_size", "p_retailprice")
    m = sets.put(m, "small", 0, p.where("p_size < 20").select("pos", "dim", "id"))
    return sets.put(m, "dear", 0, p.where("p_retailprice > 1000").select("pos", "dim", "id"))


_SETS = "WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey + 1 AS id FROM part WHERE p_size < 20), b AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_partkey + 1 AS id FROM part WHERE p_retailprice > 1000) "


def _members(df):
    return df.select("id")


@query(_SETS + "SELECT id FROM a UNION SELECT id FROM b")
def set_union(spark, d):
    m = _sets(spark, d)
    return _members(sets.union(sets.members(m, "small"), sets.members(m, "dear")))


@query(_SETS + "SELECT id FROM a INTERSECT SELECT id FROM b")
def set_intersect(spark, d):
    m = _sets(spark, d)
    return _members(sets.intersect(sets.members(m, "small"), sets.members(m, "dear")))


@query(_SETS + "SELECT id FROM a EXCEPT SELECT id FROM b")
def set_subtract(spark, d):
    m = _sets(spark, d)
    return _members(sets.subtract(sets.members(m, "small"), sets.members(m, "dear")))


@query(_SETS + "SELECT b.id, coalesce(a.pos, -1) AS pos FROM b LEFT JOIN a USING (id)")
def set_locate(spark, d):
    m = _sets(spark, d)
    return sets.locate(sets.members(m, "small"), sets.members(m, "dear").select("dim", "id")).select("id", *_long("pos"))


@query(_SETS + "SELECT id FROM b WHERE id IN (SELECT id FROM a)")
def set_contains(spark, d):
    m = _sets(spark, d)
    return _members(sets.contains(sets.members(m, "small"), sets.members(m, "dear").select("dim", "id")))


@query(_SETS + "SELECT pos, id FROM a UNION ALL SELECT pos + (SELECT count(*) FROM a), id FROM b")
def set_cat(spark, d):
    m = _sets(spark, d)
    return sets.concat(sets.members(m, "small"), sets.members(m, "dear")).select(*_long("pos"), "id")


# ---- geometry ----------------------------------------------------------------------------------------------------
def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if c in names else F.col(c) for c in df.columns])


_P = "p AS (SELECT vid, x, y, z FROM V) "


@query(QUAD + _P + "SELECT eid, round(sqrt((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2), 6) AS len, round((b.x-a.x)**2 + (b.y-a.y)**2 + (b.z-a.z)**2, 6) AS lensqr FROM E JOIN p a ON v0 = a.vid JOIN p b ON v1 = b.vid")
def edge_length(spark, d):
    return _round(geo.edge_vectors(ad.grid(spark, d)).select("eid", "len", "lensqr"), "len", "lensqr")


@query(QUAD + _P + "SELECT eid, round(b.x-a.x, 6) + 0.0 AS dx, round(b.y-a.y, 6) + 0.0 AS dy, round(b.z-a.z, 6) + 0.0 AS dz FROM E JOIN p a ON v0 = a.vid JOIN p b ON v1 = b.vid")
def edge_vector(spark, d):
    return _round(geo.edge_vectors(ad.grid(spark, d)).select("eid", "dx", "dy", "dz"), "dx", "dy", "dz")


@query(QUAD + _P + """, n AS (SELECT v0 AS vid, v1 AS far, eid FROM E UNION ALL SELECT v1, v0, eid FROM E),
j AS (SELECT a.eid AS e1, b.eid AS e2, a.vid, u.x-o.x AS ux, u.y-o.y AS uy, u.z-o.z AS uz, w.x-o.x AS wx, w.y-o.y AS wy, w.z-o.z AS wz
 FROM n a JOIN n b USING (vid) JOIN p o USING (vid) JOIN p u ON a.far = u.vid JOIN p w ON b.far = w.vid WHERE a.eid < b.eid)
SELECT e1, e2, vid, round((ux*wx + uy*wy + uz*wz) / sqrt(ux*ux + uy*uy + uz*uz) / sqrt(wx*wx + wy*wy + wz*wz), 6) + 0.0 AS cosine FROM j""")
def edge_cosine(spark, d):
    return _round(geo.edge_cosines(ad.grid(spark, d)), "cosine")


@query(QUAD + _P + """, c AS (SELECT fid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM FV JOIN p USING (vid) GROUP BY fid),
s AS (SELECT FE.eid, fid, c.x, c.y, c.z FROM FE JOIN c USING (fid)),
j AS (SELECT a.eid, a.fid AS f1, b.fid AS f2, q.x-o.x AS ex, q.y-o.y AS ey, q.z-o.z AS ez, a.x-o.x AS ax, a.y-o.y AS ay, a.z-o.z AS az, b.x-q.x AS bx, b.y-q.y AS by_, b.z-q.z AS bz
  FROM s a JOIN s b USING (eid) JOIN E USING (eid) JOIN p o ON v0 = o.vid JOIN p q ON v1 = q.vid WHERE a.fid < b.fid),
k AS (SELECT eid, f1, f2, ey*az-ez*ay AS nx, ez*ax-ex*az AS ny, ex*ay-ey*ax AS nz, -(ey*bz-ez*by_) AS mx, -(ez*bx-ex*bz) AS my, -(ex*by_-ey*bx) AS mz FROM j)
SELECT eid, f1, f2, round(-(nx*mx + ny*my + nz*mz) / sqrt(nx*nx + ny*ny + nz*nz) / sqrt(mx*mx + my*my + mz*mz), 6) + 0.0 AS cosine FROM k""")
def dihedral_cosine(spark, d):
    return _round(geo.dihedral_cosines(ad.grid(spark, d)), "cosine")


@query(QUAD + _P + """, l AS (SELECT fid, pos, x, y, z, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS nv, coalesce(lag(vid) OVER w, last_value(vid) OVER (PARTITION BY fid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS pv FROM FV JOIN p USING (vid) WINDOW w AS (PARTITION BY fid ORDER BY pos)),
s AS (SELECT fid, pos, greatest((q.x-l.x)**2+(q.y-l.y)**2+(q.z-l.z)**2, 1e-28) AS a, greatest((r.x-l.x)**2+(r.y-l.y)**2+(r.z-l.z)**2, 1e-28) AS b, greatest((r.x-q.x)**2+(r.y-q.y)**2+(r.z-q.z)**2, 1e-28) AS c FROM l JOIN p q ON nv = q.vid JOIN p r ON pv = r.vid)
SELECT fid, pos::BIGINT AS pos, round((a + b) / sqrt(4*a*b - (a+b-c)**2), 6) AS cond FROM s""")
def face_condition(spark, d):
    return _round(geo.face_conditions(ad.grid(spark, d)), "cond").withColumn("pos", F.col("pos").cast("long"))


_TETS = [(0, 1, 3, 4), (1, 2, 3, 6), (1, 4, 5, 6), (3, 4, 6, 7), (1, 3, 4, 6)]


def _tets(spark, d):
    """Five tetrahedra of each hexahedron."""
    v, rv = gen.grid3d(spark, *(n := ad.box_size(spark, d)), (0.0, 0.0, 0.0), tuple(map(float, n)))
    tpl = F.broadcast(spark.createDataFrame([(t, k, lv) for t, c in enumerate(_TETS) for k, lv in enumerate(c)], "t int, k int, lv int"))  # 20 rows
    return v, rv.join(tpl, rv["pos"] == tpl["lv"]).select((5 * (F.col("rid") - 1) + F.col("t") + 1).alias("rid"), F.col("k").alias("pos"), "vid")


@query(_BOX + "x AS (SELECT unnest([0, 1, 2, 3, 4]) AS t) SELECT 5 * (rid - 1) + t + 1 AS rid, round(CASE WHEN t = 4 THEN 2 ELSE 1 END / 6.0::DOUBLE, 6) AS volume FROM R, x")
def tet_volume(spark, d):
    v, rv = _tets(spark, d)
    return _round(geo.tet_volumes(MeshFrame.empty(spark).with_tables(V=v, RV=rv)), "volume")


@query(_BOX + "x AS (SELECT 1) SELECT rid, 1.0::DOUBLE AS volume, true AS star_shaped FROM R")
def region_volume(spark, d):
    return _round(geo.region_volumes(ad.box(spark, d)), "volume")


# ---- generation, conversion, renumbering -------------------------------------------------------------------------
@query(QUAD + "x AS (SELECT 1) SELECT fid, pos::BIGINT AS pos, vid FROM FV")
def gen_structured_2d(spark, d):
    return ad.grid_parts(spark, d, flat=True)[1].select("fid", *_long("pos"), "vid")


@query(_BOX + "x AS (SELECT q + 1 AS vid, (q % 6)::DOUBLE AS x, ((q // 6) % 6)::DOUBLE AS y, (q // 36)::DOUBLE AS z, (q % 6 BETWEEN 1 AND 4)::INTEGER + ((q // 6) % 6 BETWEEN 1 AND 4)::INTEGER + (q // 36 > 0 AND q // 36 < nz)::INTEGER AS gdim FROM sz, (SELECT unnest(range(0, (SELECT 36 * (nz + 1) FROM sz)))::BIGINT AS q)) SELECT * FROM x")
def gen_structured_3d(spark, d):
    n = ad.box_size(spark, d)
    return _round(gen.grid3d(spark, *n, (0.0, 0.0, 0.0), tuple(map(float, n)))[0].drop("gent"), "x", "y", "z")


@query(TRI + "x AS (SELECT (SELECT count(*) FROM V) AS nv, (SELECT count(*) FROM E) AS ne, (SELECT count(*) FROM F) AS nf) SELECT nv + ne + nf AS n_vertices, 3 * nf AS n_faces, (2 * ne + 3 * nf)::BIGINT AS n_edges FROM x")
def tri_to_quad(spark, d):
    q = gen.tri_to_quad(ad.triangles(spark, d))
    return q.V.agg(F.count("*").alias("n_vertices")).crossJoin(q.F.agg(F.count("*").alias("n_faces"))).crossJoin(q.E.agg(F.count("*").alias("n_edges")))  # one row each


@query(_BOX + "tt AS (SELECT * FROM (VALUES (0,0,1,3,4),(1,1,2,3,6),(2,1,4,5,6),(3,3,4,6,7),(4,1,3,4,6)) v(t, a, b, c, e)), w AS (SELECT rid, list(vid ORDER BY pos) AS v FROM RV GROUP BY rid), k AS (SELECT list_sort([v[a+1], v[b+1], v[c+1], v[e+1]]) AS s FROM w, tt), ed AS (SELECT DISTINCT unnest([[s[1],s[2]],[s[1],s[3]],[s[1],s[4]],[s[2],s[3]],[s[2],s[4]],[s[3],s[4]]]) AS e FROM k), fa AS (SELECT DISTINCT unnest([[s[1],s[2],s[3]],[s[1],s[2],s[4]],[s[1],s[3],s[4]],[s[2],s[3],s[4]]]) AS f FROM k) SELECT (SELECT 36 * (nz + 1) FROM sz) + (SELECT count(*) FROM ed) + (SELECT count(*) FROM fa) + (SELECT count(*) FROM k) AS n_vertices, 4 * (SELECT count(*) FROM k) AS n_regions")
def tet_to_hex(spark, d):
    v, rv = gen.tet_to_hex(*_tets(spark, d))
    return v.agg(F.count("*").alias("n_vertices")).crossJoin(rv.agg(F.count_distinct("rid").alias("n_regions")))  # one row each


@query(QUAD + "x AS (SELECT 1) SELECT vid FROM V WHERE gdim < 2")
def boundary_only(spark, d):
    return gen.boundary_only(ad.grid(spark, d)).V.select("vid")


@query(LOOP + "x AS (SELECT 1) SELECT fid, row_number() OVER (ORDER BY fid) AS new_id FROM F")
def renumber_dense(spark, d):
    return gen.renumber(ad.loops(spark, d).F, "fid")


@query(QUAD + "g AS (SELECT v0 AS src, v1 AS dst FROM E) SELECT max(abs(src - dst)) AS max_diff, round(avg(abs(src - dst)), 6) AS mean_diff FROM g")
def bandwidth(spark, d):
    return _round(gr.bandwidth(ad.grid(spark, d).E.select(F.col("v0").alias("src"), F.col("v1").alias("dst"))), "mean_diff")


# ---- classification and checks -----------------------------------------------------------------------------------
_CF = _BOX + """i AS (SELECT fid, count(*) AS k, min(gent) AS a, max(gent) AS b FROM RF JOIN R USING (rid) GROUP BY fid),
CF0 AS (SELECT fid, CASE WHEN k = 2 AND a = b THEN 3 ELSE 2 END AS gdim, CASE WHEN k = 2 THEN a ELSE 0 END AS a, b FROM i),
CF AS (SELECT fid, gdim, CASE WHEN gdim = 3 THEN a ELSE dense_rank() OVER (PARTITION BY gdim ORDER BY a, b) END::BIGINT AS gent FROM CF0),"""


@query(_CF + "x AS (SELECT 1) SELECT fid, gdim, gent FROM CF")
def classify_faces(spark, d):
    return cls.classify_faces(ad.box(spark, d))


_CE = _CF + """BFV AS (SELECT fid, unnest(loop) AS vid, generate_subscripts(loop, 1) AS pos FROM U JOIN F1 ON U.key = F1.key AND U.rid = F1.rid),
BH AS (SELECT fid, vid AS a, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS b FROM BFV WINDOW w AS (PARTITION BY fid ORDER BY pos)),
BE AS (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM BH),
EC0 AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi, count(*) FILTER (gdim = 2) AS k, count(DISTINCT CASE WHEN gdim = 2 THEN gent END) AS c FROM BH JOIN CF USING (fid) GROUP BY ALL),
EC AS (SELECT lo, hi, CASE WHEN k = 0 THEN 3 WHEN k = 2 AND c = 1 THEN 2 ELSE 1 END AS gdim FROM EC0),"""


@query(_CE + "x AS (SELECT 1) SELECT lo, hi, gdim FROM EC")
def classify_edges(spark, d):
    m = ad.box(spark, d)
    return cls.classify_edges(m, cls.classify_faces(m)).join(m.E.select("eid", "lo", "hi"), "eid").select("lo", "hi", "gdim")


@query(QUAD + """c AS (SELECT eid, v0, v1, CASE WHEN (SELECT count(*) FROM FE WHERE FE.eid = E.eid) = 1 THEN 1 ELSE 2 END AS gdim FROM E),
s AS (SELECT v0 AS vid, gdim FROM c UNION ALL SELECT v1, gdim FROM c), g AS (SELECT vid, count(*) FILTER (gdim = 1) AS m FROM s GROUP BY vid)
SELECT CASE WHEN m = 2 THEN 1 WHEN m = 0 THEN 2 ELSE 0 END AS gdim, count(*) AS n FROM g GROUP BY ALL""")
def classify_vertices(spark, d):
    m = ad.grid(spark, d)
    return cls.classify_vertices(m, cls.classify_edges(m)).groupBy("gdim").agg(F.count("*").alias("n"))


@query(QUAD + """a AS (SELECT vid AS v0, gdim AS d0, gent AS g0 FROM V), b AS (SELECT vid AS v1, gdim AS d1, gent AS g1 FROM V)
SELECT eid, CASE WHEN d0 > d1 THEN d0 WHEN d1 > d0 THEN d1 WHEN g0 = g1 THEN d0 ELSE 4 END AS gdim, CASE WHEN d0 > d1 THEN g0 WHEN d1 > d0 THEN g1 WHEN g0 = g1 THEN g0 ELSE 0 END AS gent FROM E JOIN a USING (v0) JOIN b USING (v1)""")
def infer_edge_class(spark, d):
    return cls.infer_edge_class(ad.grid(spark, d))


@query(LOOP + """x AS (SELECT 1) SELECT 'vertex_without_edge' AS rule, count(*) AS violations FROM V WHERE vid NOT IN (SELECT v0 FROM E UNION SELECT v1 FROM E)
UNION ALL SELECT 'face_with_fewer_than_three_edges', 0 UNION ALL SELECT 'open_loop', 0 UNION ALL SELECT 'edge_with_equal_ends', 0""")
def check_topo(spark, d):
    return cls.check(ad.loops(spark, d, settle=True), ["vertex_without_edge", "face_with_fewer_than_three_edges", "open_loop", "edge_with_equal_ends"])


@query(_BOX + """x AS (SELECT unnest(['face_used_alike_by_two_cells', 'face_with_more_than_two_cells', 'cell_with_fewer_than_four_faces', 'cell_faces_not_mutually_oriented']) AS rule) SELECT rule, 0::BIGINT AS violations FROM x""")
def check_topo_solid(spark, d):
    return cls.check(ad.box(spark, d)).where(F.col("rule").isin("face_used_alike_by_two_cells", "face_with_more_than_two_cells", "cell_with_fewer_than_four_faces", "cell_faces_not_mutually_oriented"))


# ---- partitions --------------------------------------------------------------------------------------------------
PARTS = 4
_PAR = QUAD + f"""P AS (SELECT fid AS id, least((row_number() OVER (ORDER BY fid) - 1) // greatest(1, (SELECT count(*) FROM F) // {PARTS}), {PARTS - 1})::INTEGER AS part FROM F),
C AS (SELECT DISTINCT part, vid FROM FV JOIN P ON fid = id), O AS (SELECT vid, min(part) AS master_part, count(*) AS k FROM C GROUP BY vid),
OC AS (SELECT vid AS gid, part, master_part FROM C JOIN O USING (vid)),
G AS (SELECT DISTINCT C.part, FV.fid AS gid, P.part AS master_part FROM C JOIN FV USING (vid) JOIN P ON FV.fid = P.id WHERE C.part <> P.part),"""


def _parted(spark, d):
    m = ad.grid(spark, d)
    return m, par.strips(m.F.select(F.col("fid").alias("id")), PARTS)


def _copies(spark, d):
    m, parts = _parted(spark, d)
    return m, par.owners(m.FV, "fid", "vid", parts)


def _valued(spark, d):
    _, c = _copies(spark, d)
    return c.withColumn("val", (F.col("gid") * (F.col("part") + 1)).cast("double"))


_VAL = _PAR + "W AS (SELECT gid, part, master_part, (gid * (part + 1))::DOUBLE AS val FROM OC)"


@query(_PAR + "x AS (SELECT 1) SELECT gid, part, master_part FROM OC")
def partition_owner(spark, d):
    return _copies(spark, d)[1]


@query(_PAR + "x AS (SELECT 1) SELECT vid AS gid FROM O WHERE k > 1")
def partition_boundary(spark, d):
    return par.boundary(_copies(spark, d)[1])


@query(_PAR + "x AS (SELECT 1) SELECT part, gid, master_part FROM G")
def ghost_layer(spark, d):
    m, parts = _parted(spark, d)
    return par.ghost_cells(m.FV, parts)


@query(_PAR + "x AS (SELECT 1) SELECT DISTINCT master_part AS part, gid FROM G")
def overlap_layer(spark, d):
    m, parts = _parted(spark, d)
    return par.overlap_cells(par.ghost_cells(m.FV, parts))


@query(_PAR + """L AS (SELECT part, id AS fid, true AS own FROM P UNION ALL SELECT part, gid, false FROM G), D AS (SELECT part, vid AS gid, max(own) AS own FROM FV JOIN L USING (fid) GROUP BY ALL),
M AS (SELECT gid, min(part) FILTER (own) AS master_part, count(*) AS k FROM D GROUP BY gid)
SELECT part, CASE WHEN part <> master_part THEN 3 WHEN k > 1 THEN 1 ELSE 0 END AS ptype, count(*) AS n FROM D JOIN M USING (gid) GROUP BY ALL""")
def label_vertices(spark, d):
    m, parts = _parted(spark, d)
    return par.label_vertices(m.FV, par.label_cells(parts, par.ghost_cells(m.FV, parts))).groupBy("part", "ptype").agg(F.count("*").alias("n"))


@query(_VAL + " SELECT W.gid, W.part, W.master_part, o.val FROM W JOIN W o ON W.gid = o.gid AND o.part = W.master_part")
def ghost_update(spark, d):
    return par.update_ghosts(_valued(spark, d), ["val"])


def _gather(op):
    def run(spark, d):
        return _round(par.gather_scatter(_valued(spark, d), "val", op), "val")

    return run


for _op in ("max", "min", "sum", "avg"):
    QUERIES[f"gather_{_op}"] = _gather(_op.upper())
    SQL[f"gather_{_op}"] = _VAL + f" SELECT gid, part, master_part, round({_op}(val) OVER (PARTITION BY gid), 6) + 0.0 AS val FROM W"


@query(_VAL + ", t AS (SELECT gid FROM W GROUP BY gid HAVING count(*) = 2) SELECT a.gid, a.part, b.part AS other, b.val AS received FROM W a JOIN W b USING (gid) JOIN t USING (gid) WHERE a.part <> b.part")
def exchange(spark, d):
    return par.exchange(_valued(spark, d), "val")


@query(_PAR + "ow AS (SELECT gid, row_number() OVER (ORDER BY part, gid) AS new_gid FROM OC WHERE part = master_part) SELECT part, gid, new_gid FROM OC JOIN ow USING (gid)")
def renumber_gids(spark, d):
    return par.renumber_gids(_copies(spark, d)[1])


@query(_PAR + "x AS (SELECT 1) SELECT part, master_part, count(*) AS n FROM OC WHERE part <> master_part GROUP BY ALL")
def comm_matrix(spark, d):
    return par.comm_matrix(_copies(spark, d)[1])


@query(_PAR + "x AS (SELECT 1) SELECT 'ghost_without_owner' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'several_owners', 0 UNION ALL SELECT 'val_differs', (SELECT count(*) FROM O WHERE k > 1)")
def parallel_check(spark, d):
    return par.check(_valued(spark, d), ["val"])


@query(_PAR + "x AS (SELECT 1) SELECT part, gid AS id, master_part, gid AS master_id FROM OC")
def weave_match(spark, d):
    m, c = _copies(spark, d)
    return par.match_points(c.join(m.V.select(F.col("vid").alias("gid"), "x", "y", "z"), "gid").select("part", F.col("gid").alias("id"), "x", "y", "z"))


# ---- modification ------------------------------------------------------------------------------------------------
@query(LOOP + """m AS (SELECT fid, pos, vid // 2 * 2 AS vid FROM FV),
k AS (SELECT fid, pos, vid, coalesce(lag(vid) OVER (PARTITION BY fid ORDER BY pos), last_value(vid) OVER (PARTITION BY fid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p FROM m),
c AS (SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY pos) - 1 AS pos, vid, count(*) OVER (PARTITION BY fid) AS n FROM k WHERE vid <> p) SELECT fid, pos, vid FROM c WHERE n >= 3""")
def merge_vertices(spark, d):
    """Vertices merged two by two, all of them."""
    m = ad.loops(spark, d)
    remap = m.V.select(F.col("vid").alias("old"), F.expr("vid div 2 * 2").alias("new")).where("old <> new")
    return mod.merge_vertices(m.V, m.FV, remap)[1].select("fid", *_long("pos"), "vid")


@query(QUAD + """c AS (SELECT eid, v0, v1, k FROM E, (SELECT unnest([1, 2]) AS k)), n AS (SELECT eid, k, v0, v1, (SELECT max(vid) FROM V) + row_number() OVER (ORDER BY eid, k) AS vid FROM c)
SELECT n.vid, round(a.x + k / 3.0::DOUBLE * (b.x - a.x), 6) AS x, round(a.y + k / 3.0::DOUBLE * (b.y - a.y), 6) AS y FROM n JOIN V a ON v0 = a.vid JOIN V b ON v1 = b.vid""")
def split_edges(spark, d):
    m = ad.grid(spark, d)
    v, _ = mod.split_edges(m, m.E.select("eid", F.lit(2).alias("n")))
    return _round(v.join(m.V.select("vid"), "vid", "left_anti").select("vid", "x", "y"), "x", "y")


@query(LOOP + "x AS (SELECT 1) SELECT (SELECT sum(n) FROM F)::BIGINT AS n_faces, (SELECT count(*) FROM V) + (SELECT count(*) FROM F) AS n_vertices")
def fan_split(spark, d):
    m = MeshFrame.from_faces(ad.loops(spark, d).V, settled(ad.loop_fv(spark, d)))
    v, fv = mod.fan_split(m, m.F.select("fid"))
    return fv.agg(F.count_distinct("fid").alias("n_faces")).crossJoin(v.agg(F.count("*").alias("n_vertices")))  # one row each


@query(TRI + """dg AS (SELECT 20 * j + i + 1 AS a, 20 * (j + 1) + i + 2 AS b, 20 * j + i + 2 AS c, 20 * (j + 1) + i + 1 AS e FROM F0) SELECT least(c, e) AS lo, greatest(c, e) AS hi FROM dg""")
def swap_edge(spark, d):
    m = ad.triangles(spark, d)
    two = m.FE.groupBy("eid").agg(F.min("fid").alias("a"), F.max("fid").alias("b")).where("b = a + 1 and a % 2 = 1").select("eid")  # the diagonal of every quad: no two have a triangle in common
    made = MeshFrame.from_faces(m.V, mod.swap_edges(m, two))
    return made.E.select("lo", "hi").join(m.E.select("lo", "hi"), ["lo", "hi"], "left_anti")


@query(QUAD + """s AS (SELECT fid, fid + 1 AS g FROM F0 WHERE j % 2 = 0 AND j + 1 < (SELECT ny FROM sz)) SELECT fid, 6::BIGINT AS n FROM s""")
def join_faces(spark, d):
    m = ad.grid(spark, d)
    _, ny = ad.grid_size(spark, d)
    pairs = m.FE.groupBy("eid").agg(F.min("fid").alias("a"), F.max("fid").alias("b")).where((F.col("b") == F.col("a") + 1) & (((F.col("a") - 1) % ny) % 2 == 0) & (((F.col("a") - 1) % ny) + 1 < ny)).select("eid")
    fv = mod.join_faces(m, pairs)
    return fv.groupBy("fid").agg(F.count("*").alias("n")).where("n = 6")


@query(TRI + """ends AS (SELECT eid, v0 AS v FROM E UNION ALL SELECT eid, v1 FROM E), lw AS (SELECT v, min(eid) AS low FROM ends GROUP BY v),
c AS (SELECT eid FROM E JOIN lw a ON v0 = a.v JOIN lw b ON v1 = b.v JOIN V p ON v0 = p.vid JOIN V q ON v1 = q.vid WHERE eid = a.low AND eid = b.low AND (p.gdim <> q.gdim OR p.gent = q.gent))
SELECT (SELECT count(*) FROM V) - (SELECT count(*) FROM c) AS n_vertices, (SELECT count(*) FROM F) - (SELECT count(*) FROM FE WHERE eid IN (SELECT eid FROM c)) AS n_faces""")
def collapse_edge(spark, d):
    """All edges are asked for; the operator takes those that don't meet one of a lower id."""
    m = ad.triangles(spark, d)
    v, fv, _ = mod.collapse_edges(m, m.E.select("eid"))
    return v.agg(F.count("*").alias("n_vertices")).crossJoin(fv.agg(F.count_distinct("fid").alias("n_faces")))  # one row each


# ---- graphs ------------------------------------------------------------------------------------------------------
@query(QUAD + "x AS (SELECT 1) SELECT vid AS node, ((vid - 1) % 20 + (vid - 1) // 20)::INTEGER AS level FROM V")
def bfs_levels(spark, d):
    m = ad.grid(spark, d)
    g = adj.vertex_neighbors(m).select(F.col("vid").alias("src"), F.col("nbr").alias("dst"))
    return gr.levels(g, spark.createDataFrame([(1,)], "node long"))


@query(QUAD + "x AS (SELECT 1) SELECT vid AS node, ((vid - 1) // 20 // 5 * 100 + 1)::BIGINT AS component FROM V")
def components(spark, d):
    m = ad.grid(spark, d)
    g = adj.vertex_neighbors(m).where("(vid - 1) div 100 = (nbr - 1) div 100").select(F.col("vid").alias("src"), F.col("nbr").alias("dst"))
    return gr.components(m.V.select(F.col("vid").alias("node")), g)


@query(QUAD + """c AS (SELECT fid AS id, avg(x) AS x, avg(y) AS y FROM FV JOIN V USING (vid) GROUP BY fid), a AS (SELECT id, x, y, (x > (SELECT quantile_cont(x, 0.5) FROM c))::INTEGER AS p FROM c),
m AS (SELECT p, quantile_cont(y, 0.5) AS cut FROM a GROUP BY p) SELECT id, 2 * p + (y > cut)::INTEGER AS part FROM a JOIN m USING (p)""")
def rcb_partition(spark, d):
    return gr.bisect(geo.centroids(ad.grid(spark, d)).select("id", "x", "y"), 2)


def renumber_levels(spark, d):
    m = ad.grid(spark, d)
    g = adj.vertex_neighbors(m).select(F.col("vid").alias("src"), F.col("nbr").alias("dst"))
    return gr.renumber_by_levels(m.V.select(F.col("vid").alias("node")), g, spark.createDataFrame([(1,)], "node long"))


QUERIES["renumber_levels"] = renumber_levels
