"""Queries over files, global ids, distribution, merging and inference, beside those of ``catalogue``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frame import half_edges
from ..operators import adjacency as adj
from ..operators import classify as cls
from ..operators import distribute as dis
from ..operators import graph as gr
from ..operators import modify as mod
from ..operators import parallel as par
from ..sources import exodus, formats, native
from ..working import shared_dir
from . import adapters as ad
from .catalogue import _BOX, _PAR, LOOP, PARTS, QUAD, QUERIES, _parted, query


def _file(spark, name):
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}/{name}"


# ---- files -------------------------------------------------------------------------------------------------------
def _back(name):
    def run(spark, d):
        path = _file(spark, name)
        formats.write(ad.grid(spark, d), path)
        return formats.read(spark, path).FV.select("fid", F.col("pos").cast("long").alias("pos"), "vid")

    return run


for _name, _path in (("native_round_trip", "grid"), ("gmv_round_trip", "grid.gmv")):
    _back_of = _back(_path)
    _back_of.__name__ = _name
    query(QUAD + "x AS (SELECT 1) SELECT fid, pos::BIGINT AS pos, vid FROM FV")(_back_of)


@query(QUAD + "x AS (SELECT 1) SELECT vid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM V")
def native_vertices_back(spark, d):
    path = _file(spark, "grid")
    native.write_mesh(ad.grid(spark, d), path, formats.HEADER)
    return formats.read(spark, path).V.select("vid", *[F.round(c, 9).alias(c) for c in "xyz"])


@query(_BOX + "x AS (SELECT 1) SELECT rid, count(*) AS n_faces, sum(dir)::BIGINT AS outward FROM RF GROUP BY rid")
def x3d_round_trip(spark, d):
    """Directions may differ where a face is first listed by the other cell; their numbers can't."""
    path = _file(spark, "box.x3d")
    formats.write(ad.box(spark, d), path)
    return formats.read(spark, path).RF.groupBy("rid").agg(F.count("*").alias("n_faces"), F.sum("dir").cast("long").alias("outward"))


#: Cells of an Exodus file: one task writes a file, and one reads it.
CELLS = 1 << 14


def _box_files(spark, d):
    """Files of the box in parts of ``CELLS`` cells, however many these are."""
    m = ad.box(spark, d)
    folder = _file(spark, "box.exo").rpartition("/")[0]
    done = exodus.write_exodus(m, folder, "box", m.R.select(F.col("rid").alias("id"), F.expr(f"(rid - 1) div {CELLS}").cast("int").alias("part")))
    return [f"file://{r[0]}" if folder.startswith("file://") else r[0] for r in done.select("path").collect()]  # one row a file


@query(_BOX + "x AS (SELECT 1) SELECT rid, pos, vid FROM RV")
def exodus_round_trip(spark, d):
    """Cells are numbered block by block (material by material) in a file; its map has the ids."""
    return exodus.read_parts(spark, _box_files(spark, d)).RV.select("rid", F.col("pos").cast("long").alias("pos"), "vid")


@query(_BOX + "x AS (SELECT 1) SELECT a.rid AS src, b.rid AS dst FROM RF a JOIN RF b USING (fid) WHERE a.rid <> b.rid")
def exodus_element_graph(spark, d):
    return exodus.element_graph(spark, _box_files(spark, d))[0]


# ---- global ids and distribution -----------------------------------------------------------------------------------
@query(QUAD + "x AS (SELECT 1) SELECT 3 * vid AS gid, vid, x, y FROM V WHERE 3 * vid IN (SELECT s_suppkey FROM supplier)")
def gid_lookup(spark, d):
    m = ad.grid(spark, d)
    m = dis.set_global_ids(m, 0, m.V.select(F.col("vid").alias("id"), (3 * F.col("vid")).alias("gid")))
    return dis.from_global_ids(m, 0, ad.read(spark, d, "supplier").select(F.col("s_suppkey").alias("gid"))).select("gid", "vid", "x", "y")


_BOXP = _BOX + f"""P AS (SELECT rid AS id, least((row_number() OVER (ORDER BY rid) - 1) // greatest(1, (SELECT count(*) FROM R) // {PARTS}), {PARTS - 1})::INTEGER AS part FROM R),
C AS (SELECT DISTINCT part, vid FROM RV JOIN P ON rid = id),
G AS (SELECT DISTINCT C.part, RV.rid AS gid, P.part AS master_part FROM C JOIN RV USING (vid) JOIN P ON RV.rid = P.id WHERE C.part <> P.part),
L AS (SELECT part, id AS rid, true AS own FROM P UNION ALL SELECT part, gid, false FROM G),
DV AS (SELECT part, vid AS gid, max(own) AS own FROM RV JOIN L USING (rid) GROUP BY ALL), MV AS (SELECT gid, min(part) FILTER (own) AS mp, count(*) AS k FROM DV GROUP BY gid),
DF AS (SELECT part, fid AS gid, max(own) AS own FROM RF JOIN L USING (rid) GROUP BY ALL), MF AS (SELECT gid, min(part) FILTER (own) AS mp, count(*) AS k FROM DF GROUP BY gid),"""


def _boxed(spark, d):
    m = ad.box(spark, d)
    return m, par.strips(m.R.select(F.col("rid").alias("id")), PARTS)


@query(_BOXP + "x AS (SELECT 1) SELECT part, gid, master_part FROM G")
def ghost_cells_solid(spark, d):
    m, parts = _boxed(spark, d)
    return par.ghost_cells(m.RV, parts, key="rid")


@query(
    _BOXP
    + """OG AS (SELECT DISTINCT gid FROM G)
SELECT 3 AS dim, part, CASE WHEN NOT own THEN 3 WHEN rid IN (SELECT gid FROM OG) THEN 1 ELSE 0 END AS ptype, count(*) AS n FROM L GROUP BY ALL
UNION ALL SELECT 0, part, CASE WHEN part <> mp THEN 3 WHEN k > 1 THEN 1 ELSE 0 END, count(*) FROM DV JOIN MV USING (gid) GROUP BY ALL
UNION ALL SELECT 2, part, CASE WHEN part <> mp THEN 3 WHEN k > 1 THEN 1 ELSE 0 END, count(*) FROM DF JOIN MF USING (gid) GROUP BY ALL"""
)
def distribute_solid(spark, d):
    return dis.labelled_counts(dis.distribute(*_boxed(spark, d))).where("dim <> 1")


@query(_BOXP + "OG AS (SELECT DISTINCT master_part AS part, gid AS rid FROM G) SELECT part, count(DISTINCT OG.rid) AS n_cells, count(DISTINCT vid) AS n_vertices FROM OG JOIN RV USING (rid) GROUP BY part")
def overlap_submesh(spark, d):
    s = dis.distribute(*_boxed(spark, d)).submesh()
    return s.tables["R"].groupBy("part").agg(F.count("*").alias("n_cells")).join(s.tables["V"].groupBy("part").agg(F.count("*").alias("n_vertices")), "part")


@query(
    _PAR
    + """L AS (SELECT part, id AS fid, true AS own FROM P UNION ALL SELECT part, gid, false FROM G), D AS (SELECT part, vid AS gid, max(own) AS own FROM FV JOIN L USING (fid) GROUP BY ALL),
M AS (SELECT gid, min(part) FILTER (own) AS mp, count(*) AS k FROM D GROUP BY gid), OV AS (SELECT DISTINCT gid FROM G)
SELECT 2 AS dim, part, CASE WHEN NOT own THEN 3 WHEN fid IN (SELECT gid FROM OV) THEN 1 ELSE 0 END AS ptype, count(*) AS n FROM L GROUP BY ALL
UNION ALL SELECT 0, part, CASE WHEN part <> mp THEN 3 WHEN k > 1 THEN 1 ELSE 0 END, count(*) FROM D JOIN M USING (gid) GROUP BY ALL"""
)
def weave_parts(spark, d):
    """The grid cut into parts that know nothing of each other but the places of their vertices, and connected again."""
    m, parts = _parted(spark, d)
    loops = m.FV.join(parts.withColumnRenamed("id", "fid"), "fid").select("part", "fid", "pos", "vid")
    v = loops.select("part", "vid").distinct().join(m.V, "vid").select("part", "vid", "x", "y", "z")
    return dis.labelled_counts(dis.weave(v, loops)).where("dim in (0, 2)")


@query(QUAD + """c AS (SELECT fid AS id, avg(x) AS x, avg(y) AS y FROM FV JOIN V USING (vid) GROUP BY fid), a AS (SELECT id, y, (row_number() OVER (ORDER BY x, id) > (SELECT count(*) FROM c) // 2)::INTEGER AS p FROM c),
m AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY y, id) > count(*) OVER (PARTITION BY p) // 2 AS up FROM a) SELECT 2 * p + up::INTEGER AS part, count(*) AS n FROM m GROUP BY ALL""")
def read_distribute(spark, d):
    """A file read, bisected and dealt out; how many elements each part owns."""
    path = _file(spark, "grid")
    formats.write(ad.grid(spark, d), path)
    p = dis.read_distributed(spark, path, 4)
    return p.tables["F"].where("part = master_part").groupBy("part").agg(F.count("*").alias("n"))


# ---- small adjacency, merging, joining -----------------------------------------------------------------------------
@query(LOOP + "x AS (SELECT 1) SELECT eid, v0 AS vid, v1 AS opp FROM E UNION ALL SELECT eid, v1, v0 FROM E")
def opposite_vertex(spark, d):
    m = ad.loops(spark, d)
    return adj.opposite_vertex(m, adj.edge_vertices(m).select("eid", "vid"))


def _sides(spark, d):
    """The loop mesh with an edge of its own for each side of each face."""
    m = ad.loops(spark, d)
    h = half_edges(m.FV).select((F.col("fid") * 1000 + F.col("pos")).alias("eid"), "fid", "pos", "v0", "v1")
    e = h.select("eid", "v0", "v1", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"), F.lit(2).alias("gdim"), F.lit(1).cast("long").alias("gent"))
    return m.with_tables(E=e, FE=h.select("fid", "pos", "eid", F.lit(1).alias("dir")))


_SIDES = LOOP + "S AS (SELECT fid * 1000 + pos AS eid, fid, pos, v0, v1, least(v0, v1) AS lo, greatest(v0, v1) AS hi FROM H), M AS (SELECT *, min(eid) OVER (PARTITION BY lo, hi) AS same, count(*) OVER (PARTITION BY lo, hi) AS c FROM S)"


@query(_SIDES + " SELECT eid, same FROM M WHERE c > 1")
def same_edges(spark, d):
    return adj.same_edges(_sides(spark, d))


@query(_SIDES + " SELECT M.fid, M.pos::BIGINT AS pos, same AS eid, (M.v0 = S.v0)::INTEGER AS dir FROM M JOIN S ON same = S.eid")
def merge_edges(spark, d):
    m = _sides(spark, d)
    pairs = adj.same_edges(m).where("eid <> same").select(F.col("eid").alias("old"), F.col("same").alias("new"))
    return mod.merge_edges(m, pairs).FE.select("fid", F.col("pos").cast("long").alias("pos"), "eid", "dir")


@query(LOOP + "k AS (SELECT fid, string_agg(vid, ',' ORDER BY vid) AS key FROM FV GROUP BY fid) SELECT min(fid) AS fid FROM k GROUP BY key")
def merge_faces(spark, d):
    m = ad.loops(spark, d)
    pairs = adj.same_faces(m).where("fid <> same").select(F.col("fid").alias("old"), F.col("same").alias("new"))
    return mod.merge_faces(m, pairs, topology=False).F.select("fid")


@query(_BOX + "x AS (SELECT 1) SELECT rid, fid, 1 - dir AS dir FROM RF")
def reverse_faces(spark, d):
    m = ad.box(spark, d)
    return mod.reverse_faces(m, m.F.select("fid")).RF.select("rid", "fid", "dir")


@query(_BOX + "x AS (SELECT 1) SELECT DISTINCT (i * ny + j) * nz + 1 AS rid, 4 * nz + 2 AS n FROM R, sz")
def join_regions_chain(spark, d):
    """All cells above each other are joined into one column."""
    m = ad.box(spark, d)
    level = m.RF.where("pos < 2").select("fid").distinct()
    return mod.join_regions(m, level).groupBy("rid").agg(F.count("*").alias("n"))


# ---- classification ------------------------------------------------------------------------------------------------
@query(_BOX + "s AS (SELECT ny * nz AS n, 2 AS k FROM sz UNION ALL SELECT nx * nz, 2 FROM sz UNION ALL SELECT nx * ny, 2 FROM sz) SELECT n, sum(k)::BIGINT AS surfaces FROM s GROUP BY n")
def classify_sharp(spark, d):
    """The outer surface of a box of one material, cut along its sharp edges: how many pieces have how many faces."""
    m = ad.box(spark, d)
    m = m.with_tables(R=m.R.withColumn("gent", F.lit(1).cast("long")))
    faces = cls.classify_faces(m, geometry=True).where("gdim = 2")
    return faces.groupBy("gent").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("surfaces"))


@query(QUAD + "i AS (SELECT fid, max(gdim) AS dim FROM FV JOIN V USING (vid) GROUP BY fid) SELECT fid, CASE WHEN dim = 2 THEN 2 ELSE 4 END AS gdim, CASE WHEN dim = 2 THEN 1 ELSE 0 END::BIGINT AS gent FROM i")
def infer_face_class(spark, d):
    return cls.infer_face_class(ad.grid(spark, d))


@query(_BOX + "x AS (SELECT 1) SELECT rid, CASE WHEN bool_or(other IS NOT NULL) THEN 3 ELSE 4 END AS gdim, CASE WHEN bool_or(other IS NOT NULL) THEN 1 ELSE 0 END::BIGINT AS gent FROM (SELECT a.rid, b.rid AS other FROM RF a LEFT JOIN RF b ON a.fid = b.fid AND a.rid <> b.rid) GROUP BY rid")
def infer_region_class(spark, d):
    """Cells of one material, from their inner faces."""
    m = ad.box(spark, d)
    m = m.with_tables(R=m.R.withColumn("gent", F.lit(1).cast("long")))
    f = m.F.drop("gdim", "gent").join(cls.classify_faces(m), "fid").select(*m.F.columns)
    return cls.infer_region_class(m.with_tables(F=f))


@query(
    LOOP
    + """t AS (SELECT vid, eid, count(*) AS k, sum(2 * dir - 1) AS s FROM (SELECT FE.eid, FE.dir, unnest([v0, v1]) AS vid FROM FE JOIN E USING (eid)) GROUP BY vid, eid)
SELECT 'open_ring_at_surface_vertex' AS rule, (SELECT count(DISTINCT vid) FROM t WHERE k <> 2) AS violations
UNION ALL SELECT 'ring_not_oriented_alike', (SELECT count(DISTINCT vid) FROM t WHERE k = 2 AND s <> 0)
UNION ALL SELECT 'surface_vertex_without_face', (SELECT count(*) FROM V WHERE vid NOT IN (SELECT vid FROM FV))"""
)
def check_rings(spark, d):
    """Loops of parts close no surface: most rings are open."""
    return cls.check(ad.loops(spark, d, settle=True), ["open_ring_at_surface_vertex", "ring_not_oriented_alike", "surface_vertex_without_face"])


def profile_numbering(spark, d):
    """Rows only: the numbering depends on ties that SQL would have to follow step by step."""
    m = ad.grid(spark, d)
    g = adj.vertex_neighbors(m).select(F.col("vid").alias("src"), F.col("nbr").alias("dst"))
    return gr.renumber_profile(m.V.select(F.col("vid").alias("node")), g)


QUERIES["profile_numbering"] = profile_numbering
