"""Queries over edits: lists, sets, attributes, loops and cells, whole meshes and copies on parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lists as ls
from ..functions import vectors as vx
from ..operators import adjacency as adj
from ..operators import attributes as att
from ..operators import geometry as geo
from ..operators import graph as gr
from ..operators import modify as mod
from ..operators import parallel as par
from ..operators import sets, simplex
from ..sources import surface, tables
from ..sources.records import write_lines
from . import adapters as ad
from .catalogue import _BOX, _PAR, _SETS, LOOP, QUAD, TRI, _copies, _long, _parted, _round, _sets, query
from .parted import _BOXP, _boxed, _file

# ---- lists -------------------------------------------------------------------------------------------------------
_LISTS = LOOP + "a AS (SELECT fid, list(vid ORDER BY pos) AS a FROM FV GROUP BY fid), l AS (SELECT fid, a, list_min(a) AS m, list_position(a, list_min(a)) AS p FROM a)"


def _lists(spark, d):
    rows = ad.loop_fv(spark, d).groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("a"))
    return rows.select("fid", "a", F.array_min("a").alias("m"))


def _text(df):
    return df.select("fid", *[F.array_join(c, ",").alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("long").alias(c) for c in df.columns if c != "fid"])


def _joined(**columns):
    return ", ".join(f"array_to_string({v}, ',') AS {k}" for k, v in columns.items())


@query(_LISTS + " SELECT fid, " + _joined(added="a || [0]", new="a", at_one="a[1:1] || [0] || a[2:]", before="a[1:p-1] || [0] || a[p:]", twice="a || a", sorted="list_sort(a)", turned="a[p:] || a[1:p-1]") + " FROM l")
def list_insertions(spark, d):
    a, m, zero = F.col("a"), F.col("m"), F.lit(0).cast("long")
    rows = _lists(spark, d).select("fid", ls.append(a, zero).alias("added"), ls.append_new(a, m).alias("new"), ls.insert_at(a, zero, 1).alias("at_one"), ls.insert_before(a, zero, m).alias("before"), ls.concatenate(a, a).alias("twice"), ls.ordered(a).alias("sorted"), ls.rotate(a, m).alias("turned"))
    return _text(rows)


@query(_LISTS + " SELECT fid, " + _joined(less_first="a[2:]", less="list_filter(a, lambda x: x <> m)", first_new="[0] || a[2:]", other="list_transform(a, lambda x: CASE WHEN x = m THEN 0 ELSE x END)") + " FROM l")
def list_removals(spark, d):
    a, m, zero = F.col("a"), F.col("m"), F.lit(0).cast("long")
    return _text(_lists(spark, d).select("fid", ls.remove_at(a, 0).alias("less_first"), ls.remove(a, m).alias("less"), ls.replace_at(a, 0, zero).alias("first_new"), ls.replace(a, m, zero).alias("other")))


@query(_LISTS + " SELECT fid, p - 1 AS place, list_contains(a, m)::BIGINT AS has, a[1] AS first, len(a)::BIGINT AS n, list_filter(a, lambda x: x > m)[1] AS above FROM l")
def list_lookups(spark, d):
    a, m = F.col("a"), F.col("m")
    return _text(_lists(spark, d).select("fid", ls.locate(a, m).alias("place"), ls.contains(a, m).cast("int").alias("has"), ls.entry(a, 0).alias("first"), ls.count(a).alias("n"), ls.search(a, lambda x: x > m).alias("above")))


# ---- sets --------------------------------------------------------------------------------------------------------
@query(_SETS + ", u AS (SELECT 'dear' AS name, count(*) AS n FROM b UNION ALL SELECT 'tiny', count(*) FROM a UNION ALL SELECT 'both', count(*) FROM a JOIN b USING (id)) SELECT name, n FROM u WHERE n > 0")
def set_lifecycle(spark, d):
    """Made, renamed, copied under a new name, and one dropped."""
    m = _sets(spark, d)
    m = sets.put(m, "both", 0, sets.intersect(sets.members(m, "small"), sets.members(m, "dear")))
    m = sets.put(sets.rename(m, "small", "tiny"), "gone", 0, sets.members(m, "dear"))
    m = sets.drop(m, "gone")
    return m.SD.join(m.SM, "set").groupBy(F.col("set").alias("name")).agg(F.count("*").alias("n"))


@query(_SETS + ", c AS (SELECT pos + 2 * (pos >= 1)::INTEGER AS pos, id FROM a UNION ALL SELECT 1, -1 UNION ALL SELECT 2, -2), e AS (SELECT pos - 1 AS pos, id FROM c WHERE pos > 0) SELECT pos, CASE WHEN pos = 2 THEN -5 WHEN id = -1 THEN -9 ELSE id END AS id FROM e")
def set_edits(spark, d):
    """Two members inserted at 1, the first removed, the one at 2 replaced, and one replaced by another."""
    m = _sets(spark, d)
    new = spark.createDataFrame([(0, -2), (0, -1)], "dim int, id long")
    a = sets.insert(sets.members(m, "small"), new.where("id = -1"), 1)
    a = sets.insert(a, new.where("id = -2"), 2)
    a = sets.replace_at(sets.remove_at(a, 0), 2, 0, -5)
    return sets.replace(a, (0, -1), (0, -9)).select(*_long("pos", "id"))


@query(_SETS + "SELECT id FROM a WHERE id NOT IN (SELECT id FROM b)")
def set_remove(spark, d):
    m = _sets(spark, d)
    return sets.remove_first(sets.members(m, "small"), sets.members(m, "dear").select("dim", "id")).select("id")


@query(_SETS + ", u AS (SELECT id FROM a UNION SELECT id FROM b), t AS (SELECT id FROM a UNION ALL SELECT id FROM b) SELECT 'checked' AS how, count(*) AS n FROM u UNION ALL SELECT 'plain', count(*) FROM t")
def set_add(spark, d):
    m = _sets(spark, d)
    a, b = sets.members(m, "small"), sets.members(m, "dear")
    return sets.add(a, b, unique=True).agg(F.count("*").alias("n")).select(F.lit("checked").alias("how"), "n").union(sets.add(a, b).agg(F.count("*").alias("n")).select(F.lit("plain"), "n"))


@query(QUAD + "s AS (SELECT p_partkey + 1 AS id FROM part WHERE p_size < 20) SELECT vid AS id, (vid IN (SELECT id FROM s))::INTEGER AS small FROM V")
def set_mark(spark, d):
    m = _sets(spark, d)
    marked = sets.mark(m.entities().where("dim = 0").select("dim", "id"), sets.members(m, "small"), "small")
    return sets.unmark(marked.withColumn("other", F.lit(True)), "other").select("id", F.col("small").cast("int").alias("small"))


# ---- attributes --------------------------------------------------------------------------------------------------
def _attributed(spark, d):
    m = ad.grid(spark, d)
    for name, kind, dim, n in (("size", "INT", 0, 1), ("stress", "TENSOR", 0, 4), ("face", "POINTER", 0, 1), ("unused", "DOUBLE", 2, 1)):
        m = att.define(m, name, kind, dim, n)
    size = ad.read(spark, d, "part").select(F.lit("size").alias("name"), F.lit(0).alias("dim"), (F.col("p_partkey") + 1).alias("id"), F.col("p_size").cast("int").alias("ival"))
    m = att.set_values(m, size.join(m.V.select(F.col("vid").alias("id")), "id", "left_semi"))
    m = att.set_vectors(m, m.V.select(F.lit("stress").alias("name"), F.lit(0).alias("dim"), F.col("vid").alias("id"), F.array("x", "y", "y", "x").alias("vval")))
    low = m.FV.groupBy(F.col("vid").alias("id")).agg(F.min("fid").alias("f"))
    return att.set_values(m, low.select(F.lit("face").alias("name"), F.lit(0).alias("dim"), "id", F.struct(F.lit(2).alias("dim"), F.col("f").alias("id")).alias("ref")))


@query("SELECT * FROM (VALUES ('face', 'POINTER', 0, 1), ('size', 'INT', 0, 1), ('stress', 'TENSOR', 0, 4)) t(name, atype, entdim, ncomp)")
def attr_definitions(spark, d):
    m = att.drop(_attributed(spark, d), "unused")
    return att.definitions(m).select("name", "atype", "entdim", "ncomp")


@query(QUAD + "s AS (SELECT p_partkey + 1 AS vid, p_size FROM part) SELECT vid AS id, (p_size IS NOT NULL)::INTEGER AS status, coalesce(p_size, 0)::INTEGER AS ival FROM V LEFT JOIN s USING (vid)")
def attr_get_int(spark, d):
    return att.get_values(_attributed(spark, d), "size", 0).select("id", "status", "ival")


@query(QUAD + "u AS (SELECT vid AS id, x, y, unnest([0, 1, 2, 3]) AS k FROM V) SELECT id, k, CASE WHEN k IN (0, 3) THEN x ELSE y END AS value FROM u")
def attr_get_tensor(spark, d):
    return att.get_values(_attributed(spark, d), "stress", 0).select("id", F.posexplode("vval").alias("k", "value"))


@query(QUAD + "x AS (SELECT 1) SELECT vid AS id, min(fid) AS face FROM FV GROUP BY vid")
def attr_get_pointer(spark, d):
    return att.get_values(_attributed(spark, d), "face", 0).select("id", F.col("ref.id").alias("face"))


@query(QUAD + "s AS (SELECT p_partkey + 1 AS vid, p_size FROM part) SELECT name, n, total FROM (SELECT 'size' AS name, count(*) AS n, 0::BIGINT AS total FROM V JOIN s USING (vid) WHERE gdim = 2 UNION ALL SELECT 'face', count(*), 0 FROM V WHERE gdim = 2 UNION ALL SELECT 'stress', count(*), 0 FROM V WHERE gdim = 2)")
def attr_clear_and_remove(spark, d):
    """All sizes cleared; vertices on the boundary lose all values."""
    m = att.clear_values(_attributed(spark, d), "size")
    m = att.remove_values(m, m.V.where("gdim < 2").select(F.lit(0).alias("dim"), F.col("vid").alias("id")))
    return m.AV.groupBy("name").agg(F.count("*").alias("n"), F.coalesce(F.sum("ival"), F.lit(0)).cast("long").alias("total"))


@query(QUAD + "s AS (SELECT p_partkey + 1 AS id, p_retailprice AS price FROM part) SELECT id, round(price, 4) AS dval FROM s WHERE id IN (SELECT vid FROM V)")
def import_attributes(spark, d):
    """A text file of vertex values, written and imported."""
    m = ad.grid(spark, d)
    price = ad.read(spark, d, "part").select((F.col("p_partkey") + 1).alias("id"), "p_retailprice").join(m.V.select(F.col("vid").alias("id")), "id", "left_semi")
    head = spark.createDataFrame([(0, 0, f"1\nprice NODE {price.count()}")], "sect int, ord long, line string")
    path = _file(spark, "price")
    write_lines(head.union(price.select(F.lit(1), "id", F.concat_ws(" ", "id", "p_retailprice"))), path)
    return _attribute(tables.import_attributes(m, path), "price")


def _attribute(m, name):
    return m.AV.where(F.col("name") == name).select("id", F.round("dval", 4).alias("dval"))


@query(QUAD + "s AS (SELECT p_partkey + 1 AS id FROM part WHERE p_size < 20) SELECT id FROM s WHERE id IN (SELECT vid FROM V)")
def import_sets(spark, d):
    m = ad.grid(spark, d)
    small = ad.read(spark, d, "part").where("p_size < 20").select((F.col("p_partkey") + 1).alias("id")).join(m.V.select(F.col("vid").alias("id")), "id", "left_semi")
    head = spark.createDataFrame([(0, 0, f"1\n4 NODE {small.count()}")], "sect int, ord long, line string")
    path = _file(spark, "sets")
    write_lines(head.union(small.select(F.lit(1), "id", F.col("id").cast("string"))), path)
    return sets.members(tables.import_sets(m, path), "nodeset_4").select("id")


# ---- whole meshes ------------------------------------------------------------------------------------------------
@query(QUAD + "x AS (SELECT 1) SELECT 0 AS dim, (SELECT count(*) FROM V) + (SELECT count(*) FROM part) AS n, (SELECT max(vid) FROM V) + (SELECT count(*) FROM part) AS last")
def mesh_add(spark, d):
    """A new vertex for every part, numbered on from the largest id."""
    m = ad.grid(spark, d)
    rows = ad.read(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(4).alias("gdim"), F.lit(0).cast("long").alias("gent"))
    return mod.add(m, 0, rows).V.agg(F.count("*").alias("n"), F.max("vid").alias("last")).select(F.lit(0).alias("dim"), "n", "last")


@query(QUAD + "g AS (SELECT fid FROM FV JOIN V USING (vid) GROUP BY fid HAVING max(z) > 1.05) SELECT fid, pos::BIGINT AS pos, eid FROM FE WHERE fid NOT IN (SELECT fid FROM g)")
def mesh_delete(spark, d):
    """Faces that reach above 1.05, deleted with their rows."""
    m = ad.grid(spark, d)
    high = m.FV.join(m.V, "vid").groupBy(F.col("fid").alias("id")).agg(F.max("z").alias("z")).where("z > 1.05").select("id")
    return mod.delete(m, 2, high).FE.select("fid", *_long("pos"), "eid")


@query(QUAD + "x AS (SELECT 1) SELECT vid, CASE WHEN z > 1 THEN x + 1 ELSE x END AS x, y, CASE WHEN z > 1 THEN 3 ELSE gdim END AS gdim, CASE WHEN z > 1 THEN vid ELSE gent END AS gent FROM V")
def mesh_update(spark, d):
    m = ad.grid(spark, d)
    new = m.V.where("z > 1").select(F.col("vid").alias("id"), (F.col("x") + 1).alias("x"), F.lit(3).alias("gdim"), F.col("vid").alias("gent"))
    return mod.update(m, 0, new).V.select("vid", "x", "y", "gdim", "gent")


@query(QUAD + "x AS (SELECT 1) SELECT vid, CASE WHEN z > 1 AND gdim < 2 THEN -1 ELSE 0 END AS dim FROM V")
def mesh_restore(spark, d):
    """High vertices flagged as deleted; those inside the surface restored."""
    m = ad.grid(spark, d)
    flagged = simplex.flag_deleted(m.V, "vid", m.V.where("z > 1").select(F.col("vid").alias("id")))
    back = simplex.restore(flagged, "vid", m.V.where("gdim = 2").select(F.col("vid").alias("id")))
    return simplex.dimension(back.withColumn("dim", F.lit(0))).select("vid", "dim")


@query(QUAD + "x AS (SELECT 1) SELECT 0 AS dim, count(*) AS n, min(vid) AS lo, max(vid) AS hi FROM V UNION ALL SELECT 1, count(*), min(eid), max(eid) FROM E UNION ALL SELECT 2, count(*), min(fid), max(fid) FROM F")
def mesh_copy(spark, d):
    m = _attributed(spark, d).copy(with_attributes=False)
    return m.entities().groupBy("dim").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))


@query(QUAD + "x AS (SELECT 1) SELECT fid, pos::BIGINT AS pos, x, y, z FROM FV JOIN V USING (vid)")
def face_coordinates(spark, d):
    rows = geo.face_coordinates(ad.grid(spark, d)).select("fid", F.posexplode("xyz").alias("pos", "p"))
    return rows.select("fid", *_long("pos"), *[F.col("p")[i].alias(c) for i, c in enumerate("xyz")])


@query(QUAD + "x AS (SELECT 1) SELECT 'OFF' AS line UNION ALL SELECT concat((SELECT count(*) FROM V), ' ', (SELECT count(*) FROM F), ' 0') UNION ALL SELECT concat(x, ' ', y, ' 0.0') FROM V UNION ALL SELECT concat(count(*), ' ', string_agg(vid - 1, ' ' ORDER BY pos)) FROM FV GROUP BY fid")
def off_lines(spark, d):
    return surface.off_lines(ad.grid(spark, d, flat=True)).select("line")


@query(TRI + "x AS (SELECT 1) SELECT 'endsolid' AS word, 1::BIGINT AS n UNION ALL SELECT 'facet', count(*) FROM F UNION ALL SELECT 'solid', 1")
def stl_facets(spark, d):
    return surface.stl_lines(ad.triangles(spark, d)).select(F.split(F.trim("line"), " ")[0].alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# ---- loops, cells, incidence ---------------------------------------------------------------------------------------
@query(LOOP + "top AS (SELECT fid, max(vid) AS vid FROM FV GROUP BY fid) SELECT FV.fid, FV.pos::BIGINT AS pos, CASE WHEN FV.vid = top.vid THEN -FV.fid ELSE FV.vid END AS vid FROM FV JOIN top USING (fid)")
def loop_replace_vertex(spark, d):
    fv = ad.loop_fv(spark, d)
    asked = fv.groupBy("fid").agg(F.max("vid").alias("old")).withColumn("new", -F.col("fid"))
    return mod.replace_vertex(fv, "fid", asked).select("fid", *_long("pos"), "vid")


@query(LOOP + "x AS (SELECT 1) SELECT fid, (pos + (pos >= 1)::INTEGER)::BIGINT AS pos, vid FROM FV UNION ALL SELECT fid, 1, -fid FROM F")
def loop_insert_vertex(spark, d):
    fv = ad.loop_fv(spark, d)
    return mod.insert_vertex(fv, fv.select("fid").distinct().select("fid", F.lit(1).alias("at"), (-F.col("fid")).alias("new"))).select("fid", *_long("pos"), "vid")


@query(LOOP + "m AS (SELECT fid, min(eid) AS e FROM FE GROUP BY fid) SELECT FE.fid, row_number() OVER (PARTITION BY FE.fid ORDER BY pos) - 1 AS pos, eid FROM FE JOIN m USING (fid) WHERE eid <> e")
def face_remove_edge(spark, d):
    m = ad.loops(spark, d, settle=True).settled("FE")
    return mod.remove_use(m.FE, "fid", "eid", m.FE.groupBy("fid").agg(F.min("eid").alias("eid"))).select("fid", *_long("pos"), "eid")


@query(LOOP + "x AS (SELECT 1) SELECT fid, pos::BIGINT AS pos, CASE WHEN pos = 0 THEN -fid ELSE eid END AS eid FROM FE")
def face_replace_edges(spark, d):
    """The first edge of every face replaced by another."""
    m = ad.loops(spark, d)
    asked = m.F.select("fid", F.lit(0).alias("at"), F.lit(1).alias("n"))
    new = m.F.select("fid", F.lit(0).alias("k"), (-F.col("fid")).alias("eid"), F.lit(1).alias("dir"))
    return mod.replace_run(m.FE, "fid", asked, new).select("fid", *_long("pos"), "eid")


@query(LOOP + "b AS (SELECT fid, max(CASE WHEN pos = 0 THEN vid END) AS a, max(CASE WHEN pos = 2 THEN vid END) AS c, count(*) AS n FROM FV GROUP BY fid) SELECT FV.fid, count(*) AS n FROM FV JOIN b USING (fid) WHERE b.n < 4 OR pos <= 2 GROUP BY FV.fid UNION ALL SELECT -fid, n - 1 FROM b WHERE n >= 4")
def face_split_along_edge(spark, d):
    """Loops of four and more cut from their first to their third vertex. The rest of loop ``fid`` is ``-fid - 1`` while it is
    cut (``-fid`` would be the id of both parts of loop 0), and shown as ``-fid``."""
    fv = ad.loop_fv(spark, d)
    at = lambda p: F.max(F.when(F.col("pos") == p, F.col("vid")))
    asked = fv.groupBy("fid").agg(at(0).alias("a"), at(2).alias("b"), F.count("*").alias("n")).where("n >= 4").select("fid", "a", "b", (-F.col("fid") - 1).alias("new"))
    made = mod.split_face(fv, asked).groupBy("fid").agg(F.count("*").alias("n"))
    return made.select(F.when(F.col("fid") < 0, F.col("fid") + 1).otherwise(F.col("fid")).alias("fid"), "n")


@query(LOOP + "x AS (SELECT 1) SELECT fid, pos::BIGINT AS pos, eid, CASE WHEN pos = 0 THEN 1 - dir ELSE dir END AS dir FROM FE")
def face_reverse_edge(spark, d):
    m = ad.loops(spark, d)
    return mod.reverse_edge(m.FE, m.FE.where("pos = 0")).select("fid", *_long("pos"), "eid", "dir")


@query(LOOP + "q AS (SELECT fid, min(eid) AS eid FROM FE GROUP BY fid) SELECT q.fid, q.eid, dir FROM q JOIN FE USING (fid, eid) UNION ALL SELECT fid, -1, -1 FROM q")
def edge_directions(spark, d):
    m = ad.loops(spark, d, settle=True).settled("FE")
    asked = m.FE.groupBy("fid").agg(F.min("eid").alias("eid"))
    return adj.edge_direction(m, asked.union(asked.select("fid", F.lit(-1).cast("long"))))


@query(LOOP + "x AS (SELECT 1) SELECT n, count(*) AS faces FROM F GROUP BY n")
def face_edge_counts(spark, d):
    return adj.degree(adj.face_edges(ad.loops(spark, d)), "fid", "eid").groupBy("n").agg(F.count("*").alias("faces"))


@query(LOOP + "p AS (SELECT DISTINCT a.fid, b.fid AS nbr FROM FE a JOIN FE b USING (eid) WHERE a.fid <> b.fid) SELECT fid, count(*) AS n FROM p GROUP BY fid")
def face_neighbor_counts(spark, d):
    return adj.degree(adj.face_neighbors(ad.loops(spark, d)), "fid", "nbr")


@query(LOOP + "g AS (SELECT fid AS grp, eid FROM FE WHERE pos < 2) SELECT grp, FE.fid FROM g JOIN FE USING (eid) GROUP BY grp, FE.fid HAVING count(DISTINCT eid) = 2")
def edges_common_face(spark, d):
    """The faces that have both of the first two edges of a face."""
    m = ad.loops(spark, d).settled("FE")
    return adj.containing(m.FE, "fid", "eid", m.FE.where("pos < 2").select(F.col("fid").alias("grp"), "eid"))


_BOXE = _BOX + """BFV AS (SELECT fid, unnest(loop) AS vid, generate_subscripts(loop, 1) AS pos FROM U JOIN F1 ON U.key = F1.key AND U.rid = F1.rid),
BH AS (SELECT fid, vid AS a, coalesce(lead(vid) OVER w, first_value(vid) OVER w) AS b FROM BFV WINDOW w AS (PARTITION BY fid ORDER BY pos)),
BE AS (SELECT row_number() OVER (ORDER BY lo, hi) AS eid, lo, hi FROM (SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM BH)),
BFE AS (SELECT DISTINCT fid, eid FROM BH JOIN BE ON lo = least(a, b) AND hi = greatest(a, b)),"""


@query(_BOXE + "x AS (SELECT 1) SELECT eid, list_sort(list(DISTINCT rid))::VARCHAR AS ids FROM BFE JOIN RF USING (fid) GROUP BY eid")
def edge_region_ids(spark, d):
    got = adj.ids(adj.edge_regions(ad.box(spark, d)), "eid", "rid")
    return got.select("eid", F.concat(F.lit("["), F.array_join("ids", ", "), F.lit("]")).alias("ids"))


@query(_BOXE + "x AS (SELECT 1) SELECT rid, count(DISTINCT eid) AS n, min(eid) AS lo, max(eid) AS hi FROM BFE JOIN RF USING (fid) GROUP BY rid")
def region_edge_ids(spark, d):
    return adj.region_edges(ad.box(spark, d)).groupBy("rid").agg(F.count("*").alias("n"), F.min("eid").alias("lo"), F.max("eid").alias("hi"))


@query(_BOX + "x AS (SELECT 1) SELECT rid, vid + 1 AS vid FROM RV WHERE (rid, vid + 1) IN (SELECT (rid, vid) FROM RV)")
def region_uses_vertex(spark, d):
    """Of every cell's vertices, those whose successors by id the cell has as well."""
    m = ad.box(spark, d)
    return adj.uses(m.RV.select("rid", "vid"), m.RV.select("rid", (F.col("vid") + 1).alias("vid")))


@query(_BOX + "x AS (SELECT 1) SELECT rid, fid, dir FROM RF UNION ALL SELECT rid, -1, -1 FROM R")
def face_directions(spark, d):
    m = ad.box(spark, d)
    return adj.face_direction(m, m.RF.select("rid", "fid").union(m.R.select("rid", F.lit(-1).cast("long"))))


@query(_BOX + "x AS (SELECT 1) SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY pos) - 1 AS pos, fid FROM RF WHERE pos <> 0")
def region_remove_face(spark, d):
    m = ad.box(spark, d)
    return mod.remove_use(m.RF, "rid", "fid", m.RF.where("pos = 0")).select("rid", *_long("pos"), "fid")


@query(_BOX + "x AS (SELECT 1) SELECT rid, pos::BIGINT AS pos, CASE WHEN pos = 7 THEN -rid ELSE vid END AS vid FROM RV")
def region_replace_vertex(spark, d):
    m = ad.box(spark, d)
    asked = m.RV.where("pos = 7").select("rid", F.col("vid").alias("old"), (-F.col("rid")).alias("new"))
    return mod.replace_vertex(m.RV, "rid", asked).select("rid", *_long("pos"), "vid")


# ---- vectors -----------------------------------------------------------------------------------------------------
@query(QUAD + """p AS (SELECT eid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz FROM E JOIN V a ON v0 = a.vid JOIN V b ON v1 = b.vid)
SELECT eid, round(ax - bx + 2 * (ax + bx) - az, 6) + 0.0 AS mixed, round(ax * bx + ay * b_y + az * bz, 6) + 0.0 AS inner_, round(ay * bz - az * b_y, 6) + 0.0 AS cross_x, round(sqrt(ax * ax + ay * ay + az * az), 6) + 0.0 AS len, round(az / sqrt(ax * ax + ay * ay + az * az), 6) + 0.0 AS unit_z FROM p""")
def vector_algebra(spark, d):
    m = ad.grid(spark, d)
    p = lambda v, c: m.V.select(F.col("vid").alias(v), vx.vec("x", "y", "z").alias(c))
    e = m.E.select("eid", "v0", "v1").join(p("v0", "a"), "v0").join(p("v1", "b"), "v1")
    a, b = F.col("a"), F.col("b")
    mixed = vx.add(vx.diff(a, b), vx.scale(vx.add(a, b), 2.0))[0] + vx.negate(a)[2]
    return _round(e.select("eid", mixed.alias("mixed"), vx.dot(a, b).alias("inner_"), vx.cross(a, b)[0].alias("cross_x"), vx.length(a).alias("len"), vx.normalize(a)[2].alias("unit_z")), "mixed", "inner_", "cross_x", "len", "unit_z")


# ---- parts -------------------------------------------------------------------------------------------------------
@query(_PAR + "x AS (SELECT 1) SELECT part, gid, x, y FROM OC JOIN V ON gid = vid")
def update_ghost_coordinates(spark, d):
    """Ghosts whose coordinates went astray get their owners' again."""
    m, c = _copies(spark, d)
    at = c.join(m.V.select(F.col("vid").alias("gid"), "x", "y"), "gid")
    astray = at.select("gid", "part", "master_part", *[F.when(F.col("part") == F.col("master_part"), F.col(k)).otherwise(-1.0).alias(k) for k in "xy"])
    return par.update_ghosts(astray, ["x", "y"]).select("part", "gid", "x", "y")


@query(
    _BOXP
    + """OG AS (SELECT DISTINCT master_part AS part, gid FROM G), g3 AS (SELECT part, gid, row_number() OVER (PARTITION BY part ORDER BY gid) AS r FROM G),
o3 AS (SELECT part, gid, row_number() OVER (PARTITION BY part ORDER BY gid) AS r FROM OG)
SELECT 'ghost' AS kind, part, count(*) AS n, max(CASE WHEN r = 3 THEN gid END) AS third FROM g3 GROUP BY part
UNION ALL SELECT 'overlap', part, count(*), max(CASE WHEN r = 3 THEN gid END) FROM o3 GROUP BY part"""
)
def ghost_and_overlap_lists(spark, d):
    """How many ghost and overlap cells each part has, and the third of each in the order of ids."""
    m, parts = _boxed(spark, d)
    cells = par.label_cells(parts, par.ghost_cells(m.RV, parts, key="rid"))
    out = None
    for name, kind in (("ghost", par.GHOST), ("overlap", par.OVERLAP)):
        row = par.counts(cells, kind).join(par.at(cells, kind, 2).select("part", F.col("gid").alias("third")), "part", "left").select(F.lit(name).alias("kind"), "part", "n", "third")
        out = row if out is None else out.union(row)
    return out


@query(_PAR + "s AS (SELECT p_partkey + 1 AS gid, p_size FROM part) SELECT part, gid, p_size AS val FROM OC JOIN s USING (gid)")
def copy_values(spark, d):
    _, c = _copies(spark, d)
    return par.copy_values(ad.read(spark, d, "part").select((F.col("p_partkey") + 1).alias("gid"), F.col("p_size").alias("val")), c).select("part", "gid", "val")


@query(_BOXP + "cc AS (SELECT rid AS id, l AS z, i, j FROM R) SELECT cc.id, b.part FROM cc JOIN (SELECT i, j, arg_min(part, (z, P.id)) AS part FROM cc JOIN P ON cc.id = P.id GROUP BY i, j) b USING (i, j)")
def columns_together(spark, d):
    m, parts = _boxed(spark, d)
    centres = geo.centroids(m, solid=True)
    return gr.columns_together(parts, centres)


@query(_PAR + "x AS (SELECT 1) SELECT 'second ring' AS what, part, count(*) AS n FROM (SELECT DISTINCT c.part, FV.fid FROM (SELECT DISTINCT L.part, FV.vid FROM (SELECT part, id AS fid FROM P UNION SELECT part, gid FROM G) L JOIN FV USING (fid)) c JOIN FV USING (vid) JOIN P ON FV.fid = P.id WHERE P.part <> c.part) GROUP BY part")
def ghost_two_layers(spark, d):
    m, parts = _parted(spark, d)
    return par.ghost_cells(m.FV, parts, layers=2).groupBy("part").agg(F.count("*").alias("n")).select(F.lit("second ring").alias("what"), "part", "n")
