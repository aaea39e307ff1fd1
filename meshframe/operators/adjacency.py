"""Incidence queries between the four kinds of entities, for all entities at once.

Each returns one row per pair; filter by id for one entity. Upward lists have no order, downward ones have ``pos``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame
from ..working import settled


def vertex_neighbors(m: MeshFrame) -> DataFrame:
    """``vid, nbr``: vertices one edge away."""
    return m.E.select(F.explode(F.array(F.struct(F.col("v0").alias("vid"), F.col("v1").alias("nbr")), F.struct(F.col("v1").alias("vid"), F.col("v0").alias("nbr")))).alias("p")).select("p.*")


def vertex_edges(m: MeshFrame) -> DataFrame:
    return m.E.select("eid", F.explode(F.array("v0", "v1")).alias("vid")).select("vid", "eid").distinct()


def vertex_faces(m: MeshFrame) -> DataFrame:
    return m.FV.select("vid", "fid").distinct()


def vertex_regions(m: MeshFrame) -> DataFrame:
    return m.RF.join(m.FV, "fid").select("vid", "rid").distinct()


def edge_vertices(m: MeshFrame) -> DataFrame:
    return m.E.select("eid", F.posexplode(F.array("v0", "v1")).alias("pos", "vid"))


def edge_faces(m: MeshFrame) -> DataFrame:
    return m.FE.select("eid", "fid", "dir")


def edge_regions(m: MeshFrame) -> DataFrame:
    return m.FE.join(m.RF.select("fid", "rid"), "fid").select("eid", "rid").distinct()


def face_edges(m: MeshFrame) -> DataFrame:
    return m.FE.select("fid", "pos", "eid", "dir")


def face_neighbors(m: MeshFrame) -> DataFrame:
    """``fid, nbr, eid``: once for each shared edge; an edge of more than two faces pairs them all."""
    a, b = m.FE.select("eid", "fid"), m.FE.select("eid", F.col("fid").alias("nbr"))
    return a.join(b, "eid").where("fid <> nbr").select("fid", "nbr", "eid")


def non_manifold_edges(m: MeshFrame) -> DataFrame:
    """``eid, n`` of edges with more than two faces."""
    return m.FE.groupBy("eid").agg(F.count("*").alias("n")).where("n > 2")


def face_regions(m: MeshFrame) -> DataFrame:
    """``fid, side, rid``: a region that uses the face outwards (direction 1) lies on side 0."""
    return m.RF.select("fid", (1 - F.col("dir")).alias("side"), "rid")


def region_vertices(m: MeshFrame) -> DataFrame:
    return m.RV.select("rid", "pos", "vid")


def region_edges(m: MeshFrame) -> DataFrame:
    return m.RF.select("rid", "fid").join(m.FE, "fid").select("rid", "eid").distinct()


def region_faces(m: MeshFrame) -> DataFrame:
    return m.RF.select("rid", "pos", "fid", "dir")


def region_neighbors(m: MeshFrame) -> DataFrame:
    a, b = m.RF.select("fid", "rid"), m.RF.select("fid", F.col("rid").alias("nbr"))
    return a.join(b, "fid").where("rid <> nbr").select("rid", "nbr", "fid")


def degree(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """``key, n``: distinct partners."""
    return pairs.groupBy(key).agg(F.count_distinct(other).alias("n"))


def ids(pairs: DataFrame, key: str, other: str) -> DataFrame:
    """``key, ids``: partners as a sorted array."""
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set(other)).alias("ids"))


def face_loop(m: MeshFrame, starts: DataFrame, reverse: bool = False) -> DataFrame:
    """``fid, k, vid``: loops that begin at the vertex that ``starts`` (``fid``, ``vid``) names, backwards if asked.

    Positions are turned by modular arithmetic, so that no loop is gathered."""
    n = m.FV.groupBy("fid").agg(F.count("*").cast("int").alias("n"))
    at = m.FV.join(starts, ["fid", "vid"]).groupBy("fid").agg(F.min("pos").alias("p0"))
    turned = F.col("p0") - F.col("pos") if reverse else F.col("pos") - F.col("p0")
    return m.FV.join(n, "fid").join(at, "fid").select("fid", F.pmod(turned, F.col("n")).alias("k"), "vid")


def edge_direction(m: MeshFrame, uses: DataFrame) -> DataFrame:
    """``fid, eid, dir`` for the pairs in ``uses``: 1 as defined, 0 reversed, -1 where the face lacks the edge."""
    return uses.join(m.FE.select("fid", "eid", "dir"), ["fid", "eid"], "left").select("fid", "eid", F.coalesce("dir", F.lit(-1)).alias("dir"))


def face_direction(m: MeshFrame, uses: DataFrame) -> DataFrame:
    return uses.join(m.RF.select("rid", "fid", "dir"), ["rid", "fid"], "left").select("rid", "fid", F.coalesce("dir", F.lit(-1)).alias("dir"))


def uses(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked pairs that hold (a membership test on any incidence)."""
    return asked.join(pairs, asked.columns, "left_semi")


def common_edge(m: MeshFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, eid``: the edge that joins two vertices; null without one."""
    keyed = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    return keyed.join(m.E.select("lo", "hi", "eid"), ["lo", "hi"], "left").select("a", "b", "eid")


def opposite_vertex(m: MeshFrame, asked: DataFrame) -> DataFrame:
    """``eid, vid, opp`` for pairs in ``asked`` (``eid``, ``vid``): the edge's other end, 0 where the vertex is no end."""
    other = F.when(F.col("v0") == F.col("vid"), F.col("v1")).when(F.col("v1") == F.col("vid"), F.col("v0")).otherwise(0)
    return asked.join(m.E.select("eid", "v0", "v1"), "eid").select("eid", "vid", other.cast("long").alias("opp"))


def same_edges(m: MeshFrame) -> DataFrame:
    """``eid, same``: edges on equal end vertices (``same`` is the smallest such edge)."""
    w = Window.partitionBy("lo", "hi")
    return m.E.select("eid", F.min("eid").over(w).alias("same"), F.count("*").over(w).alias("c")).where("c > 1").select("eid", "same")


#: Keys of up to this many members are met by pairs of their members.
PAIRED = 64


def containing(incidence: DataFrame, key: str, member: str, groups: DataFrame) -> DataFrame:
    """Relational division: ``grp, key`` where ``key`` has every member of the group (``groups``: ``grp``, member).

    A group meets keys by its least and its greatest member at once, so that hardly a row meets in vain; what a group has
    beside them is looked up afterwards. Keys of over ``PAIRED`` members would have too many pairs: they meet by single
    members, which are counted."""
    wanted = groups.select("grp", member).distinct()
    size = settled(wanted.groupBy("grp").agg(F.count("*").alias("want"), F.min(member).alias("lo"), F.max(member).alias("hi")))
    rows = settled(incidence.select(key, member).distinct().withColumn("n", F.count("*").over(Window.partitionBy(key))))
    pair = "flatten(transform(ms, (a, i) -> transform(slice(ms, i + 2, size(ms)), b -> struct(a AS lo, b AS hi))))"
    pairs = rows.where(F.col("n").between(2, PAIRED)).groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("ms")).select(key, F.explode(F.expr(pair)).alias("p")).select(key, "p.*")
    out = size.where("want = 2").join(pairs, ["lo", "hi"]).select("grp", key)
    small = rows.where(F.col("n") <= PAIRED)
    if not (one := size.where("want = 1")).isEmpty():
        out = out.union(one.join(small.withColumnRenamed(member, "lo"), "lo").select("grp", key))
    if not (many := size.where("want > 2")).isEmpty():
        met = many.join(pairs, ["lo", "hi"]).select("grp", key, "want", "lo", "hi")
        rest = met.join(wanted, "grp").where((F.col(member) != F.col("lo")) & (F.col(member) != F.col("hi")))
        out = out.union(rest.join(small, [key, member]).groupBy("grp", key, "want").agg(F.count("*").alias("got")).where("got = want - 2").select("grp", key))
    if not (large := rows.where(F.col("n") > PAIRED)).isEmpty():
        got = wanted.join(large, member).groupBy("grp", key).agg(F.count("*").alias("got"))
        out = out.union(got.join(size, "grp").where("got = want").select("grp", key))
    return out


def same_faces(m: MeshFrame) -> DataFrame:
    """``fid, same``: faces on equal vertex sets (``same`` is the smallest such face)."""
    keys = m.FV.groupBy("fid").agg(F.array_sort(F.collect_set("vid")).alias("key"))
    first = keys.groupBy("key").agg(F.min("fid").alias("same"), F.count("*").alias("c")).where("c > 1")
    return keys.join(first, "key").select("fid", "same")


def element_graph(m: MeshFrame, solid: bool = False) -> DataFrame:
    """``src, dst``: elements that share a face (solids) or an edge, each pair once in each direction."""
    pairs = region_neighbors(m).select(F.col("rid").alias("src"), F.col("nbr").alias("dst")) if solid else face_neighbors(m).select(F.col("fid").alias("src"), F.col("nbr").alias("dst"))
    return pairs.distinct()


def graph_offsets(graph: DataFrame, nodes: DataFrame, block: int = 65_536) -> DataFrame:
    """``src, adjbeg, n``: where each node's neighbours begin in compressed rows (0-based), nodes in id order.

    The prefix sum runs within blocks of ids; one row per block carries the sums before it."""
    deg = nodes.select(F.col("id").alias("src")).join(graph.groupBy("src").agg(F.count("*").alias("n")), "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"))
    deg = deg.withColumn("b", F.floor(F.col("src") / block))
    sums = deg.groupBy("b").agg(F.sum("n").alias("s"))
    before = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    own = Window.partitionBy("b").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    return deg.withColumn("r", F.coalesce(F.sum("n").over(own), F.lit(0))).join(before, "b").select("src", (F.col("o") + F.col("r")).alias("adjbeg"), "n")


def face_type(m: MeshFrame) -> DataFrame:
    n = F.col("n")
    return m.F.select("fid", F.when(n == 3, "TRI").when(n == 4, "QUAD").otherwise("POLYGON").alias("ftype"))


def region_type(m: MeshFrame) -> DataFrame:
    """``rid, rtype`` from the faces' loops."""
    t = m.RF.join(m.F.select("fid", "n"), "fid").groupBy("rid").agg(F.count("*").alias("k"), F.count_if(F.col("n") == 3).alias("t"), F.count_if(F.col("n") == 4).alias("q"))
    k, tri, quad = F.col("k"), F.col("t"), F.col("q")
    kind = F.when(k < 4, "UNKNOWN").when((tri == 4) & (k == 4), "TET").when((quad == 3) & (tri == 2) & (k == 5), "PRISM").when((quad == 1) & (tri == 4) & (k == 5), "PYRAMID").when((quad == 6) & (k == 6), "HEX").otherwise("POLYHED")
    return t.select("rid", kind.alias("rtype"))
