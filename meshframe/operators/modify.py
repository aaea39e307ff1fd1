"""Modification: bundles with entities merged, split, joined, swapped or collapsed, for many entities at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, half_edges, number
from ..working import settled, shared_dir
from . import batch
from .graph import components


def _mapped(df: DataFrame, column: str, remap: DataFrame) -> DataFrame:
    """``column`` rewritten where ``remap`` (``old``, ``new``) has it."""
    r = remap.select(F.col("old").alias(column), F.col("new").alias("__n"))
    names = df.columns
    return df.join(r, column, "left").withColumn(column, F.coalesce("__n", column)).select(*names)


def delete(m: MeshFrame, dim: int, gone: DataFrame) -> MeshFrame:
    """Without entities (``id``) and their rows in incidence, attribute and set tables."""
    name, key = {0: ("V", "vid"), 1: ("E", "eid"), 2: ("F", "fid"), 3: ("R", "rid")}[dim]
    g = gone.select(F.col("id").alias(key))
    tables = {name: m.tables[name].join(g, key, "left_anti")}
    for inc in {0: ["FV", "RV"], 1: ["FE"], 2: ["FE", "FV", "RF"], 3: ["RF", "RV"]}[dim]:
        tables[inc] = m.tables[inc].join(g, key, "left_anti")
    both = gone.select("id", F.lit(dim).alias("dim"))
    for t in ("AV", "SM"):
        tables[t] = m.tables[t].join(both, ["dim", "id"], "left_anti")
    return m.with_tables(**tables)


def add(m: MeshFrame, dim: int, rows: DataFrame) -> MeshFrame:
    """With new entities, whose ids follow the largest (rows need an integer ``ord`` that orders them)."""
    df, key = m.table(dim)
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("__t"))
    new = number(rows, "__k", "ord").crossJoin(F.broadcast(top)).withColumn(key, F.col("__t") + F.col("__k"))  # one row
    name = {0: "V", 1: "E", 2: "F", 3: "R"}[dim]
    return m.with_tables(**{name: df.unionByName(new.select(*df.columns))})


def update(m: MeshFrame, dim: int, values: DataFrame) -> MeshFrame:
    """Overwrite columns of entities by ``id`` (coordinates, classification, ends)."""
    df, key = m.table(dim)
    new = values.select(F.col("id").alias(key), F.lit(True).alias("__h"), *[F.col(c).alias(f"__{c}") for c in values.columns if c != "id"])
    out = df.join(new, key, "left").select(*[F.when(F.col("__h"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values.columns else F.col(c) for c in df.columns])
    return m.with_tables(**{{0: "V", 1: "E", 2: "F", 3: "R"}[dim]: out})


def reverse_edge(fe: DataFrame, uses: DataFrame) -> DataFrame:
    """Directions of the uses (``fid``, ``eid``) flipped."""
    return fe.join(uses.select("fid", "eid").distinct().withColumn("__h", F.lit(True)), ["fid", "eid"], "left").select("fid", "pos", "eid", F.when(F.col("__h"), 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir"))


def merge_vertices(v: DataFrame, fv: DataFrame, remap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``V`` and ``FV`` with vertices ``old`` merged into ``new``, to the end of a chain; repeated neighbours in a loop count once
    and loops of under three vertices vanish. Derive edges anew with ``MeshFrame.from_faces``, which merges doubled ones;
    ``batch.merge_points`` keeps all tables of a bundle instead."""
    remap = batch.settled_pairs(remap)
    kept = v.join(remap.select(F.col("old").alias("vid")), "vid", "left_anti")
    loops = _mapped(fv, "vid", remap)
    w = Window.partitionBy("fid").orderBy("pos")
    last = F.last("vid").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n = F.count("*").over(Window.partitionBy("fid"))
    clean = loops.withColumn("p", F.coalesce(F.lag("vid").over(w), last)).withColumn("n0", n).where("vid <> p or n0 = 1")
    dense = clean.select("fid", (F.row_number().over(w) - 1).alias("pos"), "vid").withColumn("n", F.count("*").over(Window.partitionBy("fid")))
    return kept, dense.where("n >= 3").select("fid", "pos", "vid")


def merge_sets(sm: DataFrame, dim: int, remap: DataFrame) -> DataFrame:
    """Set members renamed; a set that already has the survivor loses the other."""
    mine = sm.where(F.col("dim") == dim)
    new = _mapped(mine, "id", remap).groupBy("set", "dim", "id").agg(F.min("pos").alias("pos")).select("set", "pos", "dim", "id")
    return sm.where(F.col("dim") != dim).unionByName(new)


def mergeable(m: MeshFrame, dim: int, remap: DataFrame, topology: bool = True) -> DataFrame:
    """The pairs of ``remap`` (``old``, ``new``; chains are followed to their ends) that may be merged: with ``topology``, entities of one model dimension must
    be on one model entity, and the one that goes may not be on a model entity of lower dimension."""
    remap = batch.settled_pairs(remap)
    if not topology:
        return remap
    df, key = m.table(dim)
    a = df.select(F.col(key).alias("old"), F.col("gdim").alias("d0"), F.col("gent").alias("g0"))
    b = df.select(F.col(key).alias("new"), F.col("gdim").alias("d1"), F.col("gent").alias("g1"))
    return remap.join(a, "old").join(b, "new").where("d0 > d1 or (d0 = d1 and g0 = g1)").select("old", "new")


def merge_edges(m: MeshFrame, remap: DataFrame, topology: bool = True) -> MeshFrame:
    """Edges ``old`` merged into ``new``: faces use the survivor, in the direction that keeps their loops; sets are patched.
    Pairs whose end vertices differ are left alone; merge those first."""
    ends = lambda c: m.E.select(F.col("eid").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"), F.col("v0").alias(f"v0_{c}"))
    pairs = mergeable(m, 1, remap, topology).join(ends("old"), "old").join(ends("new"), "new").where("lo_old = lo_new and hi_old = hi_new")
    r = pairs.select(F.col("old").alias("eid"), "new", (F.col("v0_old") != F.col("v0_new")).alias("turn"))
    fe = m.FE.join(r, "eid", "left").select("fid", "pos", F.coalesce("new", "eid").alias("eid"), F.when(F.col("turn"), 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir"))
    gone = pairs.select("old", "new")
    return m.with_tables(E=m.E.join(gone.select(F.col("old").alias("eid")), "eid", "left_anti"), FE=fe, SM=merge_sets(m.SM, 1, gone))


def merge_faces(m: MeshFrame, remap: DataFrame, topology: bool = True) -> MeshFrame:
    """Faces ``old`` merged into ``new`` on the same vertices: cells use the survivor, turned where the loops run the other
    way; sets are patched. Pairs on different vertices are left alone."""
    keys = m.FV.groupBy("fid").agg(F.array_sort(F.collect_set("vid")).alias("key"))
    k = lambda c: keys.select(F.col("fid").alias(c), F.col("key").alias(f"key_{c}"))
    pairs = mergeable(m, 2, remap, topology).join(k("old"), "old").join(k("new"), "new").where("key_old = key_new").select("old", "new")
    # the loops run alike when the first side of one is a side of the other in its direction
    sides = half_edges(m.FV)
    first = pairs.join(sides.where("pos = 0").select(F.col("fid").alias("old"), "v0", "v1"), "old")
    alike = first.join(sides.select(F.col("fid").alias("new"), "v0", "v1"), ["new", "v0", "v1"], "left_semi").select("old", F.lit(False).alias("turn"))
    r = pairs.join(alike, "old", "left").select(F.col("old").alias("fid"), "new", F.coalesce("turn", F.lit(True)).alias("turn"))
    rf = m.RF.join(r, "fid", "left").select("rid", "pos", F.coalesce("new", "fid").alias("fid"), F.when(F.col("turn"), 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir"))
    gone = pairs.select(F.col("old").alias("fid"))
    return m.with_tables(F=m.F.join(gone, "fid", "left_anti"), FE=m.FE.join(gone, "fid", "left_anti"), FV=m.FV.join(gone, "fid", "left_anti"), RF=rf, SM=merge_sets(m.SM, 2, pairs))


def set_face_directions(m: MeshFrame, uses: DataFrame) -> MeshFrame:
    """With the directions of ``uses`` (``rid``, ``fid``, ``dir``) in their cells."""
    new = uses.select("rid", "fid", F.col("dir").alias("__d"))
    return m.with_tables(RF=m.RF.join(new, ["rid", "fid"], "left").select("rid", "pos", "fid", F.coalesce("__d", "dir").alias("dir")))


def reverse_faces(m: MeshFrame, faces: DataFrame) -> MeshFrame:
    """Faces (``fid``) turned round: every cell that has one uses it the other way."""
    hit = faces.select("fid").distinct().withColumn("__h", F.lit(True))
    return m.with_tables(RF=m.RF.join(hit, "fid", "left").select("rid", "pos", "fid", F.when(F.col("__h"), 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir")))


def split_edges(m: MeshFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``V`` and ``FV`` with ``n`` equispaced vertices on each edge in ``edges`` (``eid``, ``n``); new ids follow the
    largest, in order of edge and place; the new points take the edge's classification."""
    top = m.V.agg(F.max("vid").alias("top"))
    cut = m.E.join(edges, "eid").where("n > 0").select("eid", "v0", "v1", "gdim", "gent", "n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    new = number(cut, "r", "eid", "k").crossJoin(F.broadcast(top)).withColumn("vid", F.col("top") + F.col("r"))  # one row
    a, b = (m.V.select(F.col("vid").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"]) for i in (0, 1))
    t = F.col("k") / (F.col("n") + 1)
    v = new.join(a, "v0").join(b, "v1").select("vid", *[(F.col(f"{c}0") + t * (F.col(f"{c}1") - F.col(f"{c}0"))).alias(c) for c in "xyz"], "gdim", "gent")
    inner = m.FE.join(new.select("eid", "k", "n", "vid"), "eid").select("fid", "pos", F.when(F.col("dir") == 1, F.col("k")).otherwise(F.col("n") + 1 - F.col("k")).alias("s"), "vid")
    rows = m.FV.select("fid", "pos", F.lit(0).cast("long").alias("s"), "vid").union(inner.select("fid", "pos", F.col("s").cast("long"), "vid"))
    w = Window.partitionBy("fid").orderBy("pos", "s")
    return m.V.select("vid", "x", "y", "z", "gdim", "gent").union(v), rows.select("fid", (F.row_number().over(w) - 1).alias("pos"), "vid")


def fan_split(m: MeshFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``V`` and ``FV`` with each face in ``faces`` (``fid``) cut into triangles around its vertex mean. The first
    triangle keeps the face's id, further ones follow the largest, in order of face and side."""
    shared_dir(m.V.sparkSession)
    sides = m.FV.join(faces, "fid", "left_semi")
    w = Window.partitionBy("fid").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum((F.col("pos") > 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sides = sides.select("fid", "pos", "vid", F.coalesce(F.lead("vid").over(w), F.first("vid").over(whole)).alias("nxt"), upto.alias("more")).transform(settled)
    tops = m.V.agg(F.max("vid").alias("tv")).crossJoin(m.F.agg(F.max("fid").alias("tf")))  # one row each
    # what the sides of the faces before have of further triangles: summed up by blocks of faces, a row for each in one task
    size = faces.select("fid").distinct().join(sides.groupBy("fid").agg(F.max("more").alias("n")), "fid", "left").select("fid", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("fid") / 65_536).alias("b")).transform(settled)
    earlier = lambda c, o: F.coalesce(F.sum(c).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    block = size.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    block = block.select("b", earlier("n", Window.orderBy("b")).alias("bn"), earlier("k", Window.orderBy("b")).alias("bk"))
    own = Window.partitionBy("b").orderBy("fid")
    cen = size.select("fid", "b", earlier("n", own).alias("n"), F.row_number().over(own).alias("k")).join(block, "b").crossJoin(F.broadcast(tops))
    cen = cen.select("fid", (F.col("tv") + F.col("bk") + F.col("k")).alias("cen"), (F.col("tf") + F.col("bn") + F.col("n")).alias("nf")).transform(settled)
    pts = sides.select("fid", "vid").join(m.V, "vid").groupBy("fid").agg(*[F.avg(c).alias(c) for c in "xyz"])
    v = pts.join(cen, "fid").join(m.F.select("fid", "gdim", "gent"), "fid").select(F.col("cen").alias("vid"), "x", "y", "z", "gdim", "gent")
    tri = sides.join(cen, "fid").select(F.when(F.col("pos") > 0, F.col("nf") + F.col("more")).otherwise(F.col("fid")).alias("fid"), F.posexplode(F.array("cen", "vid", "nxt")).alias("pos", "vid"))
    rest = m.FV.join(faces, "fid", "left_anti").select("fid", "pos", "vid")
    return m.V.select("vid", "x", "y", "z", "gdim", "gent").union(v), rest.union(tri)


def swap_edges(m: MeshFrame, edges: DataFrame) -> DataFrame:
    """``FV`` with the common edge of two triangles replaced by the other diagonal, for edges (``eid``), which may meet; those
    that ``batch.swap`` refuses stay."""
    return batch.swap(m, edges)[0]


def join_faces(m: MeshFrame, edges: DataFrame) -> DataFrame:
    """``FV`` with the two faces of each edge (``eid``) joined under the lower id, in chains too; edges that ``batch.join``
    refuses stay."""
    return batch.join(m, edges)[0].FV


def join_regions(m: MeshFrame, faces: DataFrame) -> DataFrame:
    """``RF`` with the cells on both sides of each face (``fid``) joined, without these faces. Cells that several faces join,
    in chains too, all become one, under the lowest id; faces that come to lie within it go as well."""
    two = m.RF.join(faces, "fid", "left_semi").groupBy("fid").agg(F.count("*").alias("k"), F.min("rid").alias("a"), F.max("rid").alias("b")).where("k = 2 and a < b")
    links = two.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    label = components(links.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), links.union(links.select("dst", "src")))
    moved = _mapped(m.RF, "rid", label.select(F.col("node").alias("old"), F.col("component").alias("new")))
    inner = moved.groupBy("rid", "fid").agg(F.count("*").alias("k")).where("k > 1").select("rid", "fid")
    rest = moved.join(inner, ["rid", "fid"], "left_anti")
    return rest.select("rid", (F.row_number().over(Window.partitionBy("rid").orderBy("pos", "fid")) - 1).alias("pos"), "fid", "dir")


def independent(edges: DataFrame) -> DataFrame:
    """The edges (``eid``, ``v0``, ``v1``) that have the lowest id at both of their vertices: no two of them meet."""
    ends = edges.select("eid", F.explode(F.array("v0", "v1")).alias("v"))
    low = ends.groupBy("v").agg(F.min("eid").alias("low"))
    lost = ends.join(low, "v").where("eid <> low").select("eid").distinct()
    return edges.join(lost, "eid", "left_anti")


def collapse_edges(m: MeshFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``V``, ``FV`` and deleted entities (``dim``, ``id``) after collapsing edges (``eid``), no two of which may share a
    vertex (of those that do, only the one of the lowest id is collapsed): the second vertex stays unless it lies on a model entity of higher dimension than the first; edges whose
    first vertex could not move (equal dimensions on different entities) are refused. Faces that lose their third
    vertex go; doubled edges and faces merge when tables are derived anew."""
    a = m.V.select(F.col("vid").alias("v0"), F.col("gdim").alias("d0"), F.col("gent").alias("g0"))
    b = m.V.select(F.col("vid").alias("v1"), F.col("gdim").alias("d1"), F.col("gent").alias("g1"))
    e = independent(m.E.join(edges, "eid", "left_semi")).join(a, "v0").join(b, "v1").where("d0 <> d1 or g0 = g1")
    keep0 = F.col("d0") < F.col("d1")
    remap = e.select(F.when(keep0, F.col("v1")).otherwise(F.col("v0")).alias("old"), F.when(keep0, F.col("v0")).otherwise(F.col("v1")).alias("new"))
    v, fv = merge_vertices(m.V, m.FV, remap)
    gone = remap.select(F.lit(0).alias("dim"), F.col("old").alias("id")).union(m.F.join(fv.select("fid").distinct(), "fid", "left_anti").select(F.lit(2).alias("dim"), F.col("fid").alias("id")))
    return v, fv, gone


def replace_vertex(fv: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """Vertices of loops or cells replaced: ``asked`` has the key, ``old`` and ``new``."""
    j = fv.join(asked.select(key, F.col("old").alias("vid"), "new"), [key, "vid"], "left")
    return j.select(key, "pos", F.coalesce("new", "vid").alias("vid"))


def insert_vertex(fv: DataFrame, asked: DataFrame) -> DataFrame:
    """``FV`` with ``new`` before position ``at`` of loop ``fid``."""
    rows = fv.select("fid", "pos", F.lit(1).alias("s"), "vid").union(asked.select("fid", F.col("at").alias("pos"), F.lit(0), F.col("new")))
    return rows.select("fid", (F.row_number().over(Window.partitionBy("fid").orderBy("pos", "s", "vid")) - 1).alias("pos"), "vid")


def remove_use(incidence: DataFrame, key: str, member: str, asked: DataFrame) -> DataFrame:
    """Rows (``key``, ``member``) in ``asked`` removed and positions closed up (an edge from a face, a face from a cell)."""
    left = incidence.join(asked.select(key, member).distinct(), [key, member], "left_anti")
    return left.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)


def replace_run(incidence: DataFrame, key: str, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``asked`` (key, ``at``, ``n``): runs taken out; ``rows`` (key, ``k`` and the other columns) put in their place."""
    cut = incidence.join(asked, key, "left").where("at is null or pos < at or pos >= at + n")
    others = [c for c in incidence.columns if c not in (key, "pos")]
    put = rows.join(asked, key).select(key, (F.col("at") - F.lit(0.5)).alias("o"), F.col("k").alias("s"), *others)
    both = cut.select(key, F.col("pos").cast("double").alias("o"), F.lit(0).alias("s"), *others).unionByName(put)
    return both.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("o", "s")) - 1).alias("pos"), *others)


def split_face(fv: DataFrame, asked: DataFrame) -> DataFrame:
    """``FV`` with loops (``fid``, ``a``, ``b``, ``new``) cut along an edge from vertex ``a`` to ``b``: the part from
    ``a`` to ``b`` keeps the id, the rest is ``new``."""
    n = fv.groupBy("fid").agg(F.count("*").cast("int").alias("n"))
    at = fv.join(asked, "fid").groupBy("fid", "new").agg(F.max(F.when(F.col("vid") == F.col("a"), F.col("pos"))).alias("pa"), F.max(F.when(F.col("vid") == F.col("b"), F.col("pos"))).alias("pb"))
    j = fv.join(at, "fid").join(n, "fid").withColumns({"k": F.pmod(F.col("pos") - F.col("pa"), F.col("n")), "kb": F.pmod(F.col("pb") - F.col("pa"), F.col("n"))})
    one = j.where("k <= kb").select("fid", F.col("k").alias("o"), "vid")
    two = j.where("k >= kb or k = 0").select(F.col("new").alias("fid"), F.when(F.col("k") == 0, F.col("n")).otherwise(F.col("k")).alias("o"), "vid")
    made = one.union(two)
    return fv.join(asked, "fid", "left_anti").select("fid", "pos", "vid").union(made.select("fid", (F.row_number().over(Window.partitionBy("fid").orderBy("o")) - 1).alias("pos"), "vid"))
