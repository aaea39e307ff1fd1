"""Distribution of whole meshes over parts: global ids, ghosts and labels of every kind of entity, weaving of meshes
that came in parts.

A distributed mesh is a bundle whose entity tables have the columns ``part, master_part, ptype, on_bdry`` before their own
(``on_bdry``: elements that several parts own reach it); incidence, attribute values, set members and global ids have
``part``. Ids are global, so that copies of an entity agree in them. Parts are values of a column: Spark deals rows to
machines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, half_edges, number
from ..schema import GHOST, KIND, OVERLAP
from ..working import settled, shared_dir, shuffled
from . import geometry, parallel
from .partition import cut_into

HELD = ["part", "master_part", "ptype", "on_bdry"]
#: Tables whose rows follow the copies of an entity, and those that a distributed mesh has once.
DEALT, SHARED = ("AV", "SM", "G"), ("AD", "SD")


def set_global_ids(m: MeshFrame, dim: int, values: DataFrame) -> MeshFrame:
    """With global ids (``id``, ``gid``) of entities of a kind; earlier ones of these entities are replaced."""
    new = values.select(F.lit(dim).alias("dim"), "id", "gid").groupBy("dim", "id").agg(F.max("gid").alias("gid"))
    return m.with_tables(G=m.G.join(new, ["dim", "id"], "left_anti").unionByName(new))


def global_ids(m: MeshFrame, dim: int) -> DataFrame:
    """``id, gid`` of every entity of a kind; where none was set, the id itself."""
    df, key = m.table(dim)
    known = m.G.where(F.col("dim") == dim).select("id", "gid")
    return df.select(F.col(key).alias("id")).join(known, "id", "left").select("id", F.coalesce("gid", "id").alias("gid"))


def from_global_ids(m: MeshFrame, dim: int, asked: DataFrame) -> DataFrame:
    """Rows of the entities whose global ids are in ``asked`` (``gid``), with ``gid``."""
    df, key = m.table(dim)
    hits = global_ids(m, dim).join(asked.select("gid").distinct(), "gid")
    return df.join(hits.withColumnRenamed("id", key), key)


@dataclass(frozen=True)
class PartedMesh:
    tables: dict[str, DataFrame]

    def copies(self, dim: int) -> DataFrame:
        """``part, gid, master_part, ptype`` of a kind, as the operators of ``parallel`` take them."""
        name, key = KIND[dim]
        return self.tables[name].select("part", F.col(key).alias("gid"), "master_part", "ptype")

    def all_copies(self) -> DataFrame:
        """``dim, part, id, master_part, ptype`` of all kinds."""
        out = None
        for dim, (name, key) in KIND.items():
            if name in self.tables:
                row = self.tables[name].select(F.lit(dim).alias("dim"), "part", F.col(key).alias("id"), "master_part", "ptype")
                out = row if out is None else out.union(row)
        return out

    def on_boundary(self, dim: int) -> DataFrame:
        """``part, gid, on_bdry`` of a kind."""
        name, key = KIND[dim]
        return self.tables[name].select("part", F.col(key).alias("gid"), "on_bdry")

    def part(self, k: int) -> MeshFrame:
        """One part's mesh, ghosts included."""
        mine = {n: t if n in SHARED else t.where(F.col("part") == k).drop(*HELD) for n, t in self.tables.items()}
        m = MeshFrame.empty(self.tables["V"].sparkSession).with_tables(**mine)
        return m.with_meta(part=k)

    def submesh(self, ptype: int = OVERLAP) -> PartedMesh:
        """The elements of one type (by default those that other parts hold as ghosts) with all that they stand on."""
        top = 3 if "R" in self.tables else 2
        name, key = KIND[top]
        keep = self.tables[name].where(F.col("ptype") == ptype)
        some = keep.select("part", key)
        tables = {name: keep}
        if top == 3:
            tables |= {t: self.tables[t].join(some, ["part", key], "left_semi") for t in ("RF", "RV")}
            some, tables["F"] = _closed(self.tables["F"], tables["RF"], "fid")
            key = "fid"
        tables |= {t: self.tables[t].join(some, ["part", key], "left_semi") for t in ("FE", "FV")}
        _, tables["E"] = _closed(self.tables["E"], tables["FE"], "eid")
        _, tables["V"] = _closed(self.tables["V"], tables["FV"], "vid")
        kept = PartedMesh(tables).all_copies().select("part", "dim", "id")
        tables |= {t: self.tables[t].join(kept, ["part", "dim", "id"], "left_semi") for t in DEALT if t in self.tables}
        return PartedMesh(tables | {t: self.tables[t] for t in SHARED if t in self.tables})

    def concat(self, *others: PartedMesh) -> PartedMesh:
        """All rows of several bundles, each entity of a part once; a copy that is owned stands before a ghost."""
        tables = {}
        for name, df in self.tables.items():
            for o in others:
                if name in o.tables:
                    df = df.unionByName(o.tables[name])
            own = {"AV": ["part", "name", "dim", "id"], "SM": ["part", "set", "dim", "id", "pos"], "G": ["part", "dim", "id"], "AD": ["name"], "SD": ["set"]}
            keys = own.get(name) or [c for c in ("part", "rid", "fid", "eid", "vid", "pos") if c in df.columns]
            first = Window.partitionBy(*keys).orderBy("ptype") if "ptype" in df.columns else None
            tables[name] = df.dropDuplicates(keys) if first is None else df.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
        return PartedMesh(tables)


def _closed(df: DataFrame, incidence: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    used = incidence.select("part", key).distinct()
    return used, df.join(used, ["part", key], "left_semi")


def _held(df: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """An entity table with one row per copy."""
    held = labels if "on_bdry" in labels.columns else labels.withColumn("on_bdry", F.lit(False))
    return held.select(*HELD, F.col("gid").alias(key)).join(df, key).select(*HELD, *df.columns)


def distribute(m: MeshFrame, parts: DataFrame, layers: int = 1) -> PartedMesh:
    """Deal a mesh out by ``parts`` (``id`` of every element, ``part``), with ``layers`` rings of ghost elements around
    each part. Faces, edges and vertices are labelled from the elements down: the owner is the lowest part whose own
    elements reach them. Attribute values, set members and global ids go to every copy of their entity; definitions of
    attributes and sets are the same for all parts."""
    shared_dir(m.V.sparkSession)
    m = m.shuffled()
    solid = not m.R.isEmpty()
    inc, key = (m.RV, "rid") if solid else (m.FV, "fid")
    if solid and m.RV.isEmpty():  # cells that are given by their faces
        inc = m.RF.join(m.FV, "fid").select("rid", "vid").distinct()
    cells = parallel.label_cells(parts, parallel.ghost_cells(inc, parts, layers, key)).transform(shuffled)
    tables = {}
    if solid:
        tables["R"] = _held(m.R, "rid", cells)
        on = cells.select("part", F.col("gid").alias("rid"))
        tables |= {t: on.join(m.tables[t], "rid").select("part", *m.tables[t].columns) for t in ("RF", "RV")}
        faces = parallel.label_members(m.RF, "rid", "fid", cells).transform(shuffled)
        edges = parallel.label_members(m.RF.join(m.FE, "fid").select("rid", "eid").distinct(), "rid", "eid", cells).transform(shuffled)
    else:
        faces = cells
        edges = parallel.label_members(m.FE, "fid", "eid", cells).transform(shuffled)
    points = parallel.label_members(inc, key, "vid", cells).transform(shuffled)
    tables["F"], tables["E"], tables["V"] = _held(m.F, "fid", faces), _held(m.E, "eid", edges), _held(m.V, "vid", points)
    on = faces.select("part", F.col("gid").alias("fid"))
    tables |= {t: on.join(m.tables[t], "fid").select("part", *m.tables[t].columns) for t in ("FE", "FV")}
    labels = {0: points, 1: edges, 2: faces} | ({3: cells} if solid else {})
    copies = None
    for dim, df in labels.items():
        row = df.select("part", F.lit(dim).alias("dim"), F.col("gid").alias("id"))
        copies = row if copies is None else copies.union(row)
    tables |= {t: copies.join(m.tables[t], ["dim", "id"]).select("part", *m.tables[t].columns) for t in DEALT}
    return PartedMesh(tables | {t: m.tables[t] for t in SHARED})


def set_values(p: PartedMesh, values: DataFrame) -> PartedMesh:
    """With attribute values (``part`` and the columns of ``AV``) set in the parts that give them; others keep theirs."""
    keys = ["part", "name", "dim", "id"]
    old = p.tables["AV"].join(values.select(*keys), keys, "left_anti")
    return PartedMesh(p.tables | {"AV": old.select(*p.tables["AV"].columns).unionByName(values.select(*p.tables["AV"].columns))})


def update_attributes(p: PartedMesh, names: list[str] | None = None, changed: DataFrame | None = None) -> PartedMesh:
    """Ghosts take their owners' values of the attributes ``names`` (all by default). With ``changed`` (``name, dim, id``) only
    these values are sent; the rest is taken to agree. A ghost whose owner has no value keeps its own."""
    own = p.tables["AV"]
    if names is not None:
        own = own.where(F.col("name").isin(names))
    if changed is not None:
        own = own.join(changed.select("name", "dim", "id").distinct(), ["name", "dim", "id"], "left_semi")
    copies = p.all_copies()
    masters = copies.where("part = master_part").select("dim", "part", "id")
    sent = own.join(masters, ["dim", "part", "id"], "left_semi").drop("part")
    ghosts = copies.where("part <> master_part").select("dim", "part", "id")
    return set_values(p, sent.join(ghosts, ["dim", "id"]).select(*p.tables["AV"].columns))


def gather_attribute(p: PartedMesh, name: str, dim: int, column: str, op: str) -> PartedMesh:
    """Every copy of the entities of a kind gets the reduction (MAX, MIN, SUM, AVG) of an attribute's ``column`` (``ival``,
    ``dval`` or ``vval``) over all copies that have a value."""
    mine = p.tables["AV"].where((F.col("name") == name) & (F.col("dim") == dim))
    held = mine.select("part", F.col("id").alias("gid"), F.col(column).alias("__v")).where("__v is not null")
    one = parallel.gather_scatter(held, "__v", op).select(F.col("gid").alias("id"), "__v").distinct()
    blank = {c: F.lit(None).cast(p.tables["AV"].schema[c].dataType) for c in ("ival", "dval", "vval", "ref")}
    rows = p.all_copies().where(F.col("dim") == dim).select("part", "dim", "id").join(one, "id").withColumns(blank | {"name": F.lit(name), column: F.col("__v").cast(p.tables["AV"].schema[column].dataType)})
    return set_values(p, rows)


def partition(m: MeshFrame, n: int, method: str = "bisection", weights: DataFrame | None = None) -> DataFrame:
    """``id, part`` of the elements in exactly ``n`` parts: recursive coordinate bisection (of x and y; of cells of x, y and z;
    ``weights`` has ``id, weight``), or runs of ids of equal length (``strips``)."""
    solid = not m.R.isEmpty()
    if method == "strips":
        df, key = m.table(3 if solid else 2)
        return parallel.strips(df.select(F.col(key).alias("id")), n)
    if method != "bisection":
        raise ValueError(f"unknown method {method}")
    points = geometry.centroids(m, solid)
    if weights is not None:
        points = points.join(weights.select("id", "weight"), "id")
    return cut_into(points, n, ("x", "y", "z") if solid else ("x", "y"), None if weights is None else "weight")


def read_distributed(spark: SparkSession, path: str, n: int, layers: int = 1, method: str = "bisection") -> PartedMesh:
    """Read a mesh file of any known format, partition and distribute it."""
    from ..sources import formats

    m = formats.read(spark, path)
    return distribute(m, partition(m, n, method), layers)


def weave(v: DataFrame, loops: DataFrame, layers: int = 1, tolerance: float = 1e-12, gids: DataFrame | None = None) -> PartedMesh:
    """Connect surface meshes that came in parts: ``v`` (``part, vid, x, y, z``), ``loops`` (``part, fid, pos, vid``).

    Vertices of several parts are one where their places agree within ``tolerance``, or their ``gids``
    (``part, vid, gid``), if given; the lowest part owns them. Faces are numbered by part and id; edges follow from the
    vertices. Ghost layers and labels are those of ``distribute``."""
    shared_dir(v.sparkSession)
    if gids is None:
        same = parallel.match_points(v.select("part", F.col("vid").alias("id"), "x", "y", "z"), tolerance)
        own = number(same.select("master_part", "master_id").distinct(), "gid", "master_id", group="master_part")
        gids = same.join(own, ["master_part", "master_id"]).select("part", F.col("id").alias("vid"), "gid")
    gids = gids.transform(settled)
    points = v.join(gids, ["part", "vid"]).groupBy("gid").agg(F.min_by(F.struct("x", "y", "z"), F.struct("part", "vid")).alias("p"))
    vertices = points.select(F.col("gid").alias("vid"), "p.*", F.lit(4).alias("gdim"), F.lit(0).cast("long").alias("gent"))
    faces = number(loops.select("part", "fid").distinct(), "gid", "fid", group="part")
    fv = loops.join(gids.withColumnRenamed("gid", "vg"), ["part", "vid"]).join(faces, ["part", "fid"]).select(F.col("gid").alias("fid"), "pos", F.col("vg").alias("vid"))
    m = MeshFrame.from_faces(vertices, fv.transform(settled)).settled("V", "E", "F", "FE")
    return distribute(m, faces.select(F.col("gid").alias("id"), "part").transform(settled), layers)


def apart(m: MeshFrame, parts: DataFrame) -> dict[str, DataFrame]:
    """The parts as meshes that know nothing of each other: all tables of the elements that each owns, with ``part`` and
    ids of its own."""
    shared_dir(m.V.sparkSession)
    p = distribute(m, parts, layers=0)
    maps = {key: number(p.tables[name].select("part", key), "own", key, group="part").transform(shuffled) for name, key in KIND.values() if name in p.tables}

    def renamed(df: DataFrame, column: str, key: str) -> DataFrame:
        names = df.columns
        return df.join(maps[key].select("part", F.col(key).alias(column), "own"), ["part", column]).withColumn(column, F.col("own")).select(*names)

    out = {}
    for name, df in p.tables.items():
        if name in SHARED or name == "G":
            continue
        df = df.drop("master_part", "ptype", "on_bdry")
        if name in ("AV", "SM"):
            every = None
            for dim, (_, key) in KIND.items():
                if key in maps:
                    row = renamed(df.where(F.col("dim") == dim), "id", key)
                    every = row if every is None else every.unionByName(row)
            df = every
        for column in df.columns:
            if column in maps or column in ("v0", "v1"):
                df = renamed(df, column, column if column in maps else "vid")
        if name == "E":
            df = df.withColumns({"lo": F.least("v0", "v1"), "hi": F.greatest("v0", "v1")})
        out[name] = df
    return out | {t: p.tables[t] for t in SHARED}


def weave_meshes(tables: dict[str, DataFrame], layers: int = 1, tolerance: float = 1e-12, gids: DataFrame | None = None) -> PartedMesh:
    """Connect meshes, surfaces or solids, that came in parts: ``tables`` are those of a bundle with ``part`` before their
    own columns, ids being each part's own (``R``, ``RF``, ``RV`` for solids only; ``AV``, ``SM``, ``AD``, ``SD`` if there).

    Vertices of several parts are one where their places agree within ``tolerance``, or their ``gids`` (``part, vid, gid``), if
    given; edges and faces are one where their vertices are. The copy of the lowest part, and of its lowest id, defines
    an entity: coordinates, classification, ends and loop; directions in other parts are turned to it. Global ids
    follow the owning part, then the id there. Attribute values are those of the lowest part that has one; sets are
    joined, part by part. Ghost layers and labels are those of ``distribute``."""
    spark = tables["V"].sparkSession
    shared_dir(spark)
    solid = "R" in tables
    if gids is None:
        same = parallel.match_points(tables["V"].select("part", F.col("vid").alias("id"), "x", "y", "z"), tolerance)
        own = number(same.select("master_part", "master_id").distinct(), "gid", "master_id", group="master_part")
        gids = same.join(own, ["master_part", "master_id"]).select("part", F.col("id").alias("vid"), "gid")
    vmap = gids.select("part", "vid", "gid").transform(shuffled)

    def at(df: DataFrame, column: str, key: str, by: DataFrame) -> DataFrame:
        """A column of ids of a part become global ones."""
        return df.join(by.select("part", F.col(key).alias(column), F.col("gid").alias("__g")), ["part", column]).withColumn(column, F.col("__g")).drop("__g")

    def known(df: DataFrame, key: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
        """Which copies are one (``part``, ``key``, ``gid``), and of each the one that defines it (``gid``, ``part``, ``key``)."""
        first = df.groupBy(*by).agg(F.min(F.struct("part", key)).alias("o"))
        ids = number(first.select(*by, F.col("o.part").alias("mp"), F.col(f"o.{key}").alias("mk")), "gid", "mk", group="mp").transform(shuffled)
        return df.join(ids, by).select("part", key, "gid").transform(shuffled), ids.select("gid", F.col("mp").alias("part"), F.col("mk").alias(key))

    first = vmap.groupBy("gid").agg(F.min(F.struct("part", "vid")).alias("o")).select("gid", "o.*")
    v = tables["V"].join(first, ["part", "vid"]).withColumn("vid", F.col("gid")).select(*MeshFrame.empty(spark).V.columns)
    e0 = at(at(tables["E"], "v0", "vid", vmap), "v1", "vid", vmap).withColumns({"lo": F.least("v0", "v1"), "hi": F.greatest("v0", "v1")}).transform(shuffled)
    emap, edefs = known(e0, "eid", ["lo", "hi"])
    e = e0.join(edefs, ["part", "eid"]).withColumn("eid", F.col("gid")).select(*MeshFrame.empty(spark).E.columns).transform(shuffled)
    turned = emap.join(e0.select("part", "eid", "v0"), ["part", "eid"]).join(e.select(F.col("eid").alias("gid"), F.col("v0").alias("from")), "gid").select("part", "eid", "gid", (F.col("v0") != F.col("from")).alias("turn"))
    fv0 = at(tables["FV"], "vid", "vid", vmap).transform(shuffled)
    keys = fv0.groupBy("part", "fid").agg(F.array_sort(F.collect_list("vid")).alias("key"))
    fmap, fdefs = known(keys, "fid", ["key"])
    mine = lambda df: df.join(fdefs, ["part", "fid"]).withColumn("fid", F.col("gid")).drop("gid")
    f = mine(tables["F"]).select(*MeshFrame.empty(spark).F.columns)
    fv = mine(fv0).select("fid", "pos", "vid").transform(shuffled)
    fe = mine(tables["FE"]).join(turned, ["part", "eid"]).select("fid", "pos", F.col("gid").alias("eid"), F.when(F.col("turn"), 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir"))
    made = {"V": v, "E": e, "F": f, "FE": fe.transform(shuffled), "FV": fv}
    maps = {0: vmap.withColumnRenamed("vid", "id"), 1: emap.withColumnRenamed("eid", "id"), 2: fmap.withColumnRenamed("fid", "id")}
    top = fmap.join(fdefs.select("gid", "part", "fid"), ["gid", "part", "fid"]).select(F.col("gid").alias("id"), "part")
    if solid:
        rmap, _ = known(tables["R"].select("part", "rid"), "rid", ["part", "rid"])
        maps[3] = rmap.withColumnRenamed("rid", "id")
        first_side = half_edges(fv0.withColumn("fid", F.struct("part", "fid")).select("fid", "pos", "vid")).where("pos = 0").select("fid.part", "fid.fid", "v0", "v1")
        sides = half_edges(fv).select(F.col("fid").alias("gid"), "v0", "v1")
        alike = first_side.join(fmap, ["part", "fid"]).join(sides, ["gid", "v0", "v1"], "left_semi").select("part", "fid", F.lit(True).alias("alike"))
        uses = tables["RF"].join(fmap, ["part", "fid"]).join(alike, ["part", "fid"], "left")
        rf = uses.select("part", "rid", "pos", F.col("gid").alias("fid"), F.when(F.col("alike"), F.col("dir")).otherwise(1 - F.col("dir")).alias("dir"))
        made["RF"] = at(rf, "rid", "rid", rmap).select("rid", "pos", "fid", "dir").transform(shuffled)
        made["R"] = at(tables["R"], "rid", "rid", rmap).select("rid", "rtype", "gdim", "gent")
        if "RV" in tables:
            made["RV"] = at(at(tables["RV"], "vid", "vid", vmap), "rid", "rid", rmap).select("rid", "pos", "vid")
        top = rmap.select(F.col("gid").alias("id"), "part")
    every = None
    for dim, df in maps.items():
        row = df.select(F.lit(dim).alias("dim"), "part", "id", "gid")
        every = row if every is None else every.union(row)
    if "AV" in tables:
        values = tables["AV"].join(every, ["dim", "part", "id"]).groupBy("name", "dim", F.col("gid").alias("id"))
        made["AV"] = values.agg(F.min_by(F.struct("ival", "dval", "vval", "ref"), F.struct("part", tables["AV"]["id"])).alias("v")).select("name", "dim", "id", "v.*")
    if "SM" in tables:
        rows = tables["SM"].join(every, ["dim", "part", "id"]).groupBy("set", "dim", F.col("gid").alias("id")).agg(F.min(F.struct("part", "pos")).alias("o"))
        placed = number(rows.select("set", "dim", "id", F.struct("set", "o.part").alias("g"), F.col("o.pos").cast("long").alias("pos")), "k", "pos", group="g")
        low = placed.groupBy("set").agg(F.min("k").alias("low"))
        made["SM"] = placed.join(low, "set").select("set", (F.col("k") - F.col("low")).cast("int").alias("pos"), "dim", "id")
    made |= {t: tables[t] for t in SHARED if t in tables}
    return distribute(MeshFrame.empty(spark).with_tables(**made), top.transform(shuffled), layers)


def labelled_counts(p: PartedMesh) -> DataFrame:
    """``dim, part, ptype, n``."""
    out = None
    for dim, (name, _) in KIND.items():
        if name in p.tables:
            row = p.tables[name].groupBy("part", "ptype").agg(F.count("*").alias("n")).select(F.lit(dim).alias("dim"), "part", "ptype", "n")
            out = row if out is None else out.union(row)
    return out


__all__ = [
    "GHOST", "PartedMesh", "apart", "distribute", "from_global_ids", "gather_attribute", "global_ids", "labelled_counts", "partition", "read_distributed",
    "set_global_ids", "set_values", "update_attributes", "weave", "weave_meshes",
]
