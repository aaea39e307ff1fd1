"""Exodus II files (classic netCDF): element blocks, node, side and element sets, variables of nodes and elements.

A file is parsed by one task, the files of a partitioned mesh (one per rank, ``name.parts.rank``) side by side. What
they hold becomes tables by joins: sides are matched to faces and edges by their corners. Files are written one per
part, by the task that has the part's rows, into a folder that all machines have mounted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame
from ..operators import adjacency
from ..working import settled
from .netcdf import Reader, build
from .records import FIELDS, RECORD, record, to_mesh

#: Element words of the format with their standard cells, and the corners of their sides in its order.
SURFACE, SOLID = ("TRI", "QUAD", "SHELL", "NSIDED"), {"TET": "TET", "PYR": "PYRAMID", "WED": "PRISM", "PRI": "PRISM", "HEX": "HEX"}
SIDES = {
    "TET": [[0, 1, 3], [1, 2, 3], [0, 3, 2], [0, 2, 1]],
    "PYRAMID": [[0, 1, 4], [1, 2, 4], [2, 3, 4], [0, 4, 3], [0, 3, 2, 1]],
    "PRISM": [[0, 1, 4, 3], [1, 2, 5, 4], [0, 3, 5, 2], [0, 2, 1], [3, 4, 5]],
    "HEX": [[0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [0, 4, 7, 3], [0, 3, 2, 1], [4, 5, 6, 7]],
}
CORNERS = {"TET": 4, "PYRAMID": 5, "PRISM": 6, "HEX": 8}
WORDS = {"TET": "TETRA", "PYRAMID": "PYRAMID", "PRISM": "WEDGE", "HEX": "HEX"}
#: Fixed value: variables of this infix and a number are components of one vector.
COMPONENT = "_veccomp"


def _blocks(f: Reader) -> Iterator[tuple[int, str, list[list[int]] | np.ndarray]]:
    """Id, element word and node numbers of each block."""
    ids = f.get("eb_prop1") if "eb_prop1" in f else np.arange(1, f.dims.get("num_el_blk", 0) + 1)
    for k, block in enumerate(ids.tolist(), 1):
        if f"connect{k}" not in f:
            continue
        nodes, word = f.get(f"connect{k}"), f.vars[f"connect{k}"][4].get("elem_type", "").strip("\0 ").upper()
        if f"ebepecnt{k}" in f:
            nodes = np.split(nodes.ravel(), np.cumsum(f.get(f"ebepecnt{k}"))[:-1])
        yield block, word, nodes


def parse(data: bytes) -> Iterator[dict]:
    """Records of one file: vertices, elements with their loops or corners, block and set members, sides, variables
    (the last time step)."""
    f = Reader(data)
    nv, nd = f.dims.get("num_nodes", 0), f.dims.get("num_dim", 3)
    xyz = np.zeros((3, nv))
    for d in range(nd):
        xyz[d] = f.get("coord")[d] if "coord" in f else f.get(f"coord{'xyz'[d]}")
    gids = f.get("node_num_map").tolist() if "node_num_map" in f else range(1, nv + 1)
    for i, (p, g) in enumerate(zip(xyz.T.tolist(), gids, strict=True), 1):
        yield record("V", id=i, ref=g, x=p[0], y=p[1], z=p[2], gdim=4, gent=0)
    solid, corners, e = False, [], 0
    numbers = f.get("elem_num_map").tolist() if "elem_num_map" in f else range(1, f.dims.get("num_elem", 0) + 1)
    for block, word, elements in _blocks(f):
        kind = next((c for w, c in SOLID.items() if word.startswith(w)), None)
        if kind is None and not word.startswith(SURFACE):
            raise ValueError(f"elements of kind {word} cannot be read")
        solid |= kind is not None
        for nodes in elements:
            e += 1
            n = CORNERS[kind] if kind else 3 if word.startswith("TRI") else 4 if word.startswith(("QUAD", "SHELL")) else len(nodes)
            own = [int(x) for x in nodes[:n]]  # middle nodes of higher orders are not corners
            corners.append((kind, own))
            yield record("R" if kind else "F", id=e, ref=numbers[e - 1], pos=n, name=kind, gdim=3 if kind else 2, gent=block)
            for pos, x in enumerate(own):
                yield record("RV" if kind else "FV", id=e, pos=pos, ref=x)
            yield record("SM", name=f"matset_{block}", dir=3 if kind else 2, pos=e, id=e)
            yield record("AV", name="elemblock", text="INT", dir=3 if kind else 2, id=e, vals=[float(block)])
    top = 3 if solid else 2
    if e:
        yield record("AD", name="elemblock", text="INT", pos=1, dir=top)
    for what, members, dim in (("ns", "node_ns", 0), ("els", "elem_els", top)):
        ids = f.get(f"{what}_prop1").tolist() if f"{what}_prop1" in f else []
        for k, s in enumerate(ids, 1):
            name = f"{'node' if what == 'ns' else 'elem'}set_{s}"
            got = f.get(f"{members}{k}").tolist() if f"{members}{k}" in f else []
            for pos, x in enumerate(got):
                yield record("SM", name=name, dir=dim, pos=pos, id=x)
                if what == "ns":
                    yield record("AV", name=name, text="INT", dir=0, id=x, vals=[1.0])
            if what == "ns":
                yield record("AD", name=name, text="INT", pos=1, dir=0)
    for k, s in enumerate(f.get("ss_prop1").tolist() if "ss_prop1" in f else [], 1):
        for pos, (x, side) in enumerate(zip(f.get(f"elem_ss{k}").tolist(), f.get(f"side_ss{k}").tolist(), strict=True)):
            kind, own = corners[x - 1]
            places = SIDES[kind][side - 1] if kind else [side - 1, side % len(own)]
            yield record("SS", name=f"sideset_{s}", pos=pos, id=x, vals=sorted(float(own[p]) for p in places))
    for where, dim, key in (("nod", 0, "vals_nod_var"), ("elem", top, "vals_elem_var")):
        names = f.strings(f"name_{where}_var") if f"name_{where}_var" in f else []
        columns = {}
        for k, name in enumerate(names, 1):
            if where == "nod":
                columns[name] = f.get(f"{key}{k}")[-1] if f"{key}{k}" in f and f.records else np.zeros(nv)
            else:
                parts = []
                for b, (_, _, elements) in enumerate(_blocks(f), 1):
                    has = f"{key}{k}eb{b}" in f and f.records
                    parts.append(f.get(f"{key}{k}eb{b}")[-1] if has else np.zeros(len(elements)))
                columns[name] = np.concatenate(parts) if parts else np.zeros(0)
        fields: dict[str, list[np.ndarray]] = {}
        for name, values in columns.items():
            fields.setdefault(name.split(COMPONENT)[0] if COMPONENT in name else name, []).append(values)
        for name, parts in fields.items():
            vector = f"{name}{COMPONENT}0" in columns
            kind = ("VECTOR" if len(parts) == nd else "TENSOR") if vector else "DOUBLE"
            yield record("AD", name=name, text=kind, pos=len(parts), dir=dim)
            for i, row in enumerate(np.array(parts).T.tolist(), 1):
                yield record("AV", name=name, text=kind, dir=dim, id=i, vals=row)


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of all files; ``part`` is a file's rank in name order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    found = spark.read.format("binaryFile").load(paths)
    names = sorted(r[0] for r in found.select("path").distinct().collect())  # one name a file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = []
                for row in parse(bytes(content)):
                    held.append(row | {"part": names.index(path)})
                    if len(held) == 20_000:
                        yield pd.DataFrame(held, columns=["part", *FIELDS])
                        held = []
                yield pd.DataFrame(held, columns=["part", *FIELDS])

    return found.select("path", "content").repartition(max(1, len(names))).mapInPandas(run, RECORD)


def _sets(rows: DataFrame, m: MeshFrame) -> MeshFrame:
    """Members of blocks and node sets as they are, sides by the faces or edges on their corners."""
    plain = rows.where("t = 'SM'").select(F.col("name").alias("set"), "pos", F.col("dir").alias("dim"), "id")
    asked = rows.where("t = 'SS'").select(F.col("name").alias("set"), "pos", F.transform("vals", lambda x: x.cast("long")).alias("key"))
    faces = m.FV.groupBy("fid").agg(F.array_sort(F.collect_set("vid")).alias("key")).select("key", F.lit(2).alias("dim"), F.col("fid").alias("id"))
    edges = m.E.select(F.array("lo", "hi").alias("key"), F.lit(1).alias("dim"), F.col("eid").alias("id"))
    sides = asked.join(faces.union(edges), "key").select("set", "pos", "dim", "id")
    sm = plain.union(sides)
    return m.with_tables(SM=sm.select(*m.SM.columns), SD=sm.select("set", F.col("dim").alias("entdim")).distinct())


def read_exodus(spark: SparkSession, path: str, part: int = 0, elements: DataFrame | None = None) -> MeshFrame:
    """The mesh of one file. ``elements`` (``id``), if given, are the only elements taken, with their vertices; ids stay
    those of the file."""
    rows = records(spark, path).where(F.col("part") == part).persist()
    if elements is not None:
        some = elements.select("id").distinct()
        parts = rows.where("t in ('R', 'F', 'RV', 'FV', 'SS')").join(some, "id", "left_semi")
        used = parts.where("t in ('RV', 'FV')").select(F.col("ref").alias("id")).distinct()
        of_vertices = rows.where("t = 'V' or (t in ('AV', 'SM') and dir = 0)").join(used, "id", "left_semi")
        of_elements = rows.where("t in ('AV', 'SM') and dir <> 0").join(some, "id", "left_semi")
        rows = parts.unionByName(of_vertices).unionByName(of_elements).unionByName(rows.where("t = 'AD'"))
    m = _mesh(rows, spark)
    kind = F.when(F.col("t") == "V", 0).when(F.col("t") == "F", 2).otherwise(3)
    g = rows.where("t in ('V', 'F', 'R')").select(kind.alias("dim"), "id", F.col("ref").alias("gid"))
    return _sets(rows, m).with_tables(G=g)


def _mesh(rows: DataFrame, spark: SparkSession) -> MeshFrame:
    return to_mesh(rows.where("t in ('V', 'F', 'FV', 'R', 'RV', 'AD', 'AV')"), spark)


def read_parts(spark: SparkSession, paths: list[str]) -> MeshFrame:
    """Vertices and elements of a mesh that came in several files, under the ids of the files' maps; a vertex of several files
    is there once. Each file is one task's work, so tasks don't grow with the mesh if its files don't."""
    rows = records(spark, paths).transform(settled)
    points = rows.where("t = 'V'").select("part", F.col("id").alias("ref"), F.col("ref").alias("vid"))
    cells = rows.where("t in ('F', 'R')").select("part", "id", F.col("ref").alias("gid"))
    uses = rows.where("t in ('FV', 'RV')").join(points.hint("merge"), ["part", "ref"]).join(cells.hint("merge"), ["part", "id"]).withColumns({"id": F.col("gid"), "ref": F.col("vid")})
    named = rows.where("t in ('F', 'R')").unionByName(rows.where("t = 'V'").dropDuplicates(["ref"])).withColumn("id", F.col("ref"))
    return _mesh(named.unionByName(uses.select(*rows.columns)).withColumn("part", F.lit(0)).transform(settled), spark)


def element_graph(spark: SparkSession, path: str | list[str], coordinates: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """``src, dst`` of elements that share a side, straight from a file, and their centroids (``id, x, y, z``) if asked. Of a list
    of files, those of a mesh in parts, ids are those of the maps, and sides may lie between files."""
    m = _mesh(records(spark, path).persist(), spark) if isinstance(path, str) else read_parts(spark, path)
    solid = not m.R.isEmpty()
    centres = None
    if coordinates:
        inc, key = (m.RV, "rid") if solid else (m.FV, "fid")
        centres = inc.join(m.V, "vid").groupBy(F.col(key).alias("id")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return adjacency.element_graph(m, solid), centres


def _file(rows: pd.DataFrame) -> bytes:
    """One part's file from its rows (``t, id, pos, ref, name, vals``), all numbered from 1 within the part."""
    by = dict(tuple(rows.groupby("t")))
    v = by["V"].sort_values("id")
    xyz = np.array(v["vals"].tolist(), float).reshape(-1, 3)
    elements = by["E"].sort_values("id")
    flat = not elements["name"].isin(list(WORDS)).any()
    dims = {"len_string": 33, "time_step": 0, "num_dim": 2 if flat and not xyz[:, 2].any() else 3, "num_nodes": len(xyz), "num_elem": len(elements)}
    out: dict[str, tuple[list[str], np.ndarray, dict]] = {}
    for d in range(dims["num_dim"]):
        out[f"coord{'xyz'[d]}"] = (["num_nodes"], xyz[:, d].astype("f8"), {})
    out["node_num_map"] = (["num_nodes"], v["ref"].to_numpy().astype("i4"), {})
    out["elem_num_map"] = (["num_elem"], elements["ref"].to_numpy().astype("i4"), {})
    blocks = list(elements.groupby(["pos", "name"], sort=True))
    dims["num_el_blk"] = len(blocks)
    out["eb_prop1"] = (["num_el_blk"], np.array([b for (b, _), _ in blocks], "i4"), {"name": "ID"})
    for k, ((_, kind), g) in enumerate(blocks, 1):
        dims[f"num_el_in_blk{k}"] = len(g)
        if kind == "POLYGON":
            nodes = np.concatenate([np.array(x, "i4") for x in g["vals"]])
            dims[f"num_nod_per_el{k}"] = len(nodes)
            out[f"connect{k}"] = ([f"num_nod_per_el{k}"], nodes, {"elem_type": "nsided"})
            out[f"ebepecnt{k}"] = ([f"num_el_in_blk{k}"], np.array([len(x) for x in g["vals"]], "i4"), {})
        else:
            nodes = np.array(g["vals"].tolist(), "i4")
            dims[f"num_nod_per_el{k}"] = nodes.shape[1]
            out[f"connect{k}"] = ([f"num_el_in_blk{k}", f"num_nod_per_el{k}"], nodes, {"elem_type": WORDS.get(kind, kind)})
    if "NS" in by:
        sets = list(by["NS"].groupby("name", sort=True))
        dims["num_node_sets"] = len(sets)
        out["ns_prop1"] = (["num_node_sets"], np.array([int(s.rpartition("_")[2]) for s, _ in sets], "i4"), {"name": "ID"})
        for k, (_, g) in enumerate(sets, 1):
            dims[f"num_nod_ns{k}"] = len(g)
            out[f"node_ns{k}"] = ([f"num_nod_ns{k}"], g.sort_values("pos")["id"].to_numpy().astype("i4"), {})
    if "SS" in by:
        sets = list(by["SS"].groupby("name", sort=True))
        dims["num_side_sets"] = len(sets)
        out["ss_prop1"] = (["num_side_sets"], np.array([int(s.rpartition("_")[2]) for s, _ in sets], "i4"), {"name": "ID"})
        for k, (_, g) in enumerate(sets, 1):
            g = g.sort_values("pos")
            dims[f"num_side_ss{k}"] = len(g)
            out[f"elem_ss{k}"] = ([f"num_side_ss{k}"], g["id"].to_numpy().astype("i4"), {})
            out[f"side_ss{k}"] = ([f"num_side_ss{k}"], g["ref"].to_numpy().astype("i4"), {})
    out["time_whole"] = (["time_step"], np.zeros(1), {})
    for t, where, n in (("NV", "nod", len(xyz)), ("EV", "elem", len(elements))):
        if t not in by:
            continue
        names, columns = [], []
        for name, g in by[t].groupby("name", sort=True):
            values = np.zeros((n, len(g["vals"].iloc[0])))
            values[g["id"].to_numpy() - 1] = np.array(g["vals"].tolist(), float)
            for c in range(values.shape[1]):
                names.append(f"{name}{COMPONENT}{c}" if values.shape[1] > 1 else name)
                columns.append(values[:, c])
        dims[f"num_{where}_var"] = len(names)
        out[f"name_{where}_var"] = ([f"num_{where}_var", "len_string"], np.array([list(x.encode().ljust(33, b"\0")) for x in names], "u1").view("S1"), {})
        for k, values in enumerate(columns, 1):
            if where == "nod":
                out[f"vals_nod_var{k}"] = (["time_step", "num_nodes"], values[None, :], {})
            else:
                place = elements["id"].to_numpy()
                for b, (_, g) in enumerate(blocks, 1):
                    out[f"vals_elem_var{k}eb{b}"] = (["time_step", f"num_el_in_blk{b}"], values[np.searchsorted(place, g["id"].to_numpy())][None, :], {})
    return build(dims, {"api_version": 5.0, "version": 5.0, "floating_point_word_size": 8, "file_size": 1, "title": "mesh"}, out)


def write_exodus(m: MeshFrame, folder: str, name: str = "mesh", parts: DataFrame | None = None, attributes: list[str] | None = None) -> DataFrame:
    """Write one file per part of ``parts`` (``id``, ``part`` of elements; all are part 0 without) and return ``part, path,
    n_elements``. A part has its own elements and their vertices; maps carry the mesh's ids. Blocks are the elements'
    classification; node sets, side sets and numeric attributes of vertices and elements go along (all, or those named).
    ``folder`` is a path that every machine has mounted."""
    solid = not m.R.isEmpty()
    inc, key, el = (m.RV, "rid", m.R) if solid else (m.FV, "fid", m.F)
    kind = F.col("rtype") if solid else F.when(F.col("n") == 3, "TRI").when(F.col("n") == 4, "QUAD").otherwise("POLYGON")
    home = (el.select(F.col(key).alias("id"), F.lit(0).alias("part")) if parts is None else parts.select("id", "part")).withColumnRenamed("id", key)
    many = 1 if parts is None else parts.agg(F.max("part")).first()[0] + 1
    own = inc.join(home, key)
    # a part's file is one task's work, so its numbers may be too; elements are numbered block by block
    place = lambda *k: F.row_number().over(Window.partitionBy("part").orderBy(*k)).cast("long")
    vn = own.select("part", "vid").distinct().withColumn("n", place("vid"))
    blocks = el.select(key, F.greatest("gent", F.lit(1)).alias("block"), kind.alias("kind"))
    en = home.join(blocks, key).withColumn("e", place("block", "kind", key))
    row = lambda df, t, **c: df.select("part", F.lit(t).alias("t"), *[c.get(k, F.lit(None)).cast(T).alias(k) for k, T in (("id", "long"), ("pos", "long"), ("ref", "long"), ("name", "string"), ("vals", "array<double>"))])
    col = F.col
    out = row(vn.join(m.V, "vid"), "V", id=col("n"), ref=col("vid"), vals=F.array("x", "y", "z"))
    nodes = own.join(vn.withColumnRenamed("n", "node"), ["part", "vid"]).groupBy("part", key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"].cast("double")).alias("nodes"))
    out = out.union(row(nodes.join(en, ["part", key]), "E", id=col("e"), ref=col(key), pos=col("block"), name=col("kind"), vals=col("nodes")))
    out = out.union(row(m.SM.where("dim = 0 and set like 'nodeset%'").join(vn, col("id") == col("vid")).drop("id"), "NS", id=col("n"), pos=col("pos"), name=col("set")))
    sides = _element_sides(m, solid)
    marked = m.SM.where(f"set like 'sideset%' and dim = {2 if solid else 1}").select("set", "pos", col("id").alias("side_id")).join(sides, "side_id")
    one = marked.groupBy("set", "pos").agg(F.min(F.struct("element", "side")).alias("u")).select("set", "pos", col("u.element").alias(key), "u.side")
    out = out.union(row(one.join(en, key), "SS", id=col("e"), pos=col("pos"), ref=col("side"), name=col("set")))
    ad = m.AD.where("atype in ('INT', 'DOUBLE', 'VECTOR', 'TENSOR') and name <> 'elemblock' and name not like 'nodeset%'")
    ad = ad if attributes is None else ad.where(col("name").isin(attributes))
    values = m.AV.join(ad.select("name"), "name").withColumn("x", F.coalesce("vval", F.array(F.coalesce(col("ival").cast("double"), "dval"))))
    out = out.union(row(values.where("dim = 0").join(vn, col("id") == col("vid")).drop("id"), "NV", id=col("n"), name=col("name"), vals=col("x")))
    out = out.union(row(values.where(f"dim = {3 if solid else 2}").join(en, col("id") == col(key)).drop("id"), "EV", id=col("e"), name=col("name"), vals=col("x")))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        import os

        part = int(rows["part"].iloc[0])
        path = os.path.join(folder.removeprefix("file://"), f"{name}.exo" if many == 1 else f"{name}.{many}.{part:0{len(str(many))}d}")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(_file(rows))
        os.replace(f"{path}.part", path)  # a task that runs again replaces its own file
        return pd.DataFrame({"part": [part], "path": [path], "n_elements": [int((rows["t"] == "E").sum())]})

    done = out.groupBy("part").applyInPandas(write, "part int, path string, n_elements long")
    return m.V.sparkSession.createDataFrame(done.collect(), done.schema)  # one row a part


def _element_sides(m: MeshFrame, solid: bool) -> DataFrame:
    """``side_id, element, side``: which side (from 1) of which element a face or edge is."""
    if not solid:
        return m.FE.select(F.col("eid").alias("side_id"), F.col("fid").alias("element"), (F.col("pos") + 1).alias("side"))
    spark = m.V.sparkSession
    tpl = F.broadcast(spark.createDataFrame([(t, k + 1, p) for t, sides in SIDES.items() for k, s in enumerate(sides) for p in s], "rtype string, side int, pos int"))  # 66 rows
    corners = m.RV.join(m.R.select("rid", "rtype"), "rid").join(tpl, ["rtype", "pos"]).groupBy("rid", "side").agg(F.array_sort(F.collect_set("vid")).alias("key"))
    faces = m.FV.groupBy("fid").agg(F.array_sort(F.collect_set("vid")).alias("key"))
    return corners.join(faces, "key").select(F.col("fid").alias("side_id"), F.col("rid").alias("element"), "side")
