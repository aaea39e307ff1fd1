"""GMV and X3D in ASCII."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, number
from ..working import settled, shuffled
from .records import read, record, to_mesh, words_of, write_lines

#: Cell words of the GMV format.
FACE_WORDS, CELL_WORDS = {"tri": 3, "quad": 4}, {"tet": "TET", "pyramid": "PYRAMID", "prism": "PRISM", "hex": "HEX"}


def parse_gmv(text: str) -> Iterator[dict]:
    """Nodes, cells, materials and variables of an ASCII file; other sections end the reading."""
    words = words_of(text)
    if next(words) != "gmvinput" or next(words) != "ascii":
        raise ValueError("not an ASCII GMV file")
    nv = nc = 0
    kinds: list[str] = []  # of cells, each word once in memory
    corners, sizes, material = array("q"), array("q"), array("q")
    known: dict[str, str] = {}
    for word in words:
        if word in ("nodes", "nodev"):
            nv = int(next(words))
            values = array("d", (float(next(words)) for _ in range(3 * nv)))
            for i in range(nv):
                x, y, z = values[3 * i : 3 * i + 3] if word == "nodev" else (values[i], values[nv + i], values[2 * nv + i])
                yield record("V", id=i + 1, x=x, y=y, z=z, gdim=4, gent=0)
        elif word == "cells":
            nc = int(next(words))
            for _ in range(nc):
                kind = next(words)
                kinds.append(known.setdefault(kind, kind))
                sizes.append(int(next(words)))
                corners.extend(int(next(words)) for _ in range(sizes[-1]))
        elif word == "material":
            k, where = int(next(words)), int(next(words))
            for _ in range(k):
                next(words)
            material = array("q", (int(next(words)) for _ in range(nv if where else nc)))
            material = array("q") if where else material
        elif word == "variable":
            for name in words:
                if name == "endvars":
                    break
                where = int(next(words))
                kind = "INT" if name in ("itetclr", "icr") else "DOUBLE"
                dim = 0 if where == 1 else (3 if any(c in CELL_WORDS for c in known) else 2)
                values = array("d", (float(next(words)) for _ in range(nv if where == 1 else nc)))
                if name == "itetclr" and not material:
                    material = array("q", (int(x) for x in values))
                yield record("AD", name=name, text=kind, pos=1, dir=dim)
                for i, x in enumerate(values):
                    yield record("AV", name=name, text=kind, dir=dim, id=i + 1, vals=[x])
        else:
            break
    at = 0
    for i, (kind, size) in enumerate(zip(kinds, sizes, strict=True), 1):
        ids, at = corners[at : at + size], at + size
        t, u, d = ("F", "FV", 2) if kind in FACE_WORDS or kind == "general" else ("R", "RV", 3)
        for pos, x in enumerate(ids):
            yield record(u, id=i, pos=pos, ref=x)
        yield record(t, id=i, pos=len(ids), name=CELL_WORDS.get(kind), gdim=d, gent=material[i - 1] if material else 1)


def read_gmv(spark: SparkSession, path: str) -> MeshFrame:
    return to_mesh(read(spark, path, parse_gmv), spark)


def gmv_lines(m: MeshFrame) -> DataFrame:
    """``sect, ord, line`` of triangles and quads, or of standard cells, with materials and numeric attributes of
    vertices and elements."""
    spark = m.V.sparkSession
    solid = not m.R.isEmpty()
    inc, key, elements = (m.RV, "rid", m.R) if solid else (m.FV, "fid", m.F)
    nv, nc = m.V.count(), elements.count()
    vn, cn = number(m.V, "k", "vid"), number(elements, "k", key)
    head = spark.createDataFrame([(0, 0, "gmvinput ascii"), (0, 1, f"nodev {nv}"), (2, 0, f"cells {nc}"), (4, 0, f"material {max(1, elements.agg(F.max('gent')).first()[0] or 1)} 0"), (99, 0, "endgmv")], "sect int, ord long, line string")
    top = max(1, elements.agg(F.max("gent")).first()[0] or 1)
    head = head.union(spark.createDataFrame([(4, i, f"mat{i}") for i in range(1, top + 1)], head.schema))
    v = vn.select(F.lit(1), "k", F.concat_ws(" ", "x", "y", "z"))
    loops = inc.join(vn.select("vid", F.col("k").alias("n")), "vid").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("l")).join(cn, key)
    word = F.lower("rtype") if solid else F.when(F.size("l") == 3, "tri").when(F.size("l") == 4, "quad").otherwise("general")
    cells = loops.select(F.lit(3), "k", F.concat_ws(" ", word, F.size("l").cast("string"), F.concat_ws(" ", F.transform("l", lambda s: s["n"].cast("string")))))
    out = head.union(v).union(cells).union(cn.select(F.lit(5), "k", F.greatest(F.col("gent"), F.lit(1)).cast("string")))
    for j, r in enumerate(m.AD.where("atype in ('INT', 'DOUBLE') and ncomp = 1").orderBy("name").collect()):  # definitions
        where = 1 if r["entdim"] == 0 else 0
        base, k = (vn, "vid") if where else (cn, key)
        val = m.AV.where(F.col("name") == r["name"]).select(F.col("id").alias(k), F.coalesce(F.col("ival").cast("double"), "dval").alias("x"))
        if j == 0:
            out = out.union(spark.createDataFrame([(6, 0, "variable")], out.schema))
        out = out.union(spark.createDataFrame([(7 + 2 * j, 0, f"{r['name']} {where}")], out.schema)).union(base.join(val, k, "left").select(F.lit(8 + 2 * j), "k", F.coalesce("x", F.lit(0.0)).cast("string")))
        last = 9 + 2 * j
    if not m.AD.where("atype in ('INT', 'DOUBLE') and ncomp = 1").isEmpty():
        out = out.union(spark.createDataFrame([(last, 0, "endvars")], out.schema))
    return out


def write_gmv(m: MeshFrame, path: str, single: bool = False) -> None:
    write_lines(gmv_lines(m), path, single)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``k, words`` of the lines of a file, or of a folder with its pieces in name order, that aren't blank; ``k`` grows along the
    text. Lines come in the order of the text within a split of a file."""
    split = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = spark.read.text(path).select(*[F.col(c).alias(n) for c, n in zip(split, ("file", "start"), strict=True)], F.monotonically_increasing_id().alias("m"), "value").transform(settled)
    sizes = lines.groupBy("file", "start").agg(F.min("m").alias("low"), F.count("*").alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "start", "low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))  # one row a split
    words = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    return lines.join(F.broadcast(sizes), ["file", "start"]).select((F.col("o") + F.col("m") - F.col("low")).alias("k"), words.alias("words")).where("words[0] <> ''").transform(shuffled)


def read_x3d(spark: SparkSession, path: str) -> MeshFrame:
    """Nodes, faces by node and cells by face, line by line, so that no task has a whole file. A face that two cells list apart is
    one face; ids of faces follow the first listing."""
    lines = _numbered(spark, path)
    sizes, at, marks = {}, {}, []
    told = F.col("words")[0].isin("nodes", "faces", "elements", "numdim")
    for k, words in lines.where((F.size("words") == 1) | (told & (F.size("words") == 2))).orderBy("k").collect():  # headings
        if len(words) == 1:
            at[words[0]] = k
            marks.append(k)
        else:
            sizes[words[0]] = int(words[1])

    def section(name: str, n: int) -> DataFrame:
        end = min((k for k in marks if k > at[name]), default=None)
        df = lines.where((F.col("k") > at[name]) & (F.lit(True) if end is None else F.col("k") < end))
        got = df.count()
        if got < n:
            raise ValueError(f"{path} has {got} of {n} lines of {name}")
        if got == n:
            return df
        return number(df, "__n", "k").where(F.col("__n") <= n).drop("__n")  # what follows is no part of it

    whole = lambda a: F.transform(a, lambda x: x.cast("long"))
    word = lambda i: F.col("words")[i]
    listed = F.slice("words", F.lit(3), word(1).cast("int"))
    v = section("nodes", sizes["nodes"]).select(word(0).cast("long").alias("vid"), *[word(i).cast("double").alias(c) for i, c in enumerate("xyz", 1)], F.lit(4).alias("gdim"), F.lit(0).cast("long").alias("gent")).transform(shuffled)
    sides = section("faces", sizes["faces"]).select("k", word(0).cast("long").alias("i"), whole(listed).alias("loop")).withColumn("key", F.array_sort("loop")).transform(shuffled)
    first = sides.groupBy("key").agg(F.min(F.struct("k", "loop")).alias("o")).select("key", "o.*")
    faces = number(first, "fid", "k").select("key", "fid", "loop").transform(shuffled)
    n = F.size("loop")
    own = sides.join(faces.select("key", "fid", F.col("loop").alias("first")), "key")
    after = F.element_at("first", (F.array_position("first", F.col("loop")[0]) % n + 1).cast("int"))
    use = own.select("i", "fid", ((n > 1) & (after == F.col("loop")[1])).cast("int").alias("dir")).transform(shuffled)
    cells = section("cells", sizes["elements"]).select(word(0).cast("long").alias("rid"), whole(listed).alias("l")).transform(shuffled)
    rf = cells.select("rid", F.posexplode("l").alias("pos", "i")).join(use, "i", "left")
    lost = F.raise_error(F.concat(F.lit("no face "), F.col("i").cast("string"))).cast("long")
    rf = rf.select("rid", "pos", F.when(F.col("fid").isNull(), lost).otherwise(F.col("fid")).alias("fid"), "dir").transform(shuffled)
    f = faces.select("fid", n.alias("n"), F.lit(4).alias("gdim"), F.lit(0).cast("long").alias("gent"))
    r = cells.select("rid", F.lit("POLYHED").alias("rtype"), F.lit(3).alias("gdim"), F.lit(1).cast("long").alias("gent"))
    return MeshFrame.from_faces(v, faces.select("fid", F.posexplode("loop").alias("pos", "vid")), f).with_tables(R=r, RF=rf)


#: Importers by format name.
READERS = {"gmv": read_gmv, "x3d": read_x3d}
