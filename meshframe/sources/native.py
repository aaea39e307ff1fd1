"""The native ASCII format: header, vertices, edges, faces, regions, attributes; ids are positions from 1."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import MeshFrame, number
from .records import read, record, to_mesh, words_of, write_lines

#: Attribute entity kinds of the format and their dimension codes.
KINDS = {"MVERTEX": 0, "MEDGE": 1, "MFACE": 2, "MREGION": 3, "MALLTYPE": 5}
_BY_COUNT = {4: "TET", 5: "PYRAMID", 6: "PRISM", 8: "HEX"}


def parse(text: str) -> Iterator[dict]:
    """Records of one file. The first word names the format and is taken as it is; vertices must come first."""
    words = words_of(text)
    next(words)
    float(next(words))
    rep = next(words)
    nv, ne, nf, nr = (int(next(words)) for _ in range(4))
    whole, number_ = (lambda: int(next(words))), (lambda: float(next(words)))
    seen = False
    for word in words:
        if word == "vertices":
            seen = True
            for i in range(1, nv + 1):
                yield record("V", id=i, x=number_(), y=number_(), z=number_(), gdim=whole(), gent=max(0, whole()))
        elif not seen:
            raise ValueError("vertices must come first")
        elif word == "adjvertices":
            for _ in range(nv):
                for _ in range(whole()):
                    whole()
        elif word == "edges":
            for i in range(1, ne + 1):
                yield record("E", id=i, ref=whole(), pos=whole(), gdim=whole(), gent=max(0, whole()))
        elif word == "faces":
            by_edge = next(words) == "edge"
            for i in range(1, nf + 1):
                ids = [whole() for _ in range(whole())]
                for pos, x in enumerate(ids):
                    yield record("FE" if by_edge else "FV", id=i, pos=pos, ref=abs(x), dir=int(x > 0))
                yield record("F", id=i, pos=len(ids), gdim=whole(), gent=max(0, whole()))
        elif word == "regions":
            by_face = next(words) == "face"
            for i in range(1, nr + 1):
                ids = [whole() for _ in range(whole())]
                for pos, x in enumerate(ids):
                    yield record("RF" if by_face else "RV", id=i, pos=pos, ref=abs(x), dir=int(x > 0))
                yield record("R", id=i, name=None if by_face else _BY_COUNT.get(len(ids), "POLYHED"), gdim=whole(), gent=max(0, whole()))
        elif word == "adjregions":
            for _ in range(nr):
                for _ in range(whole()):
                    whole()
        elif word == "attributes":
            for name in words:
                kind, ncomp, entity, count = next(words), whole(), next(words), whole()
                if kind == "POINTER":
                    raise ValueError("pointer attributes cannot be in a file")
                yield record("AD", name=name, text=kind, pos=ncomp, dir=KINDS[entity])
                for _ in range(count):
                    dim, i = whole(), whole()
                    yield record("AV", name=name, text=kind, dir=dim, id=i, vals=[number_() for _ in range(ncomp)])
        else:
            raise ValueError(f"unknown section {word} ({rep})")


def read_mesh(spark: SparkSession, path: str, part: int = 0) -> MeshFrame:
    return to_mesh(read(spark, path, parse), spark, part)


def read_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of every file of a partitioned mesh."""
    return read(spark, paths, parse)


def lines(m: MeshFrame, header: str, version: str = "1.0", attributes: list[str] | None = None) -> DataFrame:
    """``sect, ord, line`` of a mesh in full representation; all attributes, or those named. ``header`` is the format's
    first word."""
    spark = m.V.sparkSession
    n = {d: m.table(d)[0].count() for d in range(4)}
    out = spark.createDataFrame([(0, 0, f"{header} {version}"), (0, 1, f"F1 {n[0]} {n[1]} {n[2]} {n[3]}"), (1, 0, "vertices")], "sect int, ord long, line string")

    def ids(df, key):
        return number(df.select(key), f"{key}_n", key)

    vn, en, fn = ids(m.V, "vid"), ids(m.E, "eid"), ids(m.F, "fid")
    text = lambda *cs: F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cs])
    out = out.union(m.V.join(vn, "vid").select(F.lit(1), "vid_n", text("x", "y", "z", "gdim", "gent")))
    ends = m.E.join(vn.select(F.col("vid").alias("v0"), F.col("vid_n").alias("a")), "v0").join(vn.select(F.col("vid").alias("v1"), F.col("vid_n").alias("b")), "v1").join(en, "eid")
    if n[1]:
        out = out.union(spark.createDataFrame([(2, 0, "edges")], out.schema)).union(ends.select(F.lit(2), "eid_n", text("a", "b", "gdim", "gent")))
    if n[2]:
        signed = m.FE.join(en, "eid").groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("dir") == 1, F.col("eid_n")).otherwise(-F.col("eid_n")).alias("e")))).alias("l"))
        loop = F.concat_ws(" ", F.transform("l", lambda s: s["e"].cast("string")))
        out = out.union(spark.createDataFrame([(3, 0, "faces edge")], out.schema)).union(m.F.join(signed, "fid").join(fn, "fid").select(F.lit(3), "fid_n", text(F.size("l").cast("string"), loop, "gdim", "gent")))
    if n[3]:
        rn = ids(m.R, "rid")
        signed = m.RF.join(fn, "fid").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("dir") == 1, F.col("fid_n")).otherwise(-F.col("fid_n")).alias("f")))).alias("l"))
        faces = F.concat_ws(" ", F.transform("l", lambda s: s["f"].cast("string")))
        out = out.union(spark.createDataFrame([(4, 0, "regions face")], out.schema)).union(m.R.join(signed, "rid").join(rn, "rid").select(F.lit(4), "rid_n", text(F.size("l").cast("string"), faces, "gdim", "gent")))
    ad = m.AD if attributes is None else m.AD.where(F.col("name").isin(attributes))
    names = {v: k for k, v in KINDS.items()}
    wanted = [r for r in ad.where("atype <> 'POINTER'").orderBy("name").collect()]  # definitions, a few per mesh
    if wanted:
        out = out.union(spark.createDataFrame([(5, 0, "attributes")], out.schema))
    for k, r in enumerate(wanted):
        av = m.AV.where(F.col("name") == r["name"])
        out = out.union(spark.createDataFrame([(6 + k, 0, f"{r['name']} {r['atype']} {r['ncomp']} {names[r['entdim']]} {av.count()}")], out.schema))
        value = F.when(F.col("vval").isNotNull(), F.concat_ws(" ", F.transform("vval", lambda x: x.cast("string")))).otherwise(F.coalesce(F.col("ival").cast("string"), F.col("dval").cast("string")))
        out = out.union(number(av, "o", "id", "dim").select(F.lit(6 + k), "o", text("dim", "id", value)))
    return out


def write_mesh(m: MeshFrame, path: str, header: str, single: bool = False, **options) -> None:
    write_lines(lines(m, header, **options), path, single)


__all__ = ["lines", "parse", "read_mesh", "read_parts", "write_mesh"]
