"""A mesh as a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import KIND, SCHEMAS, TEMPLATES, UNKNOWN_DIM, UNKNOWN_ID
from .working import settled, shared_dir


def number(df: DataFrame, name: str, major: str, *minor: str, start: int = 1, block: int = 65_536, group: str | None = None) -> DataFrame:
    """Add dense ids in the order of (``major``, ``minor``...), or of (``group``, ``major``, ...). ``major`` is an integer
    column.

    Blocks of ``major`` values are numbered on their own and moved by the sizes of the blocks before, so that no
    task orders the whole table; only one row per block (of 65,536 values) meets in a single prefix sum."""
    df = df.withColumn("__b", F.floor(F.col(major) / block).cast("long"))
    keys = ["__b"] if group is None else [group, "__b"]
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    own = Window.partitionBy(*keys).orderBy(major, *minor)
    return df.withColumn("__r", F.row_number().over(own)).join(offsets, keys).withColumn(name, F.col("__o") + F.col("__r") + (start - 1)).drop("__b", "__o", "__r")


def half_edges(fv: DataFrame) -> DataFrame:
    """``fid, pos, v0, v1`` for each side of each loop."""
    w = Window.partitionBy("fid").orderBy("pos")
    first = F.first("vid").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return fv.select("fid", "pos", F.col("vid").alias("v0"), F.coalesce(F.lead("vid").over(w), first).alias("v1"))


@dataclass(frozen=True)
class MeshFrame:
    """Tables by name (see ``schema.SCHEMAS``) and metadata. All operators return new bundles; nothing is changed."""

    tables: dict[str, DataFrame]
    meta: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @classmethod
    def empty(cls, spark: SparkSession, rep: str = "F1") -> MeshFrame:
        return cls({k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()}, {"rep": rep})

    @classmethod
    def from_faces(cls, v: DataFrame, fv: DataFrame, f: DataFrame | None = None, settle: bool = False) -> MeshFrame:
        """A surface mesh from vertices and ordered loops; edges are derived and defined from low to high vertex. With
        ``settle`` what several tables are derived from is worked out once, now, and read from the shared folder."""
        spark = v.sparkSession
        once = settled if settle else lambda df: df
        sides = once(half_edges(fv).withColumns({"lo": F.least("v0", "v1"), "hi": F.greatest("v0", "v1")}))
        e = once(number(sides.select("lo", "hi").distinct(), "eid", "lo", "hi", block=4096))  # a vertex has many edges
        edges = e.select("eid", F.col("lo").alias("v0"), F.col("hi").alias("v1"), "lo", "hi", F.lit(UNKNOWN_DIM).alias("gdim"), F.lit(UNKNOWN_ID).cast("long").alias("gent"))
        fe = sides.join(e, ["lo", "hi"]).select("fid", "pos", "eid", (F.col("v0") == F.col("lo")).cast("int").alias("dir"))
        faces = f if f is not None else fv.groupBy("fid").agg(F.count("*").cast("int").alias("n")).select("fid", "n", F.lit(2).alias("gdim"), F.lit(1).cast("long").alias("gent"))
        made = cls.empty(spark)
        return made.with_tables(V=v, E=edges, F=faces, FE=fe, FV=fv)

    @classmethod
    def from_regions(cls, v: DataFrame, rv: DataFrame, rtype: str = "HEX", r: DataFrame | None = None, settle: bool = False) -> MeshFrame:
        """A solid mesh of standard cells from ordered vertex lists; faces and edges are derived. Cells are of the type that
        ``r`` (``rid, rtype, gdim, gent``) says, or all of ``rtype``.

        A face shared by two cells is defined by the cell of the smaller id (direction 1 there, 0 in the other). ``settle`` as
        in ``from_faces``."""
        spark = v.sparkSession
        once = settled if settle else lambda df: df
        template = [(t, lf, k, lv) for t in TEMPLATES for lf, loop in enumerate(TEMPLATES[t]) for k, lv in enumerate(loop)]
        tpl = F.broadcast(spark.createDataFrame(template, "rtype string, lf int, k int, lv int"))  # 70 rows
        typed = rv.withColumn("rtype", F.lit(rtype)) if r is None else rv.join(r.select("rid", "rtype"), "rid")
        uses = typed.join(tpl, (typed["pos"] == tpl["lv"]) & (typed["rtype"] == tpl["rtype"])).groupBy("rid", "lf").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "vid"))), lambda s: s["vid"]).alias("loop"))
        keyed = once(uses.withColumn("key", F.array_sort("loop")))
        first = keyed.groupBy("key").agg(F.min(F.struct("rid", "lf", "loop")).alias("o"))
        faces = once(number(first.select("key", "o.*"), "fid", "rid", "lf"))
        fv = faces.select("fid", F.posexplode("loop").alias("pos", "vid"))
        rf = keyed.join(faces.select("key", "fid", F.col("rid").alias("owner")), "key").select("rid", F.col("lf").alias("pos"), "fid", (F.col("rid") == F.col("owner")).cast("int").alias("dir"))
        f = faces.select("fid", F.size("loop").alias("n"), F.lit(UNKNOWN_DIM).alias("gdim"), F.lit(UNKNOWN_ID).cast("long").alias("gent"))
        regions = r if r is not None else rv.select("rid").distinct().select("rid", F.lit(rtype).alias("rtype"), F.lit(3).alias("gdim"), F.lit(1).cast("long").alias("gent"))
        return cls.from_faces(v, fv, f, settle).with_tables(R=regions, RF=rf, RV=rv)

    @classmethod
    def from_lists(cls, spark: SparkSession, points: list, faces: list[list[int]] | None = None, regions: list[list[int]] | None = None) -> MeshFrame:
        """A small mesh from literals: points, and the vertex numbers (from 1) of faces or of standard cells, not both."""
        if (faces is None) == (regions is None):
            raise ValueError("give faces or regions")
        v = spark.createDataFrame([(i, *map(float, p), UNKNOWN_DIM, UNKNOWN_ID) for i, p in enumerate(points, 1)], SCHEMAS["V"])
        rows = [(i, k, x) for i, ids in enumerate(faces or regions, 1) for k, x in enumerate(ids)]
        if faces is not None:
            return cls.from_faces(v, spark.createDataFrame(rows, SCHEMAS["FV"]))
        kinds = {4: "TET", 5: "PYRAMID", 6: "PRISM", 8: "HEX"}
        r = spark.createDataFrame([(i, kinds[len(ids)], 3, 1) for i, ids in enumerate(regions, 1)], SCHEMAS["R"])
        return cls.from_regions(v, spark.createDataFrame(rows, SCHEMAS["RV"]), r=r)

    def with_tables(self, **tables: DataFrame) -> MeshFrame:
        return replace(self, tables=self.tables | tables)

    def with_meta(self, **meta) -> MeshFrame:
        return replace(self, meta=self.meta | meta)

    def copy(self, with_attributes: bool = True, with_sets: bool = True) -> MeshFrame:
        """The same tables under a new handle, without attribute values or sets if asked."""
        spark = self.V.sparkSession
        gone = ([] if with_attributes else ["AD", "AV"]) + ([] if with_sets else ["SD", "SM"])
        return self.with_tables(**{k: spark.createDataFrame([], SCHEMAS[k]) for k in gone})

    def views(self, prefix: str = "") -> None:
        """Register every table for SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(f"{prefix}{name}")

    def table(self, dim: int) -> tuple[DataFrame, str]:
        name, key = KIND[dim]
        return self.tables[name], key

    def entities(self) -> DataFrame:
        """``dim, id, gdim, gent`` of all kinds."""
        parts = [self.table(d)[0].select(F.lit(d).alias("dim"), F.col(KIND[d][1]).alias("id"), "gdim", "gent") for d in KIND]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def counts(self) -> DataFrame:
        """``dim, n``: how many entities of each kind (0 for none), counted where they lie."""
        parts = [self.table(d)[0].agg(F.count("*").alias("n")).select(F.lit(d).alias("dim"), "n") for d in KIND]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def lookup(self, dim: int, id_: int | Column) -> DataFrame:
        df, key = self.table(dim)
        return df.where(F.col(key) == id_)

    def at(self, dim: int, i: int) -> DataFrame:
        """The i-th entity (from 0) in id order."""
        df, key = self.table(dim)
        return number(df, "__i", key, start=0).where(F.col("__i") == i).drop("__i")

    def settled(self, *names: str) -> MeshFrame:
        """Tables that are derived (edges, faces, incidence by default) worked out once and read from the shared folder from
        then on: for operators that read them many times."""
        shared_dir(self.V.sparkSession)
        return self.with_tables(**{n: self.tables[n].transform(settled) for n in names or ("E", "F", "FE", "RF")})

    def shuffled(self) -> MeshFrame:
        """All tables are joined by shuffles, and none by a broadcast through the driver (see ``working.shuffled``)."""
        return self.with_tables(**{n: t.hint("merge") for n, t in self.tables.items()})

    def persist(self) -> MeshFrame:
        for df in self.tables.values():
            df.persist()
        return self

    def unpersist(self) -> None:
        for df in self.tables.values():
            df.unpersist()
