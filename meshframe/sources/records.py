"""Whole-file text formats: each file is parsed by one task into rows of one wide record, which then split into tables.

Files of a partitioned mesh are read side by side; a row's ``part`` is its file's rank in name order.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import MeshFrame
from ..working import settled

RECORD = "part int, t string, id long, pos int, ref long, dir int, x double, y double, z double, gdim int, gent long, name string, text string, vals array<double>"
FIELDS = ["t", "id", "pos", "ref", "dir", "x", "y", "z", "gdim", "gent", "name", "text", "vals"]

_BLANK = dict.fromkeys(FIELDS)


def record(t: str, **values) -> dict:
    return _BLANK | {"t": t} | values


def words_of(text: str) -> Iterator[str]:
    """The words of ``text.split()``, one after another: a list of them takes many times the text's memory."""
    return (m.group() for m in re.finditer(r"\S+", text))


def read(spark: SparkSession, paths: str | list[str], parse: Callable[[str], Iterator[dict]]) -> DataFrame:
    """Rows of every file. A path that is a folder holds one file's text in pieces, in name order. Files are parsed once, now:
    many tables are read from the rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("piece"), "value")
    folders = {f"/{p.rstrip('/').rpartition('/')[2]}/" for p in paths}
    inside = F.lit(False)
    for f in sorted(folders):
        inside = inside | F.contains("piece", F.lit(f))
    files = files.withColumn("file", F.when(inside, F.regexp_replace("piece", "/[^/]*$", "")).otherwise(F.col("piece")))
    files = files.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda s: s["value"]), "").alias("value"))
    names = sorted(r[0] for r in files.select("file").distinct().collect())  # names only, one per file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, value in zip(batch["file"], batch["value"], strict=True):
                rows, part = parse(value), names.index(file)
                while held := list(itertools.islice(rows, 20_000)):
                    yield pd.DataFrame({"part": part} | {c: [row[c] for row in held] for c in FIELDS})

    return settled(files.mapInPandas(run, RECORD))


def to_mesh(rows: DataFrame, spark: SparkSession, part: int = 0) -> MeshFrame:
    """The bundle of one part's records; edges and loops that a file lacks are derived."""
    r = rows.where(F.col("part") == part)
    has = {x[0] for x in r.select("t").distinct().collect()}  # at most a dozen table names
    v = r.where("t = 'V'").select(F.col("id").alias("vid"), "x", "y", "z", "gdim", "gent")
    f = r.where("t = 'F'").select(F.col("id").alias("fid"), F.col("pos").alias("n"), "gdim", "gent")
    empty = MeshFrame.empty(spark)
    if "RV" in has and "FE" not in has and "FV" not in has:
        kinds = r.where("t = 'R'").select(F.col("id").alias("rid"), F.col("name").alias("rtype"), "gdim", "gent")
        m = MeshFrame.from_regions(v, r.where("t = 'RV'").select(F.col("id").alias("rid"), "pos", F.col("ref").alias("vid")), r=kinds)
    elif "FE" in has:
        e = r.where("t = 'E'").select(F.col("id").alias("eid"), F.col("ref").alias("v0"), F.col("pos").cast("long").alias("v1"), "gdim", "gent")
        e = e.select("eid", "v0", "v1", F.least("v0", "v1").alias("lo"), F.greatest("v0", "v1").alias("hi"), "gdim", "gent")
        fe = r.where("t = 'FE'").select(F.col("id").alias("fid"), "pos", F.col("ref").alias("eid"), "dir")
        fv = fe.join(e, "eid").select("fid", "pos", F.when(F.col("dir") == 1, F.col("v0")).otherwise(F.col("v1")).alias("vid"))
        m = empty.with_tables(V=v, E=e, F=f, FE=fe, FV=fv)
    elif "FV" in has:
        m = MeshFrame.from_faces(v, r.where("t = 'FV'").select(F.col("id").alias("fid"), "pos", F.col("ref").alias("vid")), f if "F" in has else None)
    else:
        m = empty.with_tables(V=v)
    if "RF" in has:
        m = m.with_tables(R=r.where("t = 'R'").select(F.col("id").alias("rid"), F.coalesce("name", F.lit("POLYHED")).alias("rtype"), "gdim", "gent"), RF=r.where("t = 'RF'").select(F.col("id").alias("rid"), "pos", F.col("ref").alias("fid"), "dir"))
    if "AD" in has:
        ad = r.where("t = 'AD'").select("name", F.col("text").alias("atype"), F.col("pos").alias("ncomp"), F.col("dir").alias("entdim"))
        av = r.where("t = 'AV'").select("name", F.col("dir").alias("dim"), "id", F.when(F.col("text") == "INT", F.col("vals")[0].cast("int")).alias("ival"), F.when(F.col("text") == "DOUBLE", F.col("vals")[0]).alias("dval"), F.when(F.col("text").isin("VECTOR", "TENSOR"), F.col("vals")).alias("vval"), F.lit(None).cast(empty.AV.schema["ref"].dataType).alias("ref"))
        m = m.with_tables(AD=ad, AV=av)
    return m


def write_lines(lines: DataFrame, path: str, single: bool = False) -> None:
    """Write (``sect``, ``ord``, ``line``) in order: as files in name order, or as one file in a folder (by one task)."""
    ordered = lines.orderBy("sect", "ord")
    (ordered.coalesce(1) if single else ordered).select("line").write.mode("overwrite").text(path)
