"""Commands over mesh files: ``python -m meshframe.tools convert|check|partition ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import MeshFrame
from .operators import attributes, classify, distribute, generate, geometry
from .sources import exodus, formats


def classified(m: MeshFrame, geometry_too: bool = False) -> MeshFrame:
    """The mesh with all kinds of entities classified from its cells (or faces) down."""
    put = lambda df, key, new: df.drop("gdim", "gent").join(new, key).select(*df.columns)
    faces = classify.classify_faces(m, geometry=geometry_too) if not m.R.isEmpty() else m.F.select("fid", "gdim", "gent")
    m = m.with_tables(R=put(m.R, "rid", classify.fill_region_ids(m)), F=put(m.F, "fid", faces))
    sharp = classify.sharp_edges(m, m.F) if geometry_too else None
    m = m.with_tables(E=put(m.E, "eid", classify.classify_edges(m, sharp=sharp)))
    return m.with_tables(V=put(m.V, "vid", classify.classify_vertices(m)))


def convert(spark: SparkSession, source: str, target: str, classify_first: bool = False, parts: int = 0) -> MeshFrame:
    """Read a file, classify it if asked and write it in the target's format; with ``parts`` as Exodus files by part."""
    m = formats.read(spark, source)
    if classify_first:
        m = classified(m)
    if parts > 1:
        folder, _, name = target.rpartition("/")
        exodus.write_exodus(m, folder or ".", name.rpartition(".")[0] or name, distribute.partition(m, parts))
    else:
        formats.write(m, target)
    return m


def checked(m: MeshFrame) -> tuple[DataFrame, DataFrame]:
    """Violations by rule, and the solid cells that aren't sound (``rid, volume, star_shaped``)."""
    return classify.check(m).where("violations > 0"), geometry.region_volumes(m).where("volume <= 0 or not star_shaped")


def partitioned(m: MeshFrame, parts: int, method: str = "bisection") -> MeshFrame:
    """The mesh with an attribute ``partition`` on its elements, to be looked at in a viewer."""
    dim = 3 if not m.R.isEmpty() else 2
    m = attributes.define(m, "partition", "INT", dim)
    where = distribute.partition(m, parts, method)
    return attributes.set_values(m, where.select(F.lit("partition").alias("name"), F.lit(dim).alias("dim"), "id", F.col("part").alias("ival")))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="meshframe.tools", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--classify", action="store_true")
    c.add_argument("--parts", type=int, default=0)
    sub.add_parser("check").add_argument("source")
    v = sub.add_parser("partition", help="write a GMV file coloured by part")
    v.add_argument("source")
    v.add_argument("target")
    v.add_argument("--parts", type=int, required=True)
    v.add_argument("--method", default="bisection")
    g = sub.add_parser("generate", help="write a structured grid")
    g.add_argument("target")
    g.add_argument("counts", type=int, nargs="+")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "convert":
        convert(spark, a.source, a.target, a.classify, a.parts)
    elif a.command == "partition":
        formats.write(partitioned(formats.read(spark, a.source), a.parts, a.method), a.target, "gmv")
    elif a.command == "generate":
        formats.write((generate.structured2d if len(a.counts) == 2 else generate.structured3d)(spark, *a.counts), a.target)
    else:
        rules, cells = checked(formats.read(spark, a.source))
        rules.show(truncate=False)
        n = cells.count()
        print(f"{n} cells of no positive volume or not star-shaped")
        return 1 if n or not rules.isEmpty() else 0
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
