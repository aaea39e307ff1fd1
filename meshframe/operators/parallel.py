"""Partitioned meshes: ownership, ghost layers, exchange of attributes, global ids.

Copies of entities are rows (``part``, ``gid``, ``master_part``, ``ptype``): 1 owned and copied elsewhere (overlap),
2 on a partition boundary, 3 ghost, 0 interior. A part is a value of a column, never a process.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import number
from ..schema import BOUNDARY, GHOST, INTERIOR, OVERLAP
from ..working import shared_dir, shuffled
from .graph import components


def owners(incidence: DataFrame, element: str, member: str, parts: DataFrame) -> DataFrame:
    """``gid, part, master_part``: each entity in every part whose elements (``parts``: ``id``, ``part``) reach it;
    the owner is the lowest of them."""
    reach = incidence.join(parts, incidence[element] == parts["id"]).select(F.col(member).alias("gid"), "part").distinct()
    low = reach.groupBy("gid").agg(F.min("part").alias("master_part"))
    return reach.join(low, "gid").select("gid", "part", "master_part")


def boundary(copies: DataFrame) -> DataFrame:
    """``gid`` of entities on more than one part."""
    return copies.groupBy("gid").agg(F.count_distinct("part").alias("k")).where("k > 1").select("gid")


def ghost_cells(fv: DataFrame, parts: DataFrame, layers: int = 1, key: str = "fid") -> DataFrame:
    """``part, gid, master_part``: elements of other parts within ``layers`` rings of vertices of a part. ``fv`` has the
    vertices of elements (``key``, ``vid``)."""
    at = fv.select(key, "vid").distinct()
    own = at.join(parts.withColumnRenamed("id", key), key).select("part", key, "vid")
    have = own.select("part", key).distinct()
    # only vertices that elements of several parts have lead out of a part; rings grow from there
    shared = own.groupBy("vid").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("vid")
    front = own.join(shared, "vid", "left_semi").select("part", "vid").distinct()
    for k in range(layers):
        near = at.join(front, "vid").select("part", key).distinct()
        if k + 1 < layers:
            front = near.join(have, ["part", key], "left_anti").join(at, key).select("part", "vid").distinct()
        have = have.union(near).distinct()
    home = parts.select(F.col("id").alias(key), F.col("part").alias("master_part"))
    return have.join(home, key).where("part <> master_part").select("part", F.col(key).alias("gid"), "master_part")


def overlap_cells(ghosts: DataFrame) -> DataFrame:
    """``part, gid``: owned elements that some other part holds as ghosts."""
    return ghosts.select(F.col("master_part").alias("part"), "gid").distinct()


def label_cells(parts: DataFrame, ghosts: DataFrame) -> DataFrame:
    """``part, gid, master_part, ptype`` of all elements with their ghosts."""
    over = overlap_cells(ghosts).withColumn("o", F.lit(True))
    own = parts.select("part", F.col("id").alias("gid"), F.col("part").alias("master_part")).join(over, ["part", "gid"], "left")
    return own.select("part", "gid", "master_part", F.when(F.col("o"), OVERLAP).otherwise(INTERIOR).alias("ptype")).union(ghosts.select("part", "gid", "master_part", F.lit(GHOST).alias("ptype")))


def label_vertices(fv: DataFrame, cells: DataFrame) -> DataFrame:
    return label_members(fv, "fid", "vid", cells)


def label_members(incidence: DataFrame, element: str, member: str, cells: DataFrame) -> DataFrame:
    """``part, gid, master_part, ptype, on_bdry`` of what elements consist of, closed down from labelled cells: ghost where
    no owned cell of the part has it or another part owns it; overlap where another part has a copy."""
    held = incidence.select(F.col(element).alias("gid"), member).join(cells, "gid").select("part", F.col(member).alias("gid"), (F.col("ptype") != GHOST).alias("own"))
    copies = held.groupBy("part", "gid").agg(F.max("own").alias("own"))
    who = copies.where("own").groupBy("gid").agg(F.min("part").alias("master_part"), F.count("*").alias("sharers"))
    every = copies.groupBy("gid").agg(F.count("*").alias("k"))
    j = copies.join(who, "gid").join(every, "gid")
    kind = F.when(F.col("part") != F.col("master_part"), GHOST).when(F.col("k") > 1, OVERLAP).otherwise(INTERIOR)
    return j.select("part", "gid", "master_part", kind.alias("ptype"), (F.col("own") & (F.col("sharers") > 1)).alias("on_bdry"))


def update_ghosts(copies: DataFrame, values: list[str]) -> DataFrame:
    """Copies with the owner's values; zeros are copied like any value. A ghost without an owner row keeps its own."""
    own = copies.where(F.col("part") == F.col("master_part")).select("gid", *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__o"))
    j = copies.join(own, "gid", "left")
    return j.select(*[F.when(F.col("__o"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in copies.columns])


REDUCE = {"MAX": F.max, "MIN": F.min, "SUM": F.sum, "AVG": F.avg}


def gather_scatter(copies: DataFrame, value: str, op: str) -> DataFrame:
    """Every copy gets the reduction (MAX, MIN, SUM, AVG) over all copies. Integers have no AVG; vectors (arrays) are
    compared by length for MAX and MIN and added by component."""
    kind = copies.schema[value].dataType.typeName()
    if op == "AVG" and kind in ("integer", "long", "short", "byte"):
        raise ValueError("AVG of an integer attribute")
    if kind == "array":
        size = F.aggregate(value, F.lit(0.0), lambda a, x: a + x * x)
        if op in ("MAX", "MIN"):
            r = copies.groupBy("gid").agg((F.max_by if op == "MAX" else F.min_by)(value, F.struct(size, value)).alias("__r"))
        else:
            parts = copies.select("gid", F.posexplode(value).alias("__i", "__x")).groupBy("gid", "__i").agg(REDUCE[op]("__x").alias("__x"))
            r = parts.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"]).alias("__r"))
    else:
        r = copies.groupBy("gid").agg(REDUCE[op](value).alias("__r"))
    return copies.join(r, "gid").select(*[F.col("__r").alias(c) if c == value else F.col(c) for c in copies.columns])


def exchange(copies: DataFrame, value: str) -> DataFrame:
    """``gid, part, other, received``: for entities on exactly two parts, what the other part holds."""
    two = copies.groupBy("gid").agg(F.count_distinct("part").alias("k")).where("k = 2").select("gid")
    a = copies.join(two, "gid").select("gid", "part")
    b = copies.select("gid", F.col("part").alias("other"), F.col(value).alias("received"))
    return a.join(b, "gid").where("part <> other").select("gid", "part", "other", "received")


def renumber_gids(copies: DataFrame, order: str = "gid") -> DataFrame:
    """``part, gid, new_gid``: contiguous by owning part, in ``order`` within it; ghosts take their owner's."""
    own = copies.where(F.col("part") == F.col("master_part")).select("part", order, *([] if order == "gid" else ["gid"])).distinct()
    ranked = number(own, "new_gid", order, *([] if order == "gid" else ["gid"]), group="part").select("gid", "new_gid")
    return copies.join(ranked, "gid").select("part", "gid", "new_gid")


def comm_matrix(copies: DataFrame) -> DataFrame:
    """``part, master_part, n``: how many entities each part receives from each owner."""
    return copies.where("part <> master_part").groupBy("part", "master_part").agg(F.count("*").alias("n"))


def neighbors(copies: DataFrame) -> DataFrame:
    """``a, b``: parts that share an entity."""
    a, b = copies.select("gid", F.col("part").alias("a")), copies.select("gid", F.col("part").alias("b"))
    return a.join(b, "gid").where("a <> b").select("a", "b").distinct()


def check(copies: DataFrame, same: list[str]) -> DataFrame:
    """``rule, violations``: ghosts without owners, several owners, and copies that differ in the columns ``same``."""
    own = copies.where("part = master_part")
    lost = copies.where("part <> master_part").join(own.select("gid", F.col("part").alias("master_part")), ["gid", "master_part"], "left_anti")
    several = copies.groupBy("gid").agg(F.count_distinct("master_part").alias("k")).where("k > 1")
    out = lost.agg(F.count("*").alias("violations")).select(F.lit("ghost_without_owner").alias("rule"), "violations")
    out = out.union(several.agg(F.count("*").alias("violations")).select(F.lit("several_owners"), "violations"))
    for c in same:
        odd = copies.groupBy("gid").agg(F.count_distinct(c).alias("k")).where("k > 1")
        out = out.union(odd.agg(F.count("*").alias("violations")).select(F.lit(f"{c}_differs"), "violations"))
    return out


def match_points(points: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """``part, id, master_part, master_id``: points of one place on several parts, owned by the lowest (part, id).

    Points within ``tolerance`` of each other along all axes are one, and so are those that a chain of such points joins.
    Coordinates are cut into cells; a point looks into its own cell and, across a wall within the tolerance, the next."""
    shared_dir(points.sparkSession)
    size = max(tolerance * 4, 1e-9)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    known = number(points.select("part", "id", *"xyz"), "k", "id", group="part").transform(shuffled)
    a = known.withColumns({f"c{c}": cell(c) for c in "xyz"})
    for c in "xyz":
        low, high = F.floor((F.col(c) - tolerance) / size).cast("long"), F.floor((F.col(c) + tolerance) / size).cast("long")
        a = a.withColumn(f"c{c}", F.explode(F.array_distinct(F.array(low, F.col(f"c{c}"), high))))
    b = known.select(*[cell(c).alias(f"c{c}") for c in "xyz"], F.col("k").alias("mk"), *[F.col(c).alias(f"m{c}") for c in "xyz"])
    j = a.join(b, ["cx", "cy", "cz"]).where("k <> mk")
    for c in "xyz":
        j = j.where(F.abs(F.col(c) - F.col(f"m{c}")) <= tolerance)
    near = j.select(F.col("k").alias("src"), F.col("mk").alias("dst")).distinct().transform(shuffled)
    label = components(near.select(F.col("src").alias("node")).distinct(), near)
    home = known.select(F.col("k").alias("component"), F.col("part").alias("master_part"), F.col("id").alias("master_id"))
    placed = known.join(label.withColumnRenamed("node", "k").hint("merge"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    return placed.join(home, "component").select("part", "id", "master_part", "master_id")


def copy_values(values: DataFrame, copies: DataFrame) -> DataFrame:
    """Values (or set members) by ``gid`` dealt to every copy."""
    return copies.select("part", "gid").join(values, "gid")


def counts(copies: DataFrame, ptype: int) -> DataFrame:
    return copies.where(F.col("ptype") == ptype).groupBy("part").agg(F.count("*").alias("n"))


def at(copies: DataFrame, ptype: int, i: int) -> DataFrame:
    """The i-th entity of a type on each part, in gid order."""
    w = Window.partitionBy("part").orderBy("gid")
    return copies.where(F.col("ptype") == ptype).withColumn("__i", F.row_number().over(w) - 1).where(F.col("__i") == i).drop("__i")


def strips(cells: DataFrame, parts: int) -> DataFrame:
    """``id, part``: contiguous runs of ids of (almost) equal size."""
    n = cells.agg(F.count("*").alias("n"))
    ranked = number(cells.select("id"), "r", "id", start=0).crossJoin(F.broadcast(n))  # one row
    return ranked.select("id", F.expr(f"least(r div greatest(1, n div {parts}), {parts - 1})").cast("int").alias("part"))


__all__ = ["BOUNDARY", "GHOST", "INTERIOR", "OVERLAP"]
