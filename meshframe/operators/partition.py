"""Partitions of exact sizes, by weights, and of whole columns of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, half_edges
from ..working import settled, shared_dir


def _cuts(values: DataFrame, want: DataFrame, bins: int, rounds: int) -> DataFrame:
    """``part, cut, below``: for each row of ``want`` (``part``, ``rank``; a row a part) the least ``v`` up to which the weights
    of ``values`` (``part, v, w``) come to ``rank``, and the weight under it. Ranks are followed into ever smaller cells of
    histograms, so that no part is gathered; what is left in the end are few distinct values, which are summed."""
    spark = values.sparkSession
    size = values.groupBy("part").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    open_ = want.join(size, "part").select("part", "lo", "hi", F.col("rank").cast("double").alias("rank"), F.lit(0.0).alias("below"))
    shape = open_.schema
    open_ = spark.createDataFrame(open_.collect(), shape)  # a row a part
    for _ in range(rounds):
        inside = values.join(F.broadcast(open_), "part").where("v >= lo and v <= hi")
        step = (F.col("hi") - F.col("lo")) / bins
        cell = F.when(step > 0, F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
        hist = inside.groupBy("part", "rank", "below", cell.alias("cell")).agg(F.sum("w").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy("part").orderBy("cell"))  # at most ``bins`` rows a part
        hit = hist.withColumn("upto", upto).where("upto >= rank and upto - c < rank")
        before = F.col("upto") - F.col("c")
        rows = hit.select("part", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("rank") - before).alias("rank"), (F.col("below") + before).alias("below")).collect()
        open_ = spark.createDataFrame(rows, shape)
        if all(r.lo == r.hi for r in rows):
            return open_.select("part", F.col("lo").alias("cut"), "below")
    left = values.join(F.broadcast(open_), "part").where("v >= lo and v <= hi").groupBy("part", "rank", "below", "v").agg(F.sum("w").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("v"))
    hit = left.withColumn("upto", upto).where("upto >= rank and upto - c < rank")
    return hit.select("part", F.col("v").alias("cut"), (F.col("below") + F.col("upto") - F.col("c")).alias("below"))


def cut_into(points: DataFrame, n: int, axes: tuple[str, ...] = ("x", "y"), weight: str | None = None, bins: int = 1024, rounds: int = 6) -> DataFrame:
    """``id, part``: ``points`` (``id``, axes, and a positive ``weight`` column if named) in exactly ``n`` parts, 0 to n - 1,
    by recursive coordinate bisection.

    A group that is to become k parts is cut along the axes in turn so that the lower ceil(k / 2) parts get their share: of
    N equal points the floor(N ceil(k / 2) / k) first by (coordinate, id), so that sizes differ by one or two however
    many coordinates are equal; of weighted ones those up to the point where the share is reached. Coordinates below
    1e-10 in size count as 0, as in ``graph.bisect``."""
    if n < 1:
        raise ValueError("at least one part")
    spark = points.sparkSession
    shared_dir(spark)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    now = points.select("id", *[F.when(F.abs(F.col(a)) < 1e-10, 0.0).otherwise(F.col(a)).alias(a) for a in axes], w.alias("w"), F.lit(0).alias("part")).transform(settled)
    groups, turn = {0: n}, 0
    while any(k > 1 for k in groups.values()):
        a = axes[turn % len(axes)]
        shares = spark.createDataFrame([(p, k, -(-k // 2)) for p, k in groups.items() if k > 1], "part int, k int, lower int")
        rank = F.col("total") * F.col("lower") / F.col("k")
        totals = now.groupBy("part").agg(F.sum("w").alias("total")).join(F.broadcast(shares), "part")
        wanted = totals.select("part", (F.floor(F.col("total") * F.col("lower") / F.col("k")) if weight is None else rank).cast("double").alias("rank")).where("rank > 0").transform(settled)
        at = _cuts(now.select("part", F.col(a).alias("v"), "w"), wanted, bins, rounds).join(wanted, "part").transform(settled)
        # of the points on the cut those of the lowest ids fill the share
        ties = now.join(F.broadcast(at), "part").where(F.col(a) == F.col("cut")).select("part", F.col("id").cast("double").alias("v"), "w")
        last = _cuts(ties, at.select("part", (F.col("rank") - F.col("below")).alias("rank")), bins, rounds).select("part", F.col("cut").alias("last"))
        cut = shares.join(at.select("part", "cut"), "part", "left").join(last, "part", "left")
        down = F.coalesce((F.col(a) < F.col("cut")) | ((F.col(a) == F.col("cut")) & (F.col("id") <= F.col("last"))), F.lit(False))
        part = F.col("part") + F.when(F.col("lower").isNotNull() & ~down, F.col("lower")).otherwise(0)
        now = now.join(F.broadcast(cut), "part", "left").select("id", *axes, "w", part.alias("part")).transform(settled)  # at most n rows
        groups = {q: j for p, k in groups.items() for q, j in (((p, -(-k // 2)), (p - (-k // 2), k // 2)) if k > 1 else ((p, k),))}
        turn += 1
    return now.select("id", "part")


def columns(m: MeshFrame) -> DataFrame:
    """``id, base, height``: the cell at the foot of each cell's column and how many cells stand below it.

    A cell's foot is the side that looks down most (least z of the outward area), its head the one that looks up most; a
    cell stands on another whose head is its foot. Coordinates needn't agree from layer to layer. Pointers double every
    round, so that a column of height h takes the logarithm of h rounds."""
    shared_dir(m.V.sparkSession)
    xy = m.V.select("vid", "x", "y")
    sides = half_edges(m.FV)
    ends = sides.join(xy.select(F.col("vid").alias("v0"), F.col("x").alias("x0"), F.col("y").alias("y0")), "v0").join(xy.select(F.col("vid").alias("v1"), F.col("x").alias("x1"), F.col("y").alias("y1")), "v1")
    up = ends.groupBy("fid").agg(F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")).alias("nz"))
    looks = m.RF.join(up, "fid").select("rid", "fid", (F.col("nz") * (2 * F.col("dir") - 1)).alias("nz"))
    ended = looks.groupBy("rid").agg(F.min(F.struct("nz", "fid")).alias("foot"), F.max(F.struct("nz", "fid")).alias("head")).transform(settled)
    heads = ended.select(F.col("rid").alias("below"), F.col("head.fid").alias("fid"))
    stands = ended.select("rid", F.col("foot.fid").alias("fid")).join(heads, "fid", "left").where("below is null or below <> rid")
    below = stands.groupBy("rid").agg(F.min("below").alias("below"))
    now = ended.select("rid").join(below, "rid", "left").select(F.col("rid").alias("id"), F.coalesce("below", "rid").alias("base"), F.when(F.col("below").isNull(), 0).otherwise(1).cast("long").alias("height")).transform(settled)
    for _ in range(64):
        ahead = now.select(F.col("id").alias("base"), F.col("base").alias("further"), F.col("height").alias("more"))
        new = now.join(ahead, "base").select("id", F.col("further").alias("base"), (F.col("height") + F.col("more")).alias("height")).transform(settled)
        if new.join(now, ["id", "base"], "left_anti").isEmpty():
            return new
        now = new
    raise ValueError("the cells stand on each other in a ring")


def whole_columns(m: MeshFrame, parts: DataFrame) -> DataFrame:
    """``id, part`` with every cell in the part that the foot of its column has in ``parts`` (``id, part``)."""
    return columns(m).join(parts.select(F.col("id").alias("base"), "part"), "base").select("id", "part")
