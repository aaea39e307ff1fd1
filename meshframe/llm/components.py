"""Connected components by alternating large-star and small-star steps, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges`` (long columns).

    Each round is one large-star and one small-star step with ``min`` aggregates, which combine on the map
    side, so that a hub of any size is never gathered in one task. Rounds end when the edges no longer change
    (their number is logarithmic in the nodes); each is cut off by a written table (a checkpoint would keep the estimated size
    of its plan, and in a loop of joins estimates multiply). Should ``max_rounds`` not be enough,
    that is an error, never a partial result. Loops and nulls in the input are ignored; no edges give no rows.
    """
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    pair = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    sums = None
    for _ in range(max_rounds):
        both = pair.union(pair.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        pair = written(small, "links")
        new = pair.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if new == sums:
            break
        sums = new
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    stars = pair.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(pair.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
