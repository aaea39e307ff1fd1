"""Mesh views of the driver's tables.

Grid: part number k is a vertex at (k mod 20, k div 20), its price the height; quads between neighbours. Solid: a
box of hexahedra whose height grows with the suppliers. Loop: an order is a face whose loop is its distinct parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame
from ..operators.generate import grid2d, grid3d, split_quads
from ..working import settled

WIDTH = 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def grid_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    return WIDTH - 1, read(spark, sf_dir, "part").count() // WIDTH - 1


def grid_parts(spark: SparkSession, sf_dir: str, flat: bool = False) -> tuple[DataFrame, DataFrame]:
    nx, ny = grid_size(spark, sf_dir)
    v, fv = grid2d(spark, nx, ny, (0.0, 0.0), (float(nx), float(ny)))
    if not flat:
        price = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("vid"), (F.col("p_retailprice") / 1000).alias("h"))
        v = v.join(price, "vid", "left").select("vid", "x", "y", F.coalesce("h", F.lit(0.0)).alias("z"), "gdim", "gent")
    return v, fv


def grid(spark: SparkSession, sf_dir: str, flat: bool = False) -> MeshFrame:
    return MeshFrame.from_faces(*grid_parts(spark, sf_dir, flat))


def triangles(spark: SparkSession, sf_dir: str) -> MeshFrame:
    v, fv = grid_parts(spark, sf_dir)
    return MeshFrame.from_faces(v, split_quads(v, fv))


def box_size(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    return 5, 5, read(spark, sf_dir, "supplier").count() // 10


def box(spark: SparkSession, sf_dir: str) -> MeshFrame:
    """Cells are of two materials: 2 where the id is a multiple of 3, else 1."""
    n = box_size(spark, sf_dir)
    v, rv = grid3d(spark, *n, (0.0, 0.0, 0.0), tuple(map(float, n)))
    m = MeshFrame.from_regions(v, rv, "HEX", settle=True)
    return m.with_tables(R=m.R.withColumn("gent", F.when(F.col("rid") % 3 == 0, 2).otherwise(1).cast("long")))


def loop_fv(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fid"), F.col("l_partkey").alias("vid")).agg(F.min("l_linenumber").alias("ln"))
    w = Window.partitionBy("fid")
    at = items.withColumn("pos", F.row_number().over(w.orderBy("ln", "vid")) - 1).withColumn("n", F.count("*").over(w))
    return at.where("n >= 3").select("fid", "pos", "vid")


def loops(spark: SparkSession, sf_dir: str, settle: bool = False) -> MeshFrame:
    """With ``settle``, loops, sides and edges are worked out once, now."""
    v = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("vid"), (F.col("p_partkey") % WIDTH).cast("double").alias("x"), F.expr(f"p_partkey div {WIDTH}").cast("double").alias("y"), (F.col("p_retailprice") / 1000).alias("z"), F.lit(2).alias("gdim"), F.lit(1).cast("long").alias("gent"))
    fv = loop_fv(spark, sf_dir)
    return MeshFrame.from_faces(v, settled(fv) if settle else fv, settle=settle)
