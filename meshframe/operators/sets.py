"""Named, ordered sets of entities: ``SD`` (set, entdim) and ``SM`` (set, pos, dim, id). Positions count from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import MeshFrame, number

MEMBER = ["dim", "id"]


def members(m: MeshFrame, name: str) -> DataFrame:
    return m.SM.where(F.col("set") == name).select("pos", *MEMBER)


def put(m: MeshFrame, name: str, entdim: int, rows: DataFrame) -> MeshFrame:
    """Make or replace a set from rows (``pos``, ``dim``, ``id``); positions are made dense."""
    spark = m.V.sparkSession
    placed = number(rows, "p", "pos", *MEMBER, start=0).select(F.lit(name).alias("set"), F.col("p").cast("int").alias("pos"), "dim", "id")
    return m.with_tables(SD=m.SD.where(F.col("set") != name).unionByName(spark.createDataFrame([(name, entdim)], m.SD.schema)), SM=m.SM.where(F.col("set") != name).unionByName(placed))


def drop(m: MeshFrame, name: str) -> MeshFrame:
    return m.with_tables(SD=m.SD.where(F.col("set") != name), SM=m.SM.where(F.col("set") != name))


def rename(m: MeshFrame, name: str, new: str) -> MeshFrame:
    swap = F.when(F.col("set") == name, F.lit(new)).otherwise(F.col("set"))
    return m.with_tables(SD=m.SD.withColumn("set", swap), SM=m.SM.withColumn("set", swap))


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of ``a``, then of ``b``, duplicates kept."""
    n = a.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("n"))
    return a.select("pos", *MEMBER).union(b.crossJoin(F.broadcast(n)).select((F.col("pos") + F.col("n")).alias("pos"), *MEMBER))  # n is one row


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` as it is, then what only ``b`` has, once each."""
    new = b.join(a, MEMBER, "left_anti").groupBy(*MEMBER).agg(F.min("pos").alias("pos")).select("pos", *MEMBER)
    return concat(a, new)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """What both have, once each, in the order of ``a``; no rows where nothing is shared."""
    return a.join(b, MEMBER, "left_semi").groupBy(*MEMBER).agg(F.min("pos").alias("pos")).select("pos", *MEMBER)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` without what ``b`` has; duplicates of ``a`` stay."""
    return a.join(b, MEMBER, "left_anti").select("pos", *MEMBER)


def locate(a: DataFrame, asked: DataFrame) -> DataFrame:
    """``dim, id, pos``: first position of each asked member, -1 where it is absent."""
    at = a.groupBy(*MEMBER).agg(F.min("pos").alias("pos"))
    return asked.join(at, MEMBER, "left").select(*MEMBER, F.coalesce("pos", F.lit(-1)).alias("pos"))


def contains(a: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(a, MEMBER, "left_semi")


def add(a: DataFrame, rows: DataFrame, unique: bool = False) -> DataFrame:
    return union(a, rows) if unique else concat(a, rows)


def insert(a: DataFrame, rows: DataFrame, at: int) -> DataFrame:
    """``rows`` (``dim``, ``id``, and an integer ``pos`` that orders them; without it they go in the order of their ids) before
    position ``at``."""
    order = ["pos", "id", "dim"] if "pos" in rows.columns else ["id", "dim"]
    k = number(rows.withColumnRenamed("pos", "o"), "pos", *["o" if c == "pos" else c for c in order], start=at).select("pos", *MEMBER)
    n = rows.agg(F.count("*").alias("n"))
    moved = a.crossJoin(F.broadcast(n)).select(F.when(F.col("pos") >= at, F.col("pos") + F.col("n")).otherwise(F.col("pos")).alias("pos"), *MEMBER)  # one row
    return moved.union(k)


def remove_at(a: DataFrame, pos: int) -> DataFrame:
    """Without the member at a position; those behind it move up."""
    return a.where(F.col("pos") != pos).select(F.when(F.col("pos") > pos, F.col("pos") - 1).otherwise(F.col("pos")).alias("pos"), *MEMBER)


def replace(a: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """The first ``old`` (dim, id) becomes ``new``."""
    first = a.where((F.col("dim") == old[0]) & (F.col("id") == old[1])).agg(F.min("pos").alias("at"))
    hit = F.coalesce(F.col("pos") == F.col("at"), F.lit(False))
    return a.crossJoin(F.broadcast(first)).select("pos", F.when(hit, F.lit(new[0])).otherwise(F.col("dim")).alias("dim"), F.when(hit, F.lit(new[1])).otherwise(F.col("id")).cast("long").alias("id"))  # one row


def remove_first(a: DataFrame, asked: DataFrame) -> DataFrame:
    first = a.join(asked, MEMBER, "left_semi").groupBy(*MEMBER).agg(F.min("pos").alias("pos"))
    return a.join(first, ["pos", *MEMBER], "left_anti")


def replace_at(a: DataFrame, pos: int, dim: int, id_: int) -> DataFrame:
    hit = F.col("pos") == pos
    return a.select("pos", F.when(hit, F.lit(dim)).otherwise(F.col("dim")).alias("dim"), F.when(hit, F.lit(id_)).otherwise(F.col("id")).alias("id"))


def mark(entities: DataFrame, a: DataFrame, flag: str) -> DataFrame:
    """Add a boolean column: is the entity (``dim``, ``id``) a member?"""
    return entities.join(a.select(*MEMBER).distinct().withColumn(flag, F.lit(True)), MEMBER, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def unmark(entities: DataFrame, flag: str) -> DataFrame:
    return entities.drop(flag)
