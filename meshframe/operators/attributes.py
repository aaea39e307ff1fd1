"""Typed attributes on entities: definitions (``AD``) and sparse values (``AV``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import MeshFrame

KEY = ["name", "dim", "id"]
FIELD = {"INT": "ival", "DOUBLE": "dval", "VECTOR": "vval", "TENSOR": "vval", "POINTER": "ref"}


def define(m: MeshFrame, name: str, atype: str, entdim: int, ncomp: int = 1) -> MeshFrame:
    """Add a definition; one of that name is replaced."""
    if atype not in FIELD:
        raise ValueError(f"unknown attribute type {atype}")
    new = m.V.sparkSession.createDataFrame([(name, atype, ncomp, entdim)], m.AD.schema)
    return m.with_tables(AD=m.AD.where(F.col("name") != name).unionByName(new))


def drop(m: MeshFrame, name: str) -> MeshFrame:
    return m.with_tables(AD=m.AD.where(F.col("name") != name), AV=m.AV.where(F.col("name") != name))


def set_values(m: MeshFrame, values: DataFrame) -> MeshFrame:
    """Upsert rows of AV (absent value columns are null); a key that occurs twice in ``values`` takes the largest."""
    shaped = values.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in values.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in m.AV.schema])
    one = shaped.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("ival", "dval", "vval", "ref")])
    return m.with_tables(AV=m.AV.join(one, KEY, "left_anti").unionByName(one))


def set_vectors(m: MeshFrame, values: DataFrame) -> MeshFrame:
    """``set_values`` for VECTOR and TENSOR rows; refuses arrays of a length other than the definition's."""
    sized = values.join(m.AD.select("name", "ncomp"), "name")
    right = sized.withColumn("vval", F.when(F.size("vval") == F.col("ncomp"), F.col("vval")).otherwise(F.raise_error(F.lit("wrong number of components")).cast("array<double>")))
    return set_values(m, right.drop("ncomp"))


def get_values(m: MeshFrame, name: str, dim: int) -> DataFrame:
    """``id, status, ival, dval, vval, ref`` for every entity of a kind: status 0 and zeros (nulls) where absent."""
    df, key = m.table(dim)
    own = m.AV.where((F.col("name") == name) & (F.col("dim") == dim)).drop("name", "dim")
    got = df.select(F.col(key).alias("id")).join(own.withColumn("status", F.lit(1)), "id", "left")
    return got.select("id", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("ival", F.lit(0)).alias("ival"), F.coalesce("dval", F.lit(0.0)).alias("dval"), "vval", "ref")


def remove_values(m: MeshFrame, keys: DataFrame) -> MeshFrame:
    """Delete values by any of the key columns (``name``, ``dim``, ``id``) that ``keys`` has."""
    return m.with_tables(AV=m.AV.join(keys.distinct(), [c for c in KEY if c in keys.columns], "left_anti"))


def clear_values(m: MeshFrame, name: str, keys: DataFrame | None = None) -> MeshFrame:
    """Set values to zero or null and keep their rows; those of ``keys`` (``dim``, ``id``) only, if given."""
    hit = F.col("name") == name
    av = m.AV
    if keys is not None:
        av = av.join(keys.select("dim", "id").distinct().withColumn("__k", F.lit(True)), ["dim", "id"], "left")
        hit = hit & F.coalesce("__k", F.lit(False))
    zero = {
        "ival": F.when(hit & F.col("ival").isNotNull(), F.lit(0)).otherwise(F.col("ival")),
        "dval": F.when(hit & F.col("dval").isNotNull(), F.lit(0.0)).otherwise(F.col("dval")),
        "vval": F.when(hit & F.col("vval").isNotNull(), F.transform("vval", lambda x: x * 0)).otherwise(F.col("vval")),
        "ref": F.when(~hit, F.col("ref")),
    }
    return m.with_tables(AV=av.withColumns(zero).select(*m.AV.columns))


def definitions(m: MeshFrame) -> DataFrame:
    return m.AD.orderBy("name")
