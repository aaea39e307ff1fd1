"""Working tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of working tables by owner; those of no owner stay as long as results may read them.
_written: dict[str | None, list[str]] = {}
_owner: list[str | None] = [None]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where none is set and the master is local (tests).
    On a cluster without one, other machines could not read the tables: that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="meshframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


@contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Tables written within belong to ``owner``, whose ``release`` removes them."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(_owner[-1], []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the working tables of ``owner``, once no result still reads them; tables of others stay."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(hadoop.Path, _written.pop(owner, [])):
        path.getFileSystem(conf).delete(path, True)
