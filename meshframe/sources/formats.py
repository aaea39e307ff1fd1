"""Reading and writing by format name or file extension."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import MeshFrame
from . import exodus, foreign, native, surface, tables

#: Extensions of the formats; partitioned Exodus files end in their number of parts and rank.
EXTENSIONS = {"gmv": "gmv", "x3d": "x3d", "off": "off", "stl": "stl", "dx": "dx", "exo": "exodus", "exoii": "exodus", "g": "exodus"}
#: The first word of native files that are written here.
HEADER = "MESHFRAME"


def format_of(path: str) -> str:
    """What a path's last parts name; native for all others."""
    parts = path.rstrip("/").rpartition("/")[2].lower().split(".")
    if len(parts) > 2 and parts[-1].isdigit() and parts[-2].isdigit():
        return "exodus"
    return EXTENSIONS.get(parts[-1], "native")


def read(spark: SparkSession, path: str, fmt: str | None = None) -> MeshFrame:
    fmt = fmt or format_of(path)
    if fmt == "native":
        return native.read_mesh(spark, path)
    if fmt == "exodus":
        return exodus.read_exodus(spark, path)
    if fmt in foreign.READERS:
        return foreign.READERS[fmt](spark, path)
    raise ValueError(f"{fmt} files cannot be read")


def write(m: MeshFrame, path: str, fmt: str | None = None, attributes: list[str] | None = None, single: bool = False) -> None:
    """Write a mesh: a folder of text files in name order (one file with ``single``, for meshes that one task can write),
    or for Exodus one binary file. ``attributes``: all by default, those named, none for an empty list."""
    fmt = fmt or format_of(path)
    if attributes is not None:
        keep = F.col("name").isin(attributes) if attributes else F.lit(False)
        m = m.with_tables(AD=m.AD.where(keep), AV=m.AV.where(keep))
    if fmt == "exodus":
        folder, _, name = path.rstrip("/").rpartition("/")
        exodus.write_exodus(m, folder or ".", name.rpartition(".")[0] or name)
        return
    writers = {
        "native": lambda: native.write_mesh(m, path, HEADER, single),
        "gmv": lambda: foreign.write_gmv(m, path, single),
        "x3d": lambda: tables.write_x3d(m, path, single),
        "off": lambda: surface.write_off(m, path, single=single),
        "stl": lambda: surface.write_stl(m, path, single=single),
        "dx": lambda: surface.write_dx(m, path, single),
    }
    if fmt not in writers:
        raise ValueError(f"{fmt} files cannot be written")
    writers[fmt]()
