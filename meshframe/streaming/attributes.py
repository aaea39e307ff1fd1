"""Attribute updates from a stream: late and repeated events change nothing that is newer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_values(events: DataFrame, id_: str, time: str, value: str, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """``window, id, dval``: the last value of each entity in each event-time window; ties take the larger value."""
    marked = events.withWatermark(time, delay)
    return marked.groupBy(F.window(time, window).alias("w"), F.col(id_).alias("id")).agg(F.max_by(value, F.struct(time, value)).alias("dval")).select(F.col("w.start").alias("window"), "id", "dval")
