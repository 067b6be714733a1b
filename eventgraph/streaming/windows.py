"""Event-time windows over the stream table, batch and streaming alike (an extension of our own).

The same functions take a static or a streaming DataFrame; on a stream, the watermark says how late a
row may come, and bounds the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def _counted(rows: DataFrame, time: str, window: Column, keys: list[str], late: str) -> DataFrame:
    source = rows.withWatermark(time, late) if rows.isStreaming else rows
    found = source.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def tumbling(rows: DataFrame, width: str, keys: list[str], time: str = "ts", late: str = LATE) -> DataFrame:
    return _counted(rows, time, F.window(time, width), keys, late)


def sliding(rows: DataFrame, width: str, step: str, keys: list[str], time: str = "ts", late: str = LATE) -> DataFrame:
    return _counted(rows, time, F.window(time, width, step), keys, late)


def sessions(rows: DataFrame, gap: str, keys: list[str], time: str = "ts", late: str = LATE) -> DataFrame:
    """Sessions end when nothing comes for a gap."""
    return _counted(rows, time, F.session_window(time, gap), keys, late)


def first_per_key(rows: DataFrame, key: str, time: str = "ts", late: str = LATE) -> DataFrame:
    """The first row of each key: on a stream within the watermark, else the earliest of all."""
    if rows.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.col(time)).alias("r")).select(key, "r.*")
