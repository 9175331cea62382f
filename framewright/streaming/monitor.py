"""Timing checks on a stream of frames: an extension, for frames that arrive while they are recorded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(frames: DataFrame, gap: str = "1 hour", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Stretches of frames without a gap, for each key, of a stream or a table: key, start, end, frames.

    Late frames within the watermark still join their session. State is one row for each open session.
    """
    f = frames.withWatermark(time, late)
    return f.groupBy(key, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("frames")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "frames")


def rates(frames: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Frames in tumbling or sliding windows: key, start, frames."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return frames.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("frames")).select(key, F.col("w.start").alias("start"), "frames")
