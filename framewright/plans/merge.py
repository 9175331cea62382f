"""Renumbering, statistics and their merging, as an export needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalars import not_nan, sure


def renumber(keep: DataFrame) -> DataFrame:
    """old_index and episode_index, its rank among those kept. Ids are few: an episode has one."""
    return keep.select("old_index").distinct().withColumn("episode_index", F.row_number().over(Window.orderBy("old_index")).cast("bigint") - 1)


def reindex(frames: DataFrame, keep: DataFrame) -> DataFrame:
    """Frames of the kept episodes under their new numbers."""
    return frames.withColumnRenamed("episode_index", "old_index").join(keep, "old_index").drop("old_index")


def offsets(frames: DataFrame) -> DataFrame:
    """episode_index, length, from_index, to_index: where each episode's frames lie in the whole. The running sum is over episodes, not frames."""
    n = frames.groupBy("episode_index").agg(F.count("*").alias("length"))
    w = Window.orderBy("episode_index").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("to_index", F.sum("length").over(w)).withColumn("from_index", F.col("to_index") - F.col("length"))


def column_stats(frames: DataFrame, column: str, quantiles=(), by=()) -> DataFrame:
    """by..., dim, min, max, mean, std (population), count and qNN of each dimension of an array column."""
    each = frames.select(*by, F.posexplode(column).alias("dim", "v")).withColumn("v", not_nan(F.col("v")))
    q = [F.percentile("v", p).alias(f"q{round(p * 100):02d}") for p in quantiles]
    return each.groupBy(*by, "dim").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("v").alias("count"), *q)


def merge_stats(parts: DataFrame, by, quantiles=()) -> DataFrame:
    """Statistics of the whole from those of its parts, weighted by count. Quantiles are weighted means of quantiles, an approximation.

    These means are summed in decimals where those hold every term, so they don't depend on the order of the parts.
    """
    total = parts.groupBy(*by).agg(F.sum("count").alias("_n"), (F.sum(F.col("count") * F.col("mean")) / F.sum("count")).alias("_m"))
    p = parts.join(total, list(by))
    spread = F.sum(F.col("count") * (F.col("std") * F.col("std") + (F.col("mean") - F.col("_m")) * (F.col("mean") - F.col("_m"))))
    return p.groupBy(*by).agg(F.max("_n").alias("count"), F.max("_m").alias("mean"), F.sqrt(spread / F.max("_n")).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"), *[(_steady_sum(F.col("count") * F.col(q)) / F.max("_n")).alias(q) for q in quantiles])


def _steady_sum(x):
    """Sum of doubles, the same in any order; where a term doesn't fit a decimal, the plain sum."""
    d = x.try_cast("decimal(38,18)")
    fits = F.count_if(sure(d.cast("double") == x)) == F.count(x)
    return F.coalesce(F.when(fits, F.try_sum(d).cast("double")), F.sum(x))


def narrowed(start, end, trim_start, trim_end, length, fps: float):
    """A video span without what a trim takes off at both ends."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return c(start) + c(trim_start) / F.lit(fps), c(end) - (c(length) - c(trim_end)) / F.lit(fps)
