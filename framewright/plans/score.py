"""Scoring: context, checks, relative checks, duplicates, and the results of all."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.config import CHECKS, Config
from framewright.dataset import Dataset
from framewright.operators import checks as C
from framewright.operators import duplicates
from framewright.operators.context import Context, build
from framewright.tables import write_and_read

#: Metrics in the order in which the checks make them.
METRICS = ("dropped_frames", "dropped_fraction", "max_gap_s", "non_monotonic_steps", "frame_index_missing", "camera_dead_count", "idle_fraction", "lead_idle_s", "trail_idle_s", "longest_pause_s", "spikes", "jumps", "ldlj", "stale_state_fraction", "sync_lag_frames", "sync_lag_s", "sync_peak_corr", "gripper_toggles_per_window", "active_s", "active_z", "ldlj_z")


@dataclass
class Scored:
    context: Context
    results: DataFrame  # episode_index, length, duration_s, task, score, flags, trim_start, trim_end and the metrics
    flags: DataFrame
    groups: DataFrame


def score_column(penalties):
    return F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(penalties, F.lit(0.0)))


def evaluate(ds: Dataset, cfg: Config | None = None, disabled=frozenset(), duplicates_too: bool = True, accuracy: int | None = None, video=None) -> Scored:
    """Scores every episode. disabled: names of checks that aren't planned at all, with what depends on them.

    accuracy: approximate percentiles for the context. video: a function (dataset, context, config) -> flags.
    """
    cfg = cfg or Config()
    if unknown := set(disabled) - set(CHECKS):
        raise ValueError(f"unknown checks: {sorted(unknown)}")
    ctx = build(ds, cfg, accuracy)
    base = ds.frames.groupBy("episode_index").agg(F.count("*").alias("length")).withColumn("duration_s", F.col("length") / F.lit(ds.fps))
    base = base.join(ds.episodes.select("episode_index", "task").dropDuplicates(["episode_index"]), "episode_index", "left")
    metrics, flags, trims = [], [], None
    for name, check in C.EPISODE_CHECKS.items():
        if name in disabled:
            continue
        m, f = check(ds, ctx, cfg, trims) if name == "smoothness" else check(ds, ctx, cfg)
        if m is not None and name in ("idle", "smoothness", "sync"):
            m = write_and_read(m, name)  # others read them
        if name == "idle" and m is not None:
            trims = m.select("episode_index", "trim_start", "trim_end").where("trim_start is not null")
        metrics += [m] if m is not None else []
        flags += [f] if f is not None else []
    if video is not None and "video_freeze" not in disabled:
        flags.append(video(ds, ctx, cfg))
    results = write_and_read(reduce(lambda a, b: a.join(b, "episode_index", "left"), metrics, base), "metrics")
    relative = [(C.length_outliers, "duration_s", "length"), (C.jerk_outliers, "ldlj", None), (C.lag_outliers, "sync_peak_corr", None)]
    enough = results.limit(5).count() == 5
    for check, needs, name in relative:
        if enough and needs in results.columns and name not in disabled:
            m, f = check(results, cfg)
            results = results if m is None else results.join(m, "episode_index", "left")
            flags.append(f)
    groups = ds.frames.sparkSession.createDataFrame([], duplicates.GROUPS)
    if duplicates_too and "duplicate" not in disabled:
        groups = write_and_read(duplicates.find(ds, ctx, cfg, trims), "groups")
        flags.append(duplicates.flags(groups))
    all_flags = write_and_read(C.union(*flags) if flags else ds.frames.sparkSession.createDataFrame([], C.FLAGS), "flags")
    each = F.struct("ord", "check", "severity", "message", "penalty")
    per = all_flags.groupBy("episode_index").agg(F.sort_array(F.collect_list(each)).alias("flags"), F.sum("penalty").alias("_p"))
    results = results.join(per, "episode_index", "left").withColumn("score", score_column(F.col("_p"))).drop("_p")
    results = results.withColumn("flags", F.coalesce("flags", F.array().cast(per.schema["flags"].dataType)))
    for c in ("trim_start", "trim_end"):
        if c not in results.columns:
            results = results.withColumn(c, F.lit(None).cast("bigint"))
    return Scored(ctx, write_and_read(results, "results"), all_flags, groups)
