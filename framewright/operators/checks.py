"""The checks. Each gives its metrics (a row for an episode, episode_index first) and its flags.

flags: episode_index, ord, check, severity, message, penalty. ord puts an episode's flags in the order of the
checks. A check plans nothing if it doesn't apply to the dataset, and returns None for what it lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.config import Config
from framewright.dataset import Dataset
from framewright.functions.scalars import finite, half_even, robust_z, sure
from framewright.operators import signals
from framewright.operators.context import Context, by_episode, stale_column, with_previous
from framewright.tables import write_and_read

ORD = {"timing": 10, "metadata": 20, "integrity": 30, "video_sync": 40, "camera": 50, "video_freeze": 60, "idle": 70, "smoothness": 80, "stale_state": 90, "sync": 100, "gripper_chatter": 110, "length": 120, "jerk": 130, "lag": 140, "duplicate": 150}
FLAGS = "episode_index bigint, ord int, check string, severity string, message string, penalty double"


def flag(df: DataFrame, when: Column, check: str, severity, message: Column, penalty, ord_: int) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    penalty = penalty if isinstance(penalty, Column) else F.lit(float(penalty))
    return df.where(sure(when)).select("episode_index", F.lit(ord_).alias("ord"), F.lit(check).alias("check"), severity.alias("severity"), message.alias("message"), penalty.cast("double").alias("penalty"))


def union(*parts: DataFrame | None) -> DataFrame | None:
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def percent(c: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def lengths(ds: Dataset) -> DataFrame:
    return ds.frames.groupBy("episode_index").agg(F.count("*").alias("length"))


def timing(ds: Dataset, ctx: Context, cfg: Config):
    """Dropped frames, time that stands still or runs back, missing frame numbers."""
    w, expected = by_episode(), 1.0 / ds.fps
    f = ds.frames.select("episode_index", "pos", (F.col("timestamp") - F.lag("timestamp").over(w)).alias("dt"), (F.col("frame_index") - F.lag("frame_index").over(w)).alias("step"))
    gap = sure(F.col("dt") > cfg.gap_factor * expected)
    m = f.groupBy("episode_index").agg(
        F.count("*").alias("n"), F.sum(F.when(gap, F.rint(F.col("dt") / F.lit(expected)) - 1).otherwise(0.0)).cast("bigint").alias("dropped_frames"), F.max("dt").alias("max_gap_s"),
        F.count_if(F.col("dt") <= 0).alias("non_monotonic_steps"), F.sum(F.greatest(F.col("step") - 1, F.lit(0))).alias("frame_index_missing"),
    ).where("n >= 2").withColumn("dropped_fraction", F.col("dropped_frames") / (F.col("n") + F.col("dropped_frames")))
    share, o = F.col("dropped_fraction"), ORD["timing"]
    flags = union(
        flag(m, F.col("non_monotonic_steps") > 0, "timing", "error", F.format_string("%d non-increasing timestamp step(s)", "non_monotonic_steps"), 30, o),
        flag(m, F.col("dropped_frames") > 0, "timing", F.when(share < 0.05, "warn").otherwise("error"), F.concat(F.format_string("~%d dropped frame(s) (", "dropped_frames"), percent(share, 1), F.format_string("), largest gap %.3fs", "max_gap_s")), F.least(F.lit(40.0), 300 * share + 5), o + 1),
        flag(m, (F.col("frame_index_missing") > 0) & (F.col("dropped_frames") == 0), "timing", "warn", F.format_string("%d missing frame_index value(s)", "frame_index_missing"), 10, o + 2),
    )
    return m.select("episode_index", "dropped_frames", "dropped_fraction", "max_gap_s", "non_monotonic_steps", "frame_index_missing"), flags


def metadata(ds: Dataset, ctx: Context, cfg: Config):
    both = lengths(ds).join(ds.episodes.select("episode_index", "meta_length"), "episode_index")
    return None, flag(both, F.col("meta_length") != F.col("length"), "metadata", "error", F.format_string("metadata says %d frames, data has %d", "meta_length", "length"), 20, ORD["metadata"])


def integrity(ds: Dataset, ctx: Context, cfg: Config):
    """Frames with NaN, infinite or missing numbers in a stream."""
    bad = lambda c: F.count_if(sure(F.exists(c, lambda x: ~finite(x))))
    m = ds.frames.groupBy("episode_index").agg(bad("action").alias("a"), bad("state").alias("s"))
    said = F.concat_ws(", ", F.when(F.col("a") > 0, F.format_string("action (%d frame(s))", "a")), F.when(F.col("s") > 0, F.format_string("observation.state (%d frame(s))", "s")))
    return None, flag(m, (F.col("a") > 0) | (F.col("s") > 0), "integrity", "error", F.concat(F.lit("non-finite (NaN/Inf) value(s) in "), said), 60, ORD["integrity"])


def video_sync(ds: Dataset, ctx: Context, cfg: Config):
    """Cameras whose span differs from the data's duration."""
    d = ds.episodes.where("spans is not null").join(lengths(ds), "episode_index").withColumn("d", F.col("length") / F.lit(ds.fps))
    off = F.filter(F.map_entries("spans"), lambda e: F.abs((e["value"]["end"] - e["value"]["start"]) - F.col("d")) > cfg.gap_factor / ds.fps)
    d = d.withColumn("off", off)
    said = F.concat_ws(", ", F.transform("off", lambda e: F.format_string("%s %.2fs", e["key"], e["value"]["end"] - e["value"]["start"])))
    return None, flag(d, F.size("off") > 0, "video_sync", "error", F.concat(F.format_string("video span != data duration %.2fs: ", "d"), said), 20, ORD["video_sync"])


def camera(ds: Dataset, ctx: Context, cfg: Config):
    """Cameras that are near black throughout."""
    dark = F.filter(F.array_sort(F.map_entries("cameras")), lambda e: (e["value"]["mean"] <= cfg.camera_dark_mean_max) & (e["value"]["std"] <= cfg.camera_dark_std_max))
    d = ds.episodes.where("cameras is not null").withColumn("dark", dark).where("size(dark) > 0").withColumn("camera_dead_count", F.size("dark"))
    said = F.concat_ws("; ", F.transform("dark", lambda e: F.format_string("%s (mean=%.3f, std=%.3f)", e["key"], e["value"]["mean"], e["value"]["std"])))
    text = F.concat(F.lit("near-black for the whole episode (disconnected camera or lens cap?): "), said)
    return d.select("episode_index", "camera_dead_count"), flag(d, F.lit(True), "camera", "error", text, F.least(F.lit(50.0), 25.0 * F.col("camera_dead_count")), ORD["camera"])


def idle(ds: Dataset, ctx: Context, cfg: Config):
    """Stretches without motion. The metrics carry trim_start and trim_end, the frames to keep."""
    if ctx.scale is None:
        return None, None
    fps = ds.fps
    size = ds.frames.where("action is not null").groupBy("episode_index").agg(F.count("*").alias("length"))
    t = write_and_read(signals.idling(ds, ctx, cfg).select("episode_index", "t", "idle"), "idling")  # read twice
    ends = t.groupBy("episode_index").agg(F.count("*").alias("n"), F.min(F.when(~F.col("idle"), F.col("t"))).alias("first"), F.max(F.when(~F.col("idle"), F.col("t"))).alias("last"), F.avg(F.col("idle").cast("double")).alias("part"))
    inside = signals.runs(t, "idle", "t").join(ends.select("episode_index", "first", "last"), "episode_index").where("begin > first and begin < last")
    pause = inside.groupBy("episode_index").agg(F.max(F.col("end") - F.col("begin")).alias("pause"))
    d = size.join(ends, "episode_index", "left").join(pause, "episode_index", "left").withColumn("dead", F.col("first").isNull())
    d = d.where("length >= 3 or dead")
    lead, trail = F.col("first"), F.col("n") - 1 - F.col("last")
    d = d.select("episode_index", "length", "dead", F.when(~F.col("dead"), lead).alias("lead"), F.when(~F.col("dead"), trail).alias("trail"), F.coalesce("pause", F.lit(0)).alias("pause"), "part")
    pad = half_even(cfg.trim_pad_s * fps)
    free = (F.col("lead") + F.col("trail")) / F.lit(fps)
    trims = sure(free >= cfg.min_trimmable_idle_s)
    m = d.select(
        "episode_index", "length", F.when(F.col("dead"), 1.0).otherwise(F.col("part")).alias("idle_fraction"), F.when(F.col("dead"), F.col("length") / F.lit(fps)).otherwise(F.col("lead") / F.lit(fps)).alias("lead_idle_s"),
        F.when(F.col("dead"), 0.0).otherwise(F.col("trail") / F.lit(fps)).alias("trail_idle_s"), F.when(~F.col("dead"), F.col("pause") / F.lit(fps)).alias("longest_pause_s"),
        F.when(trims, F.greatest(F.lit(0), F.col("lead") - pad)).cast("bigint").alias("trim_start"), F.when(trims, F.least(F.col("length"), F.col("length") - F.col("trail") + pad)).cast("bigint").alias("trim_end"), "dead", free.alias("free"),
    )
    o, f, p = ORD["idle"], F.col("idle_fraction"), F.col("longest_pause_s")
    flags = union(
        flag(m, F.col("dead"), "idle", "error", F.lit("no motion detected in the whole episode"), 60, o),
        flag(m, F.col("trim_start").isNotNull(), "idle", "info", F.format_string("%.1fs idle at start/end (lead %.1fs, trail %.1fs); trim to frames [%d, %d)", "free", "lead_idle_s", "trail_idle_s", "trim_start", "trim_end"), F.least(F.lit(10.0), 2 * F.col("free")), o + 1),
        flag(m, ~F.col("dead") & (f > cfg.max_idle_fraction), "idle", "warn", F.concat(F.lit("idle "), percent(f), F.lit(" of the episode")), (f - cfg.max_idle_fraction) * 50, o + 2),
        flag(m, p > cfg.max_pause_s, "idle", "warn", F.format_string("operator paused %.1fs mid-episode", p), 5, o + 3),
    )
    return m.drop("length", "dead", "free"), flags


def abruptness(ds: Dataset, ctx: Context, cfg: Config):
    """Spikes and jumps."""
    if ctx.scale is None:
        return None, None
    size = ds.frames.where("action is not null").groupBy("episode_index").agg(F.count("*").alias("n")).where("n >= 3").select("episode_index")
    m = size.join(signals.spikes_and_jumps(ds, ctx, cfg), "episode_index", "left").select("episode_index", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("spikes", "jumps")])
    m = write_and_read(m, "abruptness")  # the metrics and two flags
    o = ORD["smoothness"]
    return m, union(
        flag(m, F.col("spikes") > 0, "smoothness", "warn", F.format_string("%d single-frame action spike(s) (sensor glitch?)", "spikes"), F.least(F.lit(25.0), 8.0 * F.col("spikes")), o),
        flag(m, F.col("jumps") > 0, "smoothness", "warn", F.format_string("%d abrupt action jump(s)", "jumps"), F.least(F.lit(20.0), 5.0 * F.col("jumps")), o + 1),
    )


def smoothness(ds: Dataset, ctx: Context, cfg: Config, trims: DataFrame | None = None):
    m, flags = abruptness(ds, ctx, cfg)
    return (None, None) if m is None else (m.join(signals.jerkiness(ds, ctx, trims), "episode_index", "left"), flags)


def stale_state(ds: Dataset, ctx: Context, cfg: Config):
    if ctx.scale is None:
        return None, None
    f = with_previous(ds.frames).withColumn("prev_state", F.lag("state").over(by_episode())).where("prev is not null and prev_state is not null")
    f = write_and_read(f.select("episode_index", "pos", stale_column(ctx).alias("stale")), "stale")  # read twice
    m = f.groupBy("episode_index").agg(F.avg(F.col("stale").cast("double")).alias("stale_state_fraction"), F.count("*").alias("n")).where("n >= 2")
    longest = signals.runs(f, "stale").groupBy("episode_index").agg(F.max(F.col("end") - F.col("begin")).alias("longest"))
    m = write_and_read(m.join(longest, "episode_index", "left").withColumn("longest", F.coalesce("longest", F.lit(0))), "stale-metrics")
    excess = F.col("stale_state_fraction") - F.lit(ctx.stale_baseline)
    note = F.concat(F.lit("; dataset baseline "), percent(F.lit(ctx.stale_baseline))) if ctx.stale_baseline > 1e-9 else F.lit("")
    text = F.concat(F.lit("observation.state frozen on "), percent(F.col("stale_state_fraction")), F.format_string(" of moving frames (longest run %d frames)", "longest"), note)
    return m.select("episode_index", "stale_state_fraction"), flag(m, excess > cfg.stale_state_max_fraction, "stale_state", "warn", text, F.least(F.lit(30.0), 100 * (excess - cfg.stale_state_max_fraction) + 10), ORD["stale_state"])


def sync(ds: Dataset, ctx: Context, cfg: Config):
    if ctx.sync_dims is None:
        return None, None
    m = write_and_read(signals.best_lags(ds, ctx, cfg), "lags")  # the baseline, the metrics and the flag
    base = m.agg(F.when(F.count("corr") >= 5, F.median("corr")).alias("baseline"))
    m = m.join(F.broadcast(base))  # one row
    low = (F.col("corr") < cfg.sync_min_peak_corr) & (F.col("baseline").isNull() | (F.col("baseline") - F.col("corr") > cfg.sync_corr_min_drop))
    text = F.concat(F.format_string("action/observation.state correlation is weak (r=%.2f); lag estimate unreliable", "corr"), F.coalesce(F.format_string(" (dataset baseline r=%.2f)", F.col("baseline")), F.lit("")))
    text = F.when(F.col("baseline").isNull(), F.format_string("action/observation.state correlation is weak (r=%.2f); lag estimate unreliable", "corr")).otherwise(text)
    flags = flag(m, low, "sync", "warn", text, 10, ORD["sync"])
    return m.select("episode_index", F.col("lag").cast("double").alias("sync_lag_frames"), (F.col("lag") / F.lit(ds.fps)).alias("sync_lag_s"), F.col("corr").alias("sync_peak_corr")), flags


def gripper_chatter(ds: Dataset, ctx: Context, cfg: Config):
    if ctx.scale is None or not [d for d in ctx.grippers if d < len(ctx.scale)]:
        return None, None
    t = write_and_read(signals.toggles(ds, ctx, cfg).where(F.col("edges") >= cfg.gripper_chatter_min_toggles), "toggles")  # the metrics and the flag
    m = t.groupBy("episode_index").agg(F.max(F.struct("most", (-F.col("dim")).alias("m"))).alias("x")).select("episode_index", F.col("x.most").alias("gripper_toggles_per_window"), (-F.col("x.m")).alias("dim"))
    n = F.col("gripper_toggles_per_window")
    text = F.format_string(f"gripper toggled %dx within {cfg.gripper_chatter_window_s:.1f}s (dim %d); chatter rather than a deliberate grasp?", n, F.col("dim"))
    return m.select("episode_index", "gripper_toggles_per_window"), flag(m, n >= cfg.gripper_chatter_min_toggles, "gripper_chatter", "warn", text, F.least(F.lit(20.0), 3.0 * n), ORD["gripper_chatter"])


EPISODE_CHECKS = {"timing": timing, "metadata": metadata, "integrity": integrity, "video_sync": video_sync, "camera": camera, "idle": idle, "smoothness": smoothness, "stale_state": stale_state, "sync": sync, "gripper_chatter": gripper_chatter}


# ---- relative checks: an episode among its peers ------------------------------------------------------------


def with_robust(df: DataFrame, value: str) -> DataFrame:
    """df with the median and median absolute deviation of value, and how many there are, over all rows. Two small aggregates, each one row."""
    m = df.agg(F.median(value).alias("_median"), F.count(value).alias("_count"))
    df = df.join(F.broadcast(m))
    mad = df.agg(F.median(F.abs(F.col(value) - F.col("_median"))).alias("_mad"))
    return df.join(F.broadcast(mad))


def active_seconds(results: DataFrame) -> Column:
    lead = F.col("lead_idle_s") if "lead_idle_s" in results.columns else F.lit(None).cast("double")
    trail = F.col("trail_idle_s") if "trail_idle_s" in results.columns else F.lit(None).cast("double")
    return F.when(lead.isNull(), F.col("duration_s")).otherwise(F.greatest(F.lit(0.0), F.col("duration_s") - lead - trail))


def length_outliers(results: DataFrame, cfg: Config):
    """active_s and active_z of every episode, flags of those unlike their peers; nothing among fewer than 5. results: episode_index, duration_s [, lead_idle_s, trail_idle_s]."""
    d = with_robust(results.select("episode_index", active_seconds(results).alias("active_s")), "active_s").where("_count >= 5")
    d = d.withColumn("active_z", robust_z(F.col("active_s"), F.col("_median"), F.col("_mad")))
    material = F.abs(F.col("active_s") - F.col("_median")) > cfg.min_relative_length_diff * F.col("_median")
    text = lambda how, more: F.format_string(f"unusually {how}: %.1fs of activity vs median %.1fs (z=%.1f){more}", "active_s", "_median", "active_z")
    flags = union(
        flag(d, (F.col("active_z") < -cfg.outlier_z) & material, "length", "warn", text("short", "; aborted demo?"), 10, ORD["length"]),
        flag(d, (F.col("active_z") > cfg.outlier_z) & material, "length", "info", text("long", ""), 5, ORD["length"]),
    )
    return d.select("episode_index", "active_s", "active_z"), flags


def jerk_outliers(results: DataFrame, cfg: Config):
    """ldlj_z, and flags of episodes much jerkier than their peers; nothing with fewer than 5 values. results: episode_index, ldlj."""
    d = with_robust(results.where(finite(F.col("ldlj"))).select("episode_index", "ldlj"), "ldlj").where("_count >= 5")
    d = d.withColumn("ldlj_z", robust_z(F.col("ldlj"), F.col("_median"), F.col("_mad")))
    z = F.col("ldlj_z")
    flags = flag(d, (z < cfg.jerk_z) & (F.col("_median") - F.col("ldlj") > cfg.min_ldlj_diff), "smoothness", "warn", F.format_string("much jerkier than peers (smoothness z=%.1f)", z), F.least(F.lit(20.0), -4 * z), ORD["jerk"])
    return d.select("episode_index", "ldlj_z"), flags


def lag_outliers(results: DataFrame, cfg: Config):
    """Flags of episodes whose lag differs from the median of those with a trustworthy correlation; nothing with fewer than 5. results: episode_index, sync_lag_frames, sync_peak_corr."""
    sure_ = results.where(F.col("sync_peak_corr") >= cfg.sync_min_peak_corr).select("episode_index", "sync_lag_frames", "sync_peak_corr")
    m = sure_.agg(F.median("sync_lag_frames").alias("_median"), F.count("*").alias("_count"))
    d = sure_.join(F.broadcast(m)).where("_count >= 5").withColumn("off", F.abs(F.col("sync_lag_frames") - F.col("_median")))
    text = F.format_string("action/observation.state lag is %.0f frames vs dataset median %.0f (r=%.2f); possible bad sync", "sync_lag_frames", "_median", "sync_peak_corr")
    return None, flag(d, F.col("off") > cfg.sync_lag_outlier_frames, "sync", "warn", text, F.least(F.lit(25.0), 5 * F.col("off")), ORD["lag"])


def rank_by_episode() -> Window:
    return Window.partitionBy("episode_index").orderBy("ord", "message")
