"""Sequence operators over frames: differences, runs, smoothing, spikes, jerk, hysteresis, lags, resampling.

Every window is partitioned by episode_index, so one exchange serves them all. Arrays stay arrays (a value for each
dimension) and are worked on by higher-order functions; only rare events and resampled points are exploded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.config import Config
from framewright.dataset import Dataset
from framewright.functions.scalars import TINY, finite, half_even, sure, wrap
from framewright.operators.context import Context, by_episode, speeds, with_previous
from framewright.tables import write_and_read


def runs(df: DataFrame, flag: str, order: str = "pos") -> DataFrame:
    """episode_index, begin, end (exclusive): maximal stretches of consecutive positions at which flag holds."""
    marked = df.where(sure(F.col(flag))).select("episode_index", F.col(order).alias("_p"))
    island = F.col("_p") - F.row_number().over(Window.partitionBy("episode_index").orderBy("_p"))
    return marked.withColumn("_i", island).groupBy("episode_index", "_i").agg(F.min("_p").alias("begin"), (F.max("_p") + 1).alias("end")).drop("_i")


def smoothed(df: DataFrame, window: int, value: str = "speed", order: str = "t") -> DataFrame:
    """value as its centred mean over `window`, zero beyond the ends; unchanged in sequences shorter than the window."""
    if window <= 1:
        return df
    w = Window.partitionBy("episode_index").orderBy(order)
    mean = F.sum(value).over(w.rowsBetween(-(window - 1 - (window - 1) // 2), (window - 1) // 2)) / F.lit(float(window))
    return df.withColumn(value, F.when(F.count("*").over(Window.partitionBy("episode_index")) >= window, mean).otherwise(F.col(value)))


def idling(ds: Dataset, ctx: Context, cfg: Config) -> DataFrame:
    """episode_index, t, speed (smoothed), idle."""
    window = max(1, half_even(cfg.idle_smoothing_s * ds.fps))
    return smoothed(speeds(ds, ctx), window).withColumn("idle", F.col("speed") < ctx.moving)


def steps(ds: Dataset, ctx: Context, cfg: Config) -> DataFrame:
    """episode_index, t, step (scaled, wrapped where angular), big: whether each dimension's step is large."""
    f = with_previous(ds.frames).where("prev is not null and action is not null")
    angular = [*ctx.angular, *[False] * len(ctx.scale)]
    diff = [F.get("action", F.lit(i)) - F.get("prev", F.lit(i)) for i in range(len(ctx.scale))]
    f = f.withColumn("step", F.array(*[F.lit(None).cast("double") if s is None else (wrap(d) if angular[i] else d) / F.lit(float(s)) for i, (d, s) in enumerate(zip(diff, ctx.scale, strict=True))]).cast("array<double>"))
    at = [F.get("step", F.lit(i)) for i in range(len(ctx.scale))]
    f = f.withColumn("big", F.array(*[F.lit(False) if p is None else sure(~F.isnan(s) & (F.abs(s) > float(cfg.spike_factor * p))) for s, p in zip(at, ctx.step_p99, strict=True)]).cast("array<boolean>"))
    for x, z in ctx.angular_pairs:
        a, b, pa, pb = (F.get(c, F.lit(i)) for c, i in (("action", x), ("action", z), ("prev", x), ("prev", z)))
        apart, together = F.abs(wrap((a - b) - (pa - pb))), F.abs(wrap((a + b) - (pa + pb)))
        cancels = sure((F.get("big", F.lit(x)) | F.get("big", F.lit(z))) & (F.least(apart, together) < cfg.angular_pair_cancel_frac * F.greatest(F.abs(wrap(a - pa)), F.abs(wrap(b - pb)))))
        f = f.withColumn("_c", cancels).withColumn("big", F.transform("big", lambda v, i: v & ~((i.isin(x, z)) & F.col("_c")))).drop("_c")  # noqa: B023
    return f.select("episode_index", (F.col("pos") - 1).alias("t"), "step", "big")


def big_steps(ds: Dataset, ctx: Context, cfg: Config) -> DataFrame:
    """episode_index, dim, t, sign of the large steps, with the next one's t and sign. They are few; only they are exploded."""
    s = steps(ds, ctx, cfg).where(F.exists("big", lambda x: x))
    e = s.select("episode_index", "t", F.posexplode(F.arrays_zip("step", "big")).alias("dim", "x")).where("x.big")
    w = Window.partitionBy("episode_index", "dim").orderBy("t")
    return e.select("episode_index", "dim", "t", F.signum("x.step").alias("sign")).withColumn("next_t", F.lead("t").over(w)).withColumn("next_sign", F.lead("sign").over(w))


def spike_frames(big: DataFrame) -> DataFrame:
    """episode_index, t: large steps that the next frame reverses in the same dimension."""
    return big.where("next_t = t + 1 and next_sign <> sign").select("episode_index", "t").distinct()


def bridged_frames(big: DataFrame, max_gap: int) -> DataFrame:
    """episode_index, t: frames with a large step, and those in gaps of up to max_gap between large steps of one dimension and sign."""
    until = F.when((F.col("next_t") - F.col("t") > 1) & (F.col("next_t") - F.col("t") <= max_gap + 1) & (F.col("sign") == F.col("next_sign")), F.col("next_t") - 1).otherwise(F.col("t"))
    return big.select("episode_index", F.explode(F.sequence("t", until)).alias("t")).distinct()


def spikes_and_jumps(ds: Dataset, ctx: Context, cfg: Config) -> DataFrame:
    """episode_index, spikes, jumps, for episodes that have any. The two frames of a spike are in no jump."""
    big = write_and_read(big_steps(ds, ctx, cfg), "big-steps")  # read three times; few rows
    spikes = spike_frames(big)
    consumed = spikes.select("episode_index", F.explode(F.array(F.col("t"), F.col("t") + 1)).alias("t"))
    left = bridged_frames(big, cfg.smoothness_ramp_gap_frames).join(consumed, ["episode_index", "t"], "left_anti").withColumn("on", F.lit(True))
    jumps = runs(left, "on", "t").groupBy("episode_index").agg(F.count("*").alias("jumps"))
    n = spikes.groupBy("episode_index").agg(F.count("*").alias("spikes"))
    return n.join(jumps, "episode_index", "full").select("episode_index", F.coalesce("spikes", F.lit(0)).alias("spikes"), F.coalesce("jumps", F.lit(0)).alias("jumps"))


def jerkiness(ds: Dataset, ctx: Context, trims: DataFrame | None = None) -> DataFrame:
    """episode_index, ldlj: log dimensionless jerk of the (trimmed) action; null without motion. Episodes of 10 frames and more.

    trims: episode_index, trim_start, trim_end.
    """
    live = [i for i, s in enumerate(ctx.scale) if s is not None]
    f = ds.frames.where("action is not null")
    if trims is not None:
        f = f.join(trims, "episode_index", "left").where("trim_start is null or (pos >= trim_start and pos < trim_end)")
    w = by_episode()
    f = f.select("episode_index", "pos", F.array(*[F.get("action", F.lit(i)) / F.lit(float(ctx.scale[i])) for i in live]).cast("array<double>").alias("x"))
    f = f.select("episode_index", "x", *[F.lag("x", k).over(w).alias(f"x{k}") for k in (1, 2, 3)])
    dt, vel2, jerk2 = 1.0 / ds.fps, F.when(F.col("x1").isNotNull(), F.lit(0.0)), F.when(F.col("x3").isNotNull(), F.lit(0.0))
    for i in range(len(live)):
        x, x1, x2, x3 = (F.get(c, F.lit(i)) for c in ("x", "x1", "x2", "x3"))
        vel, jerk = (x - x1) / F.lit(dt), ((x - 3 * x1) + (3 * x2 - x3)) / F.lit(dt**3)
        vel2, jerk2 = vel2 + vel * vel, jerk2 + jerk * jerk
    g = f.groupBy("episode_index").agg(F.count("*").alias("n"), F.max(F.sqrt(vel2)).alias("peak"), F.sum(jerk2).alias("j")).where("n >= 10")
    t = F.col("n") * dt
    ldlj = -F.ln(F.try_divide(t * t * t, F.col("peak") * F.col("peak")) * (F.col("j") * dt) + 1e-12)
    return g.select("episode_index", F.when((F.col("peak") >= TINY) & finite(ldlj), ldlj).alias("ldlj"))


def beyond(v, mid, band, first):
    """True above mid + band, false below mid - band, null between; of the first frame, whether it is above mid."""
    return F.when(v > mid + band, True).when(v < mid - band, False).when(first, v > mid)


def hysteresis(df: DataFrame, value: str, mid, band, order: str = "pos", partition=("episode_index",)) -> DataFrame:
    """df with `open`: true above mid + band, false below mid - band, else as before; at first, above mid."""
    w = Window.partitionBy(*partition).orderBy(order)
    return df.withColumn("_s", beyond(F.col(value), mid, band, F.row_number().over(w) == 1)).withColumn("open", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def toggles(ds: Dataset, ctx: Context, cfg: Config) -> DataFrame:
    """episode_index, dim, edges, most: toggles of each gripper dimension that moves, and the most of them within the window."""
    f, dims = ds.frames.where("action is not null"), [d for d in ctx.grippers if d < len(ctx.scale) and ctx.scale[d] is not None]
    w = Window.partitionBy("episode_index").orderBy("pos")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order that the toggles need
    f = f.select("episode_index", "pos", "timestamp", *[F.get("action", F.lit(d)).alias(f"v{d}") for d in dims])
    f = f.select("*", F.count("*").over(whole).alias("n"), F.row_number().over(w).alias("i"), *[g(f"v{d}").over(whole).alias(f"{name}{d}") for d in dims for g, name in ((F.max, "hi"), (F.min, "lo"))])
    each = []
    for d in dims:
        v, hi, lo = (F.col(f"{c}{d}") for c in ("v", "hi", "lo"))
        moves = (F.col("n") >= 5) & ~F.isnan(hi) & (hi - lo >= cfg.gripper_active_frac * F.lit(float(ctx.scale[d])))
        each.append(F.when(moves, F.struct(F.lit(d).alias("dim"), beyond(v, (hi + lo) / 2, cfg.gripper_hysteresis_frac * (hi - lo), F.col("i") == 1).alias("open"))))
    if not each:
        return f.sparkSession.createDataFrame([], "episode_index bigint, dim int, edges bigint, most bigint")
    f = f.withColumn("x", F.explode(F.array(*each))) if len(each) > 1 else f.withColumn("x", each[0])
    # Between the bounds a gripper stays as it is, so these frames can be left out.
    f = f.where("x.open is not null").select("episode_index", "x.dim", "pos", "timestamp", "x.open")
    if len(each) == 1:
        f = f.withColumn("before", F.lag("open").over(w))
    else:
        f = f.withColumn("before", F.lag("open").over(Window.partitionBy("episode_index", "dim").orderBy("pos")))
    near = F.expr(f"count(*) over (partition by episode_index, dim order by timestamp range between {float(cfg.gripper_chatter_window_s)!r}D preceding and current row)")
    return f.where("before <> open").withColumn("c", near).groupBy("episode_index", "dim").agg(F.count("*").alias("edges"), F.max("c").alias("most"))


def best_lags(ds: Dataset, ctx: Context, cfg: Config) -> DataFrame:
    """episode_index, lag, corr: the lag of state behind action with the highest mean correlation of their velocities.

    The shifted states are window columns of one pass; a row for each frame and lag, not a join. Of equal
    correlations the least lag counts. Episodes of 10 frames and more with an overlap of 10.
    """
    a_dims, s_dims = ctx.sync_dims
    most, w = max(1, half_even(cfg.sync_max_lag_s * ds.fps)), by_episode()
    lags, at = list(range(-most, most + 1)), lambda c, i: F.get(F.col(c), F.lit(i))
    pick = lambda c, dims: F.array(*[F.get(c, F.lit(d)) for d in dims])
    minus = lambda c, p: F.array(*[at(c, i) - at(p, i) for i in range(len(a_dims))])
    f = ds.frames.where(f"size(action) > {max(a_dims)} and size(state) > {max(s_dims)}").select("episode_index", "pos", pick("action", a_dims).alias("a"), pick("state", s_dims).alias("s"))
    f = f.select("*", F.lag("a").over(w).alias("pa"), F.lag("s").over(w).alias("ps")).where("pa is not null").select("episode_index", "pos", minus("a", "pa").alias("a"), minus("s", "ps").alias("s"))
    f = f.select("episode_index", "a", *[(F.lead("s", k).over(w) if k > 0 else F.lag("s", -k).over(w) if k < 0 else F.col("s")).alias(f"s{j}") for j, k in enumerate(lags)])
    shifted = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"s{j}").alias("s")) for j, k in enumerate(lags)])
    each = f.select("episode_index", "a", F.explode(shifted).alias("x")).where("x.s is not null").select("episode_index", "x.lag", *[g for i in range(len(a_dims)) for g in (at("a", i).alias(f"a{i}"), at("x.s", i).alias(f"s{i}"))])
    per = [F.struct(F.covar_pop(f"a{i}", f"s{i}").alias("c"), F.stddev_pop(f"a{i}").alias("a"), F.stddev_pop(f"s{i}").alias("s")) for i in range(len(a_dims))]
    g = each.groupBy("episode_index", "lag").agg(F.count("*").alias("n"), F.array(*per).alias("per"))
    # Without a lag all velocities of the action are there: their number, and which dimensions move.
    whole = F.max(F.when(F.col("lag") == 0, F.struct("n", F.transform("per", lambda y: sure(y["a"] > TINY)).alias("moves")))).over(Window.partitionBy("episode_index"))
    g = g.withColumn("whole", whole).where("whole.n >= 9")
    r = F.zip_with("per", "whole.moves", lambda y, m: F.when(m & sure(y["s"] > TINY), F.when(F.col("n") * y["a"] * y["s"] > TINY, F.try_divide(y["c"], y["a"] * y["s"])).otherwise(F.lit(0.0))))
    g = g.select("episode_index", "lag", "n", F.exists("whole.moves", lambda m: m).alias("moves"), F.array_compact(r).alias("r"))
    corr = F.when(F.size("r") > 0, F.try_divide(F.aggregate("r", F.lit(0.0), lambda t, x: t + x), F.size("r")))
    g = g.select("episode_index", "lag", "moves", F.when(F.col("n") >= 10, corr).alias("corr"))
    g = g.groupBy("episode_index").agg(F.max("moves").alias("moves"), F.max(F.when(F.col("corr").isNotNull(), F.struct("corr", (-F.col("lag")).alias("m")))).alias("b")).where("not moves or b is not null")
    return g.select("episode_index", F.when(F.col("moves"), -F.col("b.m")).otherwise(0).alias("lag"), F.when(F.col("moves"), F.col("b.corr")).otherwise(F.lit(0.0)).alias("corr"))


def resampled(frames: DataFrame, n: int, value: str = "action") -> DataFrame:
    """episode_index, k (0 to n - 1), v (array): linear interpolation at n points over each episode's frames, in order of pos from 0.

    Points join the two frames beside them; an episode gives n rows, however long it is.
    """
    size = frames.groupBy("episode_index").agg(F.count("*").alias("len")).where("len >= 2")
    x = F.col("k") * (F.col("len") - 1) / F.lit(float(n - 1))
    points = size.select("episode_index", "len", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).withColumn("x", x)
    points = points.withColumn("lo", F.least(F.floor("x").cast("int"), (F.col("len") - 2).cast("int"))).withColumn("part", F.col("x") - F.col("lo"))
    w = by_episode()
    pairs = frames.select("episode_index", F.col("pos").alias("lo"), F.col(value).alias("u"), F.lead(value).over(w).alias("v"))
    between = F.zip_with("u", "v", lambda a, b: a + (b - a) * F.col("part"))
    return points.join(pairs, ["episode_index", "lo"]).select("episode_index", "k", between.alias("v"))
