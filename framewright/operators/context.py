"""What the checks know of the whole dataset: scales of the dimensions, their usual steps, the speed of idling.

All of it comes from aggregates over all frames, of which the driver gets a row for each dimension.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from statistics import median

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from framewright.config import Config
from framewright.dataset import Dataset
from framewright.functions.scalars import MAD, TINY, axis_pairs, finite, gripper_dims, matched_dims, not_nan, sure, wrap
from framewright.operators.quantiles import percentiles
from framewright.tables import write_and_read


@dataclass(frozen=True)
class Context:
    fps: float
    scale: list[float | None] | None  # of each action dimension; None: constant, left out
    step_p99: list[float | None] | None  # usual large step, in units of scale; None: left out
    angular: list[bool] = field(default_factory=list)
    angular_pairs: list[tuple[int, int]] = field(default_factory=list)
    grippers: list[int] = field(default_factory=list)
    sync_dims: tuple[list[int], list[int]] | None = None
    idle_speed: float = 0.0
    stale_baseline: float = 0.0
    parts: frozenset = frozenset()  # of PARTS, those that were computed

    @property
    def moving(self) -> float:
        """Speed under which nothing moves."""
        return max(self.idle_speed, TINY)


def by_episode() -> Window:
    return Window.partitionBy("episode_index").orderBy("pos")


def with_previous(frames: DataFrame) -> DataFrame:
    """frames with prev: the action of the frame before. One exchange by episode serves all windows that follow."""
    return frames if "prev" in frames.columns else frames.withColumn("prev", F.lag("action").over(by_episode()))


#: What a context can hold; a check that needs only some of it pays for no more.
PARTS = ("scale", "steps", "idle", "stale")


def repeated(frames: DataFrame) -> DataFrame:
    """Frames with actions of episodes that have several of them."""
    f = frames.where("action is not null")
    alone = f.groupBy("episode_index").agg(F.count("*").alias("_n")).where("_n = 1")
    return f if alone.isEmpty() else f.join(alone, "episode_index", "left_anti")


#: Percentiles of dim_stats: of which values, and which share.
PERCENTILES = {"q25": ("v", 0.25), "q75": ("v", 0.75), "p99": ("step", 0.99), "turn99": ("turn", 0.99)}
DIM_STATS = "dim int, q25 double, q75 double, std double, lo double, hi double, p99 double, turn99 double"


def dim_stats(frames: DataFrame, accuracy: int | None = None, names=tuple(PERCENTILES)) -> DataFrame:
    """A row for each action dimension, over episodes of more than one frame: q25, q75, std, lo, hi, and the 99th percentiles of steps, plain and wrapped.

    Percentiles are exact and interpolate, and are computed at once; with accuracy they are approximate. Neither way
    keeps a table of all values in one task. names: the percentiles that are needed; the others are null.
    """
    if accuracy is not None:
        long_ = with_previous(frames).withColumn("_n", F.count("action").over(Window.partitionBy("episode_index"))).where("_n > 1 and action is not null")
        each = long_.select(F.posexplode(F.arrays_zip("action", F.coalesce("prev", F.transform("action", lambda x: F.lit(None).cast("double"))).alias("prev"))).alias("dim", "x"))
        v, d = not_nan(F.col("x.action")), not_nan(F.col("x.action") - F.col("x.prev"))
        each = each.select("dim", v.alias("v"), F.abs(d).alias("step"), F.abs(wrap(d)).alias("turn"))
        return each.groupBy("dim").agg(
            *[F.percentile_approx(c, p, accuracy).alias(n) for n, (c, p) in PERCENTILES.items()], F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        )
    of = lambda kind: [PERCENTILES[n][1] for n in names if PERCENTILES[n][0] == kind]
    values = each_dim(repeated(frames), "action")
    found = {r["dim"]: r for r in percentiles(values, ["dim"], of("v"), more=[F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi")])}
    steps = {kind: {} for kind in ("step", "turn")}
    if found and (of("step") or of("turn")):
        moved = moves(frames, [k for k in steps if of(k)], len(found))
        steps = {k: step_percentiles(moved, k, of(k)) for k in steps}
    at = lambda d, n: (found if PERCENTILES[n][0] == "v" else steps[PERCENTILES[n][0]]).get(d, {}).get(PERCENTILES[n][1]) if n in names else None
    rows = [(d, at(d, "q25"), at(d, "q75"), r["std"], r["lo"], r["hi"], at(d, "p99"), at(d, "turn99")) for d, r in sorted(found.items())]
    return frames.sparkSession.createDataFrame(rows, DIM_STATS)


def each_dim(df: DataFrame, column: str) -> DataFrame:
    """dim and v: a row for each number of an array."""
    return df.select(F.posexplode(column).alias("dim", "v")).select("dim", not_nan(F.col("v")).alias("v"))


def moves(frames: DataFrame, kinds, width: int, more=()) -> DataFrame:
    """Transitions, written once, so that passes over them need no exchange: episode_index, t, acts (the frame has an action), the kinds (step, turn: arrays of width) and the columns more.

    more may use the columns action, prev, state and prev_state.
    """
    turns = {"step": lambda d: F.abs(d), "turn": lambda d: F.abs(wrap(d))}
    diff = [F.get("action", F.lit(i)) - F.get("prev", F.lit(i)) for i in range(width)]
    f = with_previous(frames).withColumn("prev_state", F.lag("state").over(by_episode()) if "state" in frames.columns else F.lit(None))
    f = f.where("prev is not null").select("episode_index", (F.col("pos") - 1).alias("t"), F.col("action").isNotNull().alias("acts"), *[F.array(*[turns[k](d) for d in diff]).alias(k) for k in kinds], *more)
    return write_and_read(f, "moves")


def step_percentiles(moved: DataFrame, kind: str, shares) -> dict[int, dict]:
    """dim: percentiles of its steps."""
    return {r["dim"]: r for r in percentiles(each_dim(moved.where("acts"), kind), ["dim"], shares)} if shares else {}


def scale_of(q25, q75, std) -> float | None:
    """Interquartile range as a standard deviation; the standard deviation if that is nil; None if that is, too."""
    s = (q75 - q25) / 1.349 if q25 is not None else 0.0
    s = s if s > TINY else (std or 0.0)
    return s if s > TINY and math.isfinite(s) else None


def scale_column():
    s = (F.col("q75") - F.col("q25")) / 1.349
    s = F.when(s > TINY, s).otherwise(F.col("std"))
    return F.when(s > TINY, s)


def angular_column(cfg: Config):
    reach, tol = math.pi - cfg.angular_wrap_reach, math.pi + cfg.angular_wrap_tol
    return sure((F.col("hi") <= tol) & (F.col("lo") >= -tol) & (F.col("hi") >= reach) & (F.col("lo") <= -reach))


def _log_outliers(values: list[float | None], far) -> set[int]:
    """Positions whose logarithm is far from the median, in robust units; none among fewer than 5."""
    logs = {i: math.log(v) for i, v in enumerate(values) if v is not None and math.isfinite(v) and v > 0}
    if len(logs) < 5:
        return set()
    mid = median(logs.values())
    mad = MAD * median(abs(x - mid) for x in logs.values())
    return {i for i, x in logs.items() if far((x - mid) / mad)} if mad >= TINY else set()


def usable_steps(step_p99, scale, grippers, z: float):
    """step_p99 without dimensions that are mostly noise, nearly constant, or grippers."""
    out = [p if p is not None and p > TINY else None for p in step_p99]
    for i in _log_outliers(out, lambda x: abs(x) > z) | _log_outliers(scale, lambda x: x < -z) | set(grippers):
        if i < len(out):
            out[i] = None
    return out


def speed_column(ctx: Context, action="action", prev="prev"):
    """Root mean square over the live dimensions, in scales a second; 0 if none is finite."""
    square, live = F.lit(0.0), F.lit(0)
    for i, scale in enumerate(ctx.scale):
        if scale is not None:
            d = (F.get(action, F.lit(i)) - F.get(prev, F.lit(i))) / F.lit(float(scale)) * F.lit(ctx.fps)
            square, live = square + F.when(finite(d), d * d).otherwise(F.lit(0.0)), live + finite(d).cast("int")
    return F.sqrt(square / F.greatest(live, F.lit(1)))


def same_state():
    """All of the state is repeated; needs the columns state and prev_state."""
    return sure(F.forall(F.zip_with("state", "prev_state", lambda a, b: sure(a - b == 0)), lambda x: x))


def stale_column(ctx: Context):
    """All of the state is repeated while the action moves; needs the columns action, prev, state and prev_state."""
    return sure(same_state() & (speed_column(ctx) > 5 * ctx.moving))


def build(ds: Dataset, cfg: Config, accuracy: int | None = None, parts=PARTS, known: Context | None = None) -> Context:
    """The context, of which only the parts asked for are computed (and what they need), beside those known. Without episodes of two frames with actions there is no scale, and nothing idles."""
    todo = set(parts) - (known.parts if known else set())
    ctx = known or unscaled(ds)
    if not todo:
        return ctx
    if "scale" not in ctx.parts:
        ctx = _scaled(ds, cfg, ctx, accuracy)
    if ctx.scale is None:
        return replace(ctx, parts=ctx.parts | todo)
    todo -= ctx.parts
    kinds = ["step", "turn"] if any(ctx.angular) else ["step"]
    if todo:
        moved = moves(ds.frames, kinds if "steps" in todo else [], len(ctx.scale), motion_columns(ctx, "stale" in todo) if todo & {"idle", "stale"} else ())
    if "steps" in todo:
        of = {k: step_percentiles(moved, k, [0.99]) for k in kinds}
        steps = [of["turn" if a else "step"].get(i, {}).get(0.99) for i, a in enumerate(ctx.angular)]
        ctx = _stepped(ctx, cfg, steps)
    if todo & {"idle", "stale"}:
        ctx = motion(moved, ctx, cfg, accuracy)
    return ctx


def unscaled(ds: Dataset) -> Context:
    """What names tell; streams without names are measured."""
    first = Row(a=None, s=None)
    if not (ds.action_names and ds.state_names):
        width = lambda c: F.max(F.when(F.col(c).isNotNull(), F.size(c)))
        first = ds.frames.agg(width("action").alias("a"), width("state").alias("s")).collect()[0]
    return Context(ds.fps, None, None, grippers=gripper_dims(ds.action_names), sync_dims=matched_dims(ds.action_names, ds.state_names, first.a, first.s))


def _scaled(ds: Dataset, cfg: Config, ctx: Context, accuracy: int | None) -> Context:
    rows = dim_stats(ds.frames, accuracy, ("q25", "q75")).select("*", angular_column(cfg).alias("angular")).orderBy("dim").collect()
    if not rows:
        return replace(ctx, parts=frozenset(PARTS))
    angular = [bool(r.angular) for r in rows]
    ctx = replace(ctx, scale=[scale_of(r.q25, r.q75, r["std"]) for r in rows], angular=angular, angular_pairs=axis_pairs(ds.action_names, angular), parts=ctx.parts | {"scale"})
    return ctx if accuracy is None else _stepped(ctx, cfg, [r.turn99 if a else r.p99 for r, a in zip(rows, angular, strict=True)])


def _stepped(ctx: Context, cfg: Config, steps: list) -> Context:
    steps = [None if s is None else p and p / s for p, s in zip(steps, ctx.scale, strict=True)]
    return replace(ctx, step_p99=usable_steps(steps, ctx.scale, ctx.grippers, cfg.smoothness_dim_outlier_z), parts=ctx.parts | {"steps"})


def speeds(ds: Dataset, ctx: Context) -> DataFrame:
    """episode_index, t (transition, from 0), speed."""
    return with_previous(ds.frames).where("prev is not null and action is not null").select("episode_index", (F.col("pos") - 1).alias("t"), speed_column(ctx).alias("speed"))


def speed_p75(moving: DataFrame, accuracy: int | None = None) -> float | None:
    if accuracy is not None:
        return moving.agg(F.percentile_approx("speed", 0.75, accuracy).alias("p")).collect()[0].p
    return percentiles(moving.select(F.col("speed").alias("v")), [], [0.75])[0][0.75]


def motion_columns(ctx: Context, states: bool = True) -> list:
    """Of moves: speed, and same: whether the state is repeated, null where one of both is missing."""
    return [speed_column(ctx).alias("speed"), *([F.when(F.col("prev_state").isNotNull(), same_state()).alias("same")] if states else [])]


def motion(moved: DataFrame, ctx: Context, cfg: Config, accuracy: int | None = None) -> Context:
    """ctx with idle_speed, and with stale_baseline if the moves have the column same."""
    if "idle" not in ctx.parts:
        ctx = replace(ctx, idle_speed=cfg.idle_fraction_of_p75 * (speed_p75(moved.where("acts"), accuracy) or 0.0), parts=ctx.parts | {"idle"})
    if "same" not in moved.columns:
        return ctx
    stale = stale_fractions(moved, ctx).agg(F.median("stale_state_fraction").alias("m")).collect()[0].m
    return replace(ctx, stale_baseline=stale or 0.0, parts=ctx.parts | {"stale"})


def stale_fractions(moved: DataFrame, ctx: Context) -> DataFrame:
    """episode_index and stale_state_fraction of episodes of three frames and more with both streams."""
    stale = sure(F.col("same") & (F.col("speed") > 5 * ctx.moving))
    return moved.where("same is not null").groupBy("episode_index").agg(F.avg(stale.cast("double")).alias("stale_state_fraction"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")
