"""One query for each family of operators over the relational tables, and the same in SQL.

Line items are the frames of their supplier (sources.tables.suppliers) at 10 frames a second. The thresholds in
CFG are such that the checks find something in these tables.
"""

from __future__ import annotations

import math


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.config import Config
from framewright.functions.scalars import MAD, finite, numbers, sure, wrap
from framewright.operators import checks as C
from framewright.operators import context as X
from framewright.operators import duplicates as D
from framewright.operators import signals as S
from framewright.plans import merge
from framewright.plans.score import evaluate, score_column
from framewright.sources import tables as T
from framewright.tables import write_and_read

FPS = 10.0
CFG = Config().override(idle_fraction_of_p75=0.8, spike_factor=0.95, max_idle_fraction=0.3, min_trimmable_idle_s=0.2, trim_pad_s=0.1, max_pause_s=0.5, stale_state_max_fraction=-0.01, sync_lag_outlier_frames=1.0, outlier_z=1.0, jerk_z=-1.0, min_ldlj_diff=0.01, min_relative_length_diff=0.01, gripper_chatter_window_s=0.3, gripper_chatter_min_toggles=2, sync_min_peak_corr=0.2, dedupe_z=1.5)
R = 6

_kept: dict[tuple, X.Context] = {}


def _supp(spark: SparkSession, sf_dir: str, *parts: str):
    """Dataset and context of the suppliers, with the parts asked for or all; the context, some numbers, is kept for a session and folder."""
    ds = T.suppliers(spark, sf_dir, FPS)
    key = (spark.sparkContext.applicationId, sf_dir)
    _kept[key] = X.build(ds, CFG, parts=parts or X.PARTS, known=_kept.get(key))
    return ds, _kept[key]


def _r(c, n: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def _long(*cols: str):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


# ---- SQL of the frames and of their context -----------------------------------------------------------------

_F = """f AS (SELECT l_suppkey AS ep, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
  [l_quantity, l_extendedprice, l_discount, l_tax] AS a FROM lineitem),
fs AS (SELECT ep, pos, a, coalesce(CASE ep % 4 WHEN 0 THEN a WHEN 1 THEN lag(a, 1) OVER w WHEN 2 THEN lag(a, 2) OVER w ELSE lag(a, 3) OVER w END, first_value(a) OVER w) AS s FROM f WINDOW w AS (PARTITION BY ep ORDER BY pos)),
d AS (SELECT ep, pos, unnest([0, 1, 2, 3]) AS dim, unnest(a) AS v FROM f),
x AS (SELECT *, v - lag(v) OVER (PARTITION BY ep, dim ORDER BY pos) AS dv FROM d)"""
_SC = _F + """,
st AS (SELECT dim, quantile_cont(v, 0.25e0) AS q25, quantile_cont(v, 0.75e0) AS q75, stddev_pop(v) AS sd, min(v) AS lo, max(v) AS hi, quantile_cont(abs(dv), 0.99e0) AS p99 FROM x GROUP BY dim),
sc AS (SELECT *, p99 / scale AS step_p99 FROM (SELECT *, CASE WHEN (q75 - q25) / 1.349e0 > 1e-9 THEN (q75 - q25) / 1.349e0 WHEN sd > 1e-9 THEN sd END AS scale FROM st))"""
_SP = _SC + f""",
sp AS (SELECT ep, pos - 1 AS t, sqrt(sum((dv / scale * {FPS}e0) * (dv / scale * {FPS}e0)) / count(*)) AS speed FROM x JOIN sc USING (dim) WHERE dv IS NOT NULL GROUP BY ep, pos),
ctx AS (SELECT {CFG.idle_fraction_of_p75}e0 * quantile_cont(speed, 0.75e0) AS idle_speed FROM sp),
sm AS (SELECT ep, t, CASE WHEN count(*) OVER (PARTITION BY ep) >= 2 THEN sum(speed) OVER (PARTITION BY ep ORDER BY t ROWS BETWEEN 1 PRECEDING AND 0 FOLLOWING) / 2e0 ELSE speed END AS speed FROM sp),
id AS (SELECT ep, t, sm.speed < greatest(idle_speed, 1e-9) AS idle FROM sm, ctx),
ends AS (SELECT ep, count(*) AS n, min(CASE WHEN NOT idle THEN t END) AS first_t, max(CASE WHEN NOT idle THEN t END) AS last_t, avg(CAST(idle AS DOUBLE)) AS part FROM id GROUP BY ep),
ir AS (SELECT ep, min(t) AS b, max(t) + 1 AS e FROM (SELECT ep, t, t - row_number() OVER (PARTITION BY ep ORDER BY t) AS g FROM id WHERE idle) GROUP BY ep, g),
pz AS (SELECT ir.ep, max(e - b) AS pause FROM ir JOIN ends USING (ep) WHERE b > first_t AND b < last_t GROUP BY ir.ep),
im AS (SELECT ep, n + 1 AS length, first_t AS lead, n - 1 - last_t AS trail, coalesce(pause, 0) AS pause, part FROM ends LEFT JOIN pz USING (ep)),
tr AS (SELECT ep, greatest(0, lead - 1) AS s, least(length, length - trail + 1) AS e FROM im WHERE (lead + trail) / {FPS}e0 >= {CFG.min_trimmable_idle_s}e0)"""


def _sql(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


# ---- context ------------------------------------------------------------------------------------------------


@query(_sql(_SC, f"SELECT CAST(dim AS BIGINT) AS dim, round(q25, {R}) AS q25, round(q75, {R}) AS q75, round(sd, {R}) AS std, round(scale, {R}) AS scale FROM sc"))
def scale_per_dim(spark, sf_dir):
    return X.dim_stats(T.suppliers(spark, sf_dir).frames, names=("q25", "q75")).select(*_long("dim"), _r("q25").alias("q25"), _r("q75").alias("q75"), _r("std").alias("std"), _r(X.scale_column()).alias("scale"))


_ANGLES = [float(f'{x:.17f}') for x in (math.pi / 25, math.pi / 60000, 60.0, 40.0)]


@query(_sql(_F, f"""SELECT CAST(dim AS BIGINT) AS dim, round(lo, {R}) AS lo, round(hi, {R}) AS hi, hi <= {math.pi + 0.05!r}e0 AND lo >= {-math.pi - 0.05!r}e0 AND hi >= {math.pi - 0.3!r}e0 AND lo <= {-math.pi + 0.3!r}e0 AS angular
FROM (SELECT dim, min(v * m - {math.pi!r}e0) AS lo, max(v * m - {math.pi!r}e0) AS hi FROM d JOIN (SELECT unnest([0, 1, 2, 3]) AS dim, unnest([{', '.join(f'{a:.17f}e0' for a in _ANGLES)}]) AS m) USING (dim) GROUP BY dim)"""))
def angular_dims(spark, sf_dir):
    frames = T.suppliers(spark, sf_dir).frames.withColumn("action", F.zip_with("action", numbers(_ANGLES), lambda a, m: a * m - F.lit(math.pi)))
    return X.dim_stats(frames, names=()).select(*_long("dim"), _r("lo").alias("lo"), _r("hi").alias("hi"), X.angular_column(CFG).alias("angular"))


@query(_sql(_SC, f"SELECT CAST(dim AS BIGINT) AS dim, round(p99, {R}) AS p99, round(step_p99, {R}) AS step_p99 FROM sc"))
def step_p99(spark, sf_dir):
    return X.dim_stats(T.suppliers(spark, sf_dir).frames, names=("q25", "q75", "p99")).select(*_long("dim"), _r("p99").alias("p99"), _r(F.col("p99") / X.scale_column()).alias("step_p99"))


@query(_sql(_SP, f"SELECT round(idle_speed, {R}) AS idle_speed FROM ctx"))
def idle_speed(spark, sf_dir):
    _, ctx = _supp(spark, sf_dir, "idle")
    idle = None if ctx.scale is None else ctx.idle_speed
    return spark.createDataFrame([(idle,)], "idle_speed double").select(_r("idle_speed").alias("idle_speed"))


_LO = lambda c: f"""l{c} AS (SELECT dim, ln({c}) AS x FROM m), c{c} AS (SELECT median(x) AS mid FROM l{c}), s{c} AS (SELECT {MAD}e0 * median(abs(x - mid)) AS mad FROM l{c}, c{c}),
z{c} AS (SELECT dim, CASE WHEN mad >= 1e-9 AND (SELECT count(*) FROM m) >= 5 THEN (x - mid) / mad ELSE 0 END AS z FROM l{c}, c{c}, s{c})"""  # noqa: E731


@query(f"""WITH m AS (SELECT l_linenumber AS dim, exp(stddev_pop(l_extendedprice) / 20000e0 * (1 + CASE WHEN l_linenumber = 7 THEN 9 ELSE 0 END)) AS p,
exp(-stddev_pop(l_extendedprice) / 20000e0 * (1 + CASE WHEN l_linenumber = 2 THEN 9 ELSE 0 END)) AS w FROM lineitem GROUP BY 1),
{_LO("p")}, {_LO("w")}
SELECT CAST(dim AS BIGINT) AS dim, CASE WHEN abs(zp.z) <= 4 AND zw.z >= -4 AND dim <> 4 THEN round(p, {R}) END AS usable_step FROM m JOIN zp USING (dim) JOIN zw USING (dim)""")
def dim_outliers(spark, sf_dir):
    """Line numbers as dimensions: 7 has steps far from the others', 2 a scale far below them, 4 is a gripper."""
    by = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("dim")).agg((F.stddev_pop("l_extendedprice") / F.lit(20000.0)).alias("x"))
    at = lambda d: 1 + F.when(F.col("dim") == d, 9).otherwise(0)
    rows = by.select(*_long("dim"), F.exp(F.col("x") * at(7)).alias("p"), F.exp(-F.col("x") * at(2)).alias("w")).orderBy("dim").collect()  # seven
    grippers = [i for i, r in enumerate(rows) if r.dim == 4]
    usable = X.usable_steps([r.p for r in rows], [r.w for r in rows], grippers, Config().smoothness_dim_outlier_z)
    out = spark.createDataFrame([(r.dim, u) for r, u in zip(rows, usable, strict=True)], "dim bigint, step double")
    return out.select("dim", _r("step").alias("usable_step"))


@query(_sql(_SP, f"""SELECT episode_index, round(stale, {R}) AS stale_state_fraction, round(base, {R}) AS baseline, CASE WHEN stale - base > {CFG.stale_state_max_fraction}e0 THEN round(least(30e0, 100 * (stale - base - {CFG.stale_state_max_fraction}e0) + 10), 4) ELSE 0e0 END AS penalty FROM (SELECT ep AS episode_index, stale, median(stale) OVER () AS base FROM (
SELECT g.ep, avg(CAST(same AND sp.speed > greatest(idle_speed, 1e-9) * 5e-1 AS DOUBLE)) AS stale FROM (SELECT ep, pos - 1 AS t, s = lag(s) OVER (PARTITION BY ep ORDER BY pos) AS same FROM (SELECT ep, pos, [floor(y[1] / 25e0), floor(y[3] * 20e0)] AS s FROM (SELECT ep, pos, a AS y FROM f))) g JOIN sp ON sp.ep = g.ep AND sp.t = g.t, ctx GROUP BY g.ep))"""))
def stale_check(spark, sf_dir):
    """States coarse enough to repeat, and a tenth of the usual speed limit."""
    from dataclasses import replace

    ds, ctx = _supp(spark, sf_dir, "scale")
    frames = ds.frames.withColumn("state", F.array(F.floor(F.get("action", F.lit(0)) / 25.0).cast("double"), F.floor(F.get("action", F.lit(2)) * 20.0).cast("double")))
    ds = ds.with_frames(frames)
    ctx = replace(ctx, parts=ctx.parts - {"idle", "stale"})
    ctx = X.build(ds, CFG.override(idle_fraction_of_p75=CFG.idle_fraction_of_p75 / 10), parts=("idle", "stale"), known=ctx)
    m, flags = C.stale_state(ds, ctx, CFG)
    m = m.join(flags.select("episode_index", "penalty"), "episode_index", "left")
    return m.select("episode_index", _r("stale_state_fraction").alias("stale_state_fraction"), F.round(F.lit(ctx.stale_baseline), R).alias("baseline"), F.coalesce(_r("penalty", 4), F.lit(0.0)).alias("penalty"))


# ---- timing, metadata, integrity, spans, cameras ------------------------------------------------------------

_GAP = 26446.0


@query(f"""WITH u AS (SELECT user_id AS ep, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events),
g AS (SELECT ep, t - lag(t) OVER (PARTITION BY ep ORDER BY pos) AS dt FROM u),
m AS (SELECT ep, count(*) AS n, sum(CASE WHEN dt > 1.5e0 * {_GAP}e0 THEN round_even(dt / {_GAP}e0, 0) - 1 ELSE 0 END) AS dropped, max(dt) AS gap, count(*) FILTER (dt <= 0) AS back FROM g GROUP BY ep HAVING count(*) >= 2)
SELECT ep AS episode_index, CAST(dropped AS BIGINT) AS dropped_frames, round(dropped / (n + dropped), {R}) AS dropped_fraction, round(gap, 3) AS max_gap_s, back AS non_monotonic_steps,
  round(CASE WHEN back > 0 THEN 30e0 ELSE 0 END + CASE WHEN dropped > 0 THEN least(40e0, 300 * dropped / (n + dropped) + 5) ELSE 0 END, {R}) AS penalty FROM m""")
def timing_check(spark, sf_dir):
    m, flags = C.timing(T.users(spark, sf_dir, 1 / _GAP), None, CFG)
    p = flags.groupBy("episode_index").agg(F.sum("penalty").alias("p"))
    return m.join(p, "episode_index", "left").select("episode_index", *_long("dropped_frames"), _r("dropped_fraction").alias("dropped_fraction"), _r("max_gap_s", 3).alias("max_gap_s"), *_long("non_monotonic_steps"), _r(F.coalesce("p", F.lit(0.0))).alias("penalty"))


def _turns(spark, sf_dir):
    """Turns of conversations as frames, a second each, with every fifth taken out; every tenth conversation is declared a turn longer."""
    f = T.conversations(spark, sf_dir).where("frame_index % 5 <> 3")
    f = f.withColumn("pos", F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1).withColumn("timestamp", F.col("pos").cast("double"))
    episodes = f.groupBy("episode_index").agg(F.count("*").alias("n")).select("episode_index", (F.col("n") + F.when(F.col("episode_index") % 10 == 0, 1).otherwise(0)).alias("meta_length"))
    return T.Dataset(f, episodes, 1.0)


@query("""WITH c AS (SELECT conv_id AS ep, turn FROM conversations WHERE turn % 5 <> 3), g AS (SELECT ep, turn - lag(turn) OVER (PARTITION BY ep ORDER BY turn) AS step FROM c),
m AS (SELECT ep, CAST(coalesce(sum(greatest(step - 1, 0)), 0) AS BIGINT) AS missing FROM g GROUP BY ep HAVING count(*) >= 2)
SELECT ep AS episode_index, missing AS frame_index_missing, CASE WHEN missing > 0 THEN 10e0 ELSE 0e0 END AS penalty FROM m""")
def frame_index_gaps(spark, sf_dir):
    m, flags = C.timing(_turns(spark, sf_dir), None, Config())
    m = m.join(flags.select("episode_index", "penalty"), "episode_index", "left")
    return m.select("episode_index", *_long("frame_index_missing"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"))


@query("""SELECT conv_id AS episode_index, 'metadata says ' || (count(*) + 1) || ' frames, data has ' || count(*) AS message, 20e0 AS penalty
FROM conversations WHERE turn % 5 <> 3 AND conv_id % 10 = 0 GROUP BY 1""")
def metadata_check(spark, sf_dir):
    """Declared and counted lengths."""
    _, flags = C.metadata(_turns(spark, sf_dir), None, Config())
    return flags.select("episode_index", "message", "penalty")


@query(_sql(_F, "SELECT ep AS episode_index, count(*) AS bad_frames, 60e0 AS penalty FROM f WHERE a[1] = 50 OR a[4] = 0 GROUP BY ep"))
def integrity_check(spark, sf_dir):
    """Quantities of 50 become NaN and taxes of 0 infinite."""
    ds = T.suppliers(spark, sf_dir)
    q, t = F.get("action", F.lit(0)), F.get("action", F.lit(3))
    broken = F.array(F.when(q == 50, F.lit(float("nan"))).otherwise(q), F.when(t == 0, F.lit(float("inf"))).otherwise(t))
    f = ds.frames.withColumn("action", broken).withColumn("state", F.lit(None).cast("array<double>"))
    _, flags = C.integrity(ds.with_frames(f), None, CFG)
    n = f.groupBy("episode_index").agg(F.count_if(F.exists("action", lambda x: ~finite(x))).alias("bad_frames"))
    return flags.join(n, "episode_index").select("episode_index", "bad_frames", "penalty")


@query(f"""WITH e AS (SELECT o_custkey AS ep, count(*) AS length, sum(CASE WHEN o_orderpriority LIKE '1%' THEN 2 ELSE 1 END) AS frames FROM orders GROUP BY 1)
SELECT ep AS episode_index, round(length / {FPS}e0, {R}) AS data_s, round(frames / {FPS}e0, {R}) AS span_s, 20e0 AS penalty FROM e WHERE abs(frames / {FPS}e0 - length / {FPS}e0) > 3.3e-1""")
def span_check(spark, sf_dir):
    """Spans from orders, urgent ones counted twice, against the number of orders; tolerance 3.3 frames."""
    e = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("episode_index")).agg(F.count("*").alias("length"), F.sum(F.when(F.col("o_orderpriority").startswith("1"), 2).otherwise(1)).alias("frames"))
    end = F.col("frames") / F.lit(FPS)
    spans = F.map_from_arrays(F.array(F.lit("cam")), F.array(F.struct(F.lit(0.0).alias("start"), end.alias("end"))))
    ds = T.Dataset(e.select("episode_index", F.explode(F.sequence(F.lit(1), F.col("length").cast("int"))).alias("pos")), e.select("episode_index", spans.alias("spans")), FPS)
    _, flags = C.video_sync(ds, None, CFG.override(gap_factor=3.3))
    return flags.join(e, "episode_index").select("episode_index", _r(F.col("length") / F.lit(FPS)).alias("data_s"), _r(end).alias("span_s"), "penalty")


@query("""SELECT l_orderkey AS episode_index, count(*) AS camera_dead_count, least(50e0, 25e0 * count(*)) AS penalty FROM (SELECT l_orderkey, l_linenumber, min(l_tax) AS m, min(l_discount) AS s FROM lineitem GROUP BY 1, 2) WHERE m <= 0.03e0 AND s <= 0.02e0 GROUP BY 1""")
def camera_check(spark, sf_dir):
    """Lines of an order as its cameras, tax as mean and discount as deviation."""
    li = T.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_tax").alias("mean"), F.min("l_discount").alias("std"))
    cams = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("cam"), F.col("l_linenumber").cast("string")), F.struct("mean", "std"))))
    ds = T.Dataset(li, li.groupBy(F.col("l_orderkey").alias("episode_index")).agg(cams.alias("cameras")), FPS)
    m, flags = C.camera(ds, None, CFG)
    return m.join(flags, "episode_index").select("episode_index", *_long("camera_dead_count"), "penalty")


# ---- motion -------------------------------------------------------------------------------------------------


@query(_sql(_SP, f"""SELECT ep AS episode_index, round(part, {R}) AS idle_fraction, round(lead / {FPS}e0, {R}) AS lead_idle_s, round(trail / {FPS}e0, {R}) AS trail_idle_s, round(pause / {FPS}e0, {R}) AS longest_pause_s, CAST(tr.s AS BIGINT) AS trim_start, CAST(tr.e AS BIGINT) AS trim_end,
  round(greatest(0, 100 - CASE WHEN tr.s IS NOT NULL THEN least(10e0, 2 * (lead + trail) / {FPS}e0) ELSE 0 END - CASE WHEN part > {CFG.max_idle_fraction}e0 THEN (part - {CFG.max_idle_fraction}e0) * 50 ELSE 0 END - CASE WHEN pause / {FPS}e0 > {CFG.max_pause_s}e0 THEN 5 ELSE 0 END), {R}) AS score FROM im LEFT JOIN tr USING (ep)"""))
def idle_check(spark, sf_dir):
    """The flagship: from scales to speeds to idle stretches, trims and a score."""
    ds, ctx = _supp(spark, sf_dir, "idle")
    m, flags = C.idle(ds, ctx, CFG)
    p = flags.groupBy("episode_index").agg(F.sum("penalty").alias("p"))
    return m.join(p, "episode_index", "left").select("episode_index", *[_r(c).alias(c) for c in ("idle_fraction", "lead_idle_s", "trail_idle_s", "longest_pause_s")], "trim_start", "trim_end", _r(score_column(F.col("p"))).alias("score"))


@query(_sql(_SP, "SELECT ep AS episode_index, CAST(b AS BIGINT) AS run_begin, CAST(e AS BIGINT) AS run_end FROM ir"))
def idle_runs(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "idle")
    return S.runs(S.idling(ds, ctx, CFG), "idle", "t").select("episode_index", F.col("begin").cast("bigint").alias("run_begin"), F.col("end").cast("bigint").alias("run_end"))


@query(_sql(_SP, f"SELECT f.ep AS episode_index, count(*) AS frames, round(sum(a[1]), 2) AS quantity FROM f LEFT JOIN tr USING (ep) WHERE s IS NULL OR (pos >= s AND pos < e) GROUP BY 1"))
def trim_filter(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "idle")
    trims = C.idle(ds, ctx, CFG)[0].where("trim_start is not null").select("episode_index", "trim_start", "trim_end")
    f = ds.frames.join(trims, "episode_index", "left").where("trim_start is null or (pos >= trim_start and pos < trim_end)")
    return f.groupBy("episode_index").agg(F.count("*").alias("frames"), _r(F.sum(F.get("action", F.lit(0))), 2).alias("quantity"))


_BIG = _SC + f""",
big AS (SELECT ep, pos - 1 AS t, x.dim, sign(dv) AS sg FROM x JOIN sc USING (dim) WHERE abs(dv / scale) > {CFG.spike_factor}e0 * step_p99 AND x.dim <> 3),
bl AS (SELECT *, lead(t) OVER w AS nt, lead(sg) OVER w AS ns FROM big WINDOW w AS (PARTITION BY ep, dim ORDER BY t)),
sk AS (SELECT DISTINCT ep, t FROM bl WHERE nt = t + 1 AND ns <> sg),
br AS (SELECT DISTINCT ep, unnest(range(t, CASE WHEN nt - t > 1 AND nt - t <= 11 AND ns = sg THEN nt ELSE t + 1 END)) AS t FROM bl),
lf AS (SELECT * FROM br WHERE (ep, t) NOT IN (SELECT (ep, t) FROM sk) AND (ep, t) NOT IN (SELECT (ep, t + 1) FROM sk)),
jm AS (SELECT ep, count(DISTINCT g) AS jumps FROM (SELECT ep, t - row_number() OVER (PARTITION BY ep ORDER BY t) AS g FROM lf) GROUP BY ep)"""


@query(_sql(_BIG, "SELECT ep AS episode_index, CAST(t AS BIGINT) AS t FROM sk"))
def spikes(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "steps")
    return S.spike_frames(S.big_steps(ds, ctx, CFG)).select("episode_index", *_long("t"))


@query(_sql(_BIG, "SELECT ep AS episode_index, coalesce(n, 0) AS spikes, coalesce(jumps, 0) AS jumps FROM (SELECT ep, count(*) AS n FROM sk GROUP BY ep) FULL JOIN jm USING (ep)"))
def bridged_jumps(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "steps")
    return S.spikes_and_jumps(ds, ctx, CFG).select("episode_index", *_long("spikes", "jumps"))


@query(_sql(_BIG, """SELECT ep AS episode_index, spikes, jumps, CASE WHEN spikes > 0 THEN least(25e0, 8e0 * spikes) ELSE 0e0 END + CASE WHEN jumps > 0 THEN least(20e0, 5e0 * jumps) ELSE 0e0 END AS penalty
FROM (SELECT n.ep, coalesce(k.n, 0) AS spikes, coalesce(jumps, 0) AS jumps FROM (SELECT ep FROM f GROUP BY ep HAVING count(*) >= 3) n LEFT JOIN (SELECT ep, count(*) AS n FROM sk GROUP BY ep) k USING (ep) LEFT JOIN jm USING (ep))"""))
def smoothness_check(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "steps")
    m, flags = C.abruptness(ds, ctx, CFG)
    p = flags.groupBy("episode_index").agg(F.sum("penalty").alias("penalty"))
    return m.join(p, "episode_index", "left").select("episode_index", *_long("spikes", "jumps"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"))


@query(_sql(_F, f"""SELECT ep AS episode_index, round(sum(abs(w)), 4) AS turned, round(max(abs(w)), {R}) AS most FROM (SELECT ep, y - {2 * math.pi!r}e0 * floor(y / {2 * math.pi!r}e0) - {math.pi!r}e0 AS w FROM (SELECT ep, (a[1] - lag(a[1]) OVER (PARTITION BY ep ORDER BY pos)) * {math.pi / 25!r}e0 + {math.pi!r}e0 AS y FROM f)) WHERE w IS NOT NULL GROUP BY 1"""))
def wrapped_diff(spark, sf_dir):
    """Quantities as angles: 50 is a full turn."""
    f = X.with_previous(T.suppliers(spark, sf_dir).frames).where("prev is not null")
    turn = F.abs(wrap((F.get("action", F.lit(0)) - F.get("prev", F.lit(0))) * F.lit(math.pi / 25)))
    return f.groupBy("episode_index").agg(_r(F.sum(turn), 4).alias("turned"), _r(F.max(turn)).alias("most"))


def _wrap_sql(y: str) -> str:
    return f"(({y}) + {math.pi!r}e0 - {2 * math.pi!r}e0 * floor((({y}) + {math.pi!r}e0) / {2 * math.pi!r}e0) - {math.pi!r}e0)"


@query(_sql(_F, f"""SELECT ep AS episode_index, count(*) AS large, count(*) FILTER (least(abs({_wrap_sql('da - db')}), abs({_wrap_sql('da + db')})) < 0.25e0 * greatest(abs({_wrap_sql('da')}), abs({_wrap_sql('db')}))) AS cancelled FROM (
SELECT ep, (a[1] - lag(a[1]) OVER w) * 0.11e0 AS da, (a[1] - lag(a[1]) OVER w) * 0.11e0 + (a[3] - lag(a[3]) OVER w) * 2.3e0 AS db FROM f WINDOW w AS (PARTITION BY ep ORDER BY pos)) WHERE abs({_wrap_sql('da')}) > 2e0 OR abs({_wrap_sql('db')}) > 2e0 GROUP BY 1"""))
def gimbal_pairs(spark, sf_dir):
    """Two axes that differ by the discount: large steps, and those of them that cancel out."""
    from dataclasses import replace

    ds = T.suppliers(spark, sf_dir)
    q, d = F.get("action", F.lit(0)) * 0.11, F.get("action", F.lit(2)) * 2.3
    ds = ds.with_frames(ds.frames.withColumn("action", F.array(q, q + d)))
    ctx = X.Context(FPS, [1.0, 1.0], [2.0, 2.0], angular=[True, True])
    cfg = CFG.override(spike_factor=1.0, angular_pair_cancel_frac=0.25)
    count = lambda c: S.steps(ds, c, cfg).where(F.exists("big", lambda b: b)).groupBy("episode_index").agg(F.count("*").alias("n"))
    both = count(ctx).withColumnRenamed("n", "large").join(count(replace(ctx, angular_pairs=[(0, 1)])), "episode_index", "left")
    return both.select("episode_index", "large", (F.col("large") - F.coalesce("n", F.lit(0))).alias("cancelled"))


_LD = _SC + f""",
j AS (SELECT ep, pos, dim, v / scale AS u FROM d JOIN sc USING (dim)),
jj AS (SELECT ep, pos, sum((d1 / {1 / FPS!r}e0) * (d1 / {1 / FPS!r}e0)) AS v2, sum((d3 / {(1 / FPS) ** 3!r}e0) * (d3 / {(1 / FPS) ** 3!r}e0)) AS j2 FROM (SELECT ep, pos, u - lag(u, 1) OVER w AS d1, (u - 3 * lag(u, 1) OVER w) + (3 * lag(u, 2) OVER w - lag(u, 3) OVER w) AS d3 FROM j WINDOW w AS (PARTITION BY ep, dim ORDER BY pos)) GROUP BY 1, 2),
lj AS (SELECT ep, -ln(power(count(*) * {1 / FPS!r}e0, 3) / max(v2) * (sum(j2) * {1 / FPS!r}e0) + 1e-12) AS ldlj FROM jj GROUP BY ep HAVING count(*) >= 10)"""


@query(_sql(_LD, f"SELECT ep AS episode_index, round(ldlj, {R}) AS ldlj FROM lj"))
def ldlj(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "scale")
    return S.jerkiness(ds, ctx).select("episode_index", _r("ldlj").alias("ldlj"))


# ---- streams against each other, grippers -------------------------------------------------------------------

_LG = _F + """,
v AS (SELECT ep, pos, unnest([0, 1, 2, 3]) AS dim, unnest(a) - unnest(pa) AS da, unnest(s) - unnest(ps) AS ds FROM (SELECT *, lag(a) OVER w AS pa, lag(s) OVER w AS ps FROM fs WINDOW w AS (PARTITION BY ep ORDER BY pos)) WHERE pa IS NOT NULL),
lg AS (SELECT *, unnest(range(-5, 6)) AS lag FROM v),
cr AS (SELECT l.ep, l.lag, l.dim, count(*) AS n, stddev_pop(l.da) AS sa, stddev_pop(r.ds) AS ss, covar_pop(l.da, r.ds) AS cv FROM lg l JOIN v r ON r.ep = l.ep AND r.dim = l.dim AND r.pos = l.pos + l.lag GROUP BY 1, 2, 3),
va AS (SELECT ep, dim FROM v GROUP BY 1, 2 HAVING stddev_pop(da) > 1e-9),
mc AS (SELECT ep, lag, avg(CASE WHEN n * sa * ss > 1e-9 THEN cv / (sa * ss) ELSE 0 END) AS corr FROM cr JOIN va USING (ep, dim) WHERE n >= 10 AND ss > 1e-9 GROUP BY 1, 2),
bl AS (SELECT ep, lag, corr FROM mc QUALIFY row_number() OVER (PARTITION BY ep ORDER BY corr DESC, lag) = 1)"""


@query(_sql(_LG, "SELECT ep AS episode_index, CAST(lag AS BIGINT) AS lag, round(corr, 5) AS corr FROM bl"))
def sync_best_lag(spark, sf_dir):
    ds = T.suppliers(spark, sf_dir, FPS)
    ctx = X.unscaled(ds)
    return S.best_lags(ds, ctx, CFG).select("episode_index", *_long("lag"), _r("corr", 5).alias("corr"))


@query(_sql(_LG, "SELECT count(*) AS episodes, round(CASE WHEN count(*) >= 5 THEN median(corr) END, 5) AS baseline FROM bl"))
def sync_baseline(spark, sf_dir):
    ds = T.suppliers(spark, sf_dir, FPS)
    ctx = X.unscaled(ds)
    return S.best_lags(ds, ctx, CFG).agg(F.count("corr").alias("episodes"), _r(F.when(F.count("corr") >= 5, F.median("corr")), 5).alias("baseline"))


_MIXED = _LG.replace("v AS (", "ms AS (SELECT ep, pos, a, CASE WHEN ep % 3 = 0 THEN list_reverse(s) ELSE s END AS s FROM fs),\nv AS (", 1).replace("FROM fs WINDOW", "FROM ms WINDOW")


@query(_sql(_MIXED, f"""SELECT ep AS episode_index, round(corr, 5) AS corr, CASE WHEN corr < {CFG.sync_min_peak_corr}e0 AND coalesce(base - corr > {CFG.sync_corr_min_drop}e0, true) THEN 10e0 ELSE 0e0 END AS penalty
FROM bl, (SELECT CASE WHEN count(*) >= 5 THEN median(corr) END AS base FROM bl)"""))
def sync_check(spark, sf_dir):
    """Every third supplier has its dimensions in reverse, so its streams don't follow each other."""
    ds = T.suppliers(spark, sf_dir, FPS)
    ctx = X.unscaled(ds)
    ds = ds.with_frames(ds.frames.withColumn("state", F.when(F.col("episode_index") % 3 == 0, F.reverse("state")).otherwise(F.col("state"))))
    m, flags = C.sync(ds, ctx, CFG)
    m = m.join(flags.select("episode_index", "penalty"), "episode_index", "left")
    return m.select("episode_index", _r("sync_peak_corr", 5).alias("corr"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"))


@query(_sql(_LG, f"""SELECT ep AS episode_index, CAST(lag AS BIGINT) AS lag, round(least(25e0, 5 * abs(lag - m)), {R}) AS penalty FROM bl, (SELECT median(lag) AS m, count(*) AS c FROM bl WHERE corr >= {CFG.sync_min_peak_corr}e0) WHERE corr >= {CFG.sync_min_peak_corr}e0 AND c >= 5 AND abs(lag - m) > {CFG.sync_lag_outlier_frames}e0"""))
def lag_outliers(spark, sf_dir):
    ds = T.suppliers(spark, sf_dir, FPS)
    ctx = X.unscaled(ds)
    m, _ = C.sync(ds, ctx, CFG)
    _, flags = C.lag_outliers(m, CFG)
    return flags.join(m, "episode_index").select("episode_index", F.col("sync_lag_frames").cast("bigint").alias("lag"), _r("penalty").alias("penalty"))


_HY = _F + """,
h0 AS (SELECT ep, pos, a[4] AS v, max(a[4]) OVER p AS hi, min(a[4]) OVER p AS lo FROM f WINDOW p AS (PARTITION BY ep)),
h1 AS (SELECT *, CASE WHEN v > (hi + lo) / 2 + 0.15e0 * (hi - lo) THEN true WHEN v < (hi + lo) / 2 - 0.15e0 * (hi - lo) THEN false WHEN row_number() OVER (PARTITION BY ep ORDER BY pos) = 1 THEN v > (hi + lo) / 2 END AS s FROM h0),
h2 AS (SELECT ep, pos, hi, lo, last_value(s IGNORE NULLS) OVER (PARTITION BY ep ORDER BY pos ROWS UNBOUNDED PRECEDING) AS o FROM h1),
eg AS (SELECT ep, pos, pos / 10e0 AS t, hi, lo FROM (SELECT *, lag(o) OVER (PARTITION BY ep ORDER BY pos) AS b FROM h2) WHERE b <> o)"""


@query(_sql(_HY, "SELECT ep AS episode_index, CAST(pos AS BIGINT) AS pos FROM eg"))
def hysteresis_toggles(spark, sf_dir):
    """Toggles of the tax as a gripper."""
    f = T.suppliers(spark, sf_dir).frames.select("episode_index", "pos", F.get("action", F.lit(3)).alias("v"))
    p = Window.partitionBy("episode_index")
    f = f.withColumn("hi", F.max("v").over(p)).withColumn("lo", F.min("v").over(p))
    f = S.hysteresis(f, "v", (F.col("hi") + F.col("lo")) / 2, 0.15 * (F.col("hi") - F.col("lo")))
    return f.withColumn("b", F.lag("open").over(p.orderBy("pos"))).where("b <> open").select("episode_index", *_long("pos"))


@query(_sql(_HY + ", c AS (SELECT ep, count(*) OVER (PARTITION BY ep ORDER BY t RANGE BETWEEN 0.3e0 PRECEDING AND CURRENT ROW) AS k FROM eg)", "SELECT ep AS episode_index, count(*) AS edges, max(k) AS most FROM c GROUP BY 1"))
def sliding_toggle_count(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "scale")
    return S.toggles(ds, ctx, CFG.override(gripper_active_frac=0.0)).select("episode_index", *_long("edges", "most"))


@query(_sql(_HY + ", st AS (SELECT (quantile_cont(a[4], 0.75e0) - quantile_cont(a[4], 0.25e0)) / 1.349e0 AS scale FROM f), c AS (SELECT ep, hi - lo AS span, count(*) OVER (PARTITION BY ep ORDER BY t RANGE BETWEEN 0.3e0 PRECEDING AND CURRENT ROW) AS k FROM eg)", f"SELECT ep AS episode_index, max(k) AS gripper_toggles_per_window, least(20e0, 3e0 * max(k)) AS penalty FROM c, st WHERE span >= 0.5e0 * scale GROUP BY 1 HAVING count(*) >= {CFG.gripper_chatter_min_toggles} AND max(k) >= {CFG.gripper_chatter_min_toggles}"))
def gripper_check(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "scale")
    m, flags = C.gripper_chatter(ds, ctx, CFG)
    return m.join(flags, "episode_index").select("episode_index", *_long("gripper_toggles_per_window"), "penalty")


# ---- relative checks ----------------------------------------------------------------------------------------


def _relative_sql(source: str) -> str:
    return f"""r AS ({source}), m AS (SELECT median(v) AS mid, count(*) AS c FROM r), k AS (SELECT median(abs(v - mid)) AS mad FROM r, m), z AS (SELECT ep, v, mid, CASE WHEN mad * {MAD}e0 < 1e-9 THEN 0 ELSE (v - mid) / (mad * {MAD}e0) END AS z FROM r, m, k WHERE c >= 5)"""


@query("WITH " + _relative_sql("SELECT o_custkey AS ep, count(*) / 10e0 AS v FROM orders GROUP BY 1") + f"""
SELECT ep AS episode_index, round(v, {R}) AS active_s, round(z, {R}) AS active_z, CASE WHEN abs(v - mid) > {CFG.min_relative_length_diff}e0 * mid AND z < -{CFG.outlier_z}e0 THEN 10e0 WHEN abs(v - mid) > {CFG.min_relative_length_diff}e0 * mid AND z > {CFG.outlier_z}e0 THEN 5e0 ELSE 0e0 END AS penalty FROM z""")
def length_outliers(spark, sf_dir):
    """Orders of a customer as its frames."""
    r = T.customers(spark, sf_dir).groupBy("episode_index").agg((F.count("*") / F.lit(FPS)).alias("duration_s"))
    m, flags = C.length_outliers(r, CFG)
    p = flags.groupBy("episode_index").agg(F.sum("penalty").alias("p"))
    return m.join(p, "episode_index", "left").select("episode_index", _r("active_s").alias("active_s"), _r("active_z").alias("active_z"), F.coalesce("p", F.lit(0.0)).alias("penalty"))


@query(_sql(_LD + ", " + _relative_sql("SELECT ep, ldlj AS v FROM lj"), f"SELECT ep AS episode_index, round(z, 4) AS ldlj_z, z < {CFG.jerk_z}e0 AND mid - v > {CFG.min_ldlj_diff}e0 AS flagged FROM z"))
def jerk_outliers(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "scale")
    m, flags = C.jerk_outliers(write_and_read(S.jerkiness(ds, ctx), "jerkiness"), CFG)  # read for two medians, the scores and the flags
    return m.join(flags.select("episode_index", F.lit(True).alias("flagged")), "episode_index", "left").select("episode_index", _r("ldlj_z", 4).alias("ldlj_z"), sure(F.col("flagged")).alias("flagged"))


# ---- duplicates ---------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS keep, count(*) AS members, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    """Documents as episodes of one frame, whose action is the text's code points."""
    d = T.table(spark, sf_dir, "documents")
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c).cast("double"))
    frames = d.select(F.col("doc_id").alias("episode_index"), F.lit(0).alias("pos"), codes.alias("action"), F.array(F.length("text").cast("double")).alias("state"))
    e = F.col("episodes")
    return D.exact_groups(frames).select(e[0].alias("keep"), F.size(e).cast("bigint").alias("members"), F.aggregate(e, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("id_sum"))


_RS = _SC + """,
ln AS (SELECT ep, count(*) AS n FROM f GROUP BY 1),
pt AS (SELECT ep, n, unnest(range(0, 50)) AS k FROM ln),
pq AS (SELECT *, k * (n - 1) / 49e0 AS y, least(CAST(floor(k * (n - 1) / 49e0) AS BIGINT), n - 2) AS lo FROM pt),
rs AS (SELECT p.ep, p.k, x.dim, x.v / scale + (y.v / scale - x.v / scale) * (p.y - p.lo) AS u FROM pq p JOIN d x ON x.ep = p.ep AND x.pos = p.lo JOIN d y ON y.ep = p.ep AND y.dim = x.dim AND y.pos = p.lo + 1 JOIN sc ON sc.dim = x.dim)"""


@query(_sql(_RS, f"SELECT ep AS episode_index, CAST(k AS BIGINT) AS k, round(sum(u), 5) AS total FROM rs GROUP BY 1, 2"))
def resample_50(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "scale")
    f = ds.frames.withColumn("action", F.zip_with("action", numbers(ctx.scale), lambda a, s: a / s))
    return S.resampled(f, 50).select("episode_index", *_long("k"), _r(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


_EM = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pr AS (SELECT x.id AS a, y.id AS b, sqrt(list_sum(list_transform(range(1, 65), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i]))) / 64e0) AS dist FROM e x JOIN e y ON x.id <> y.id)"""
_NN = _EM + ", nn AS (SELECT a AS id, min(dist) AS dist FROM pr GROUP BY 1), th AS (SELECT greatest(0, m - 1.5e0 * CASE WHEN mad < 1e-9 THEN greatest(m * 0.1e0, 1e-6) ELSE mad END) AS tau FROM (SELECT m, 1.4826e0 * (SELECT median(abs(dist - m)) FROM nn) AS mad FROM (SELECT median(dist) AS m FROM nn)))"


def _vectors(spark, sf_dir):
    return T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


@query(_sql(_NN, f"SELECT id AS episode_index, round(dist, 5) AS distance FROM nn"))
def nn_distance(spark, sf_dir):
    return D.nearest(_vectors(spark, sf_dir)).select(F.col("id").alias("episode_index"), _r("distance", 5).alias("distance"))


@query(_sql(_NN, "SELECT a, b, round(dist, 5) AS distance FROM pr, th WHERE a < b AND dist <= tau"))
def near_pairs(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return D.pairs_within(v, D.threshold(D.nearest(v), 1.5)).select("a", "b", _r("distance", 5).alias("distance"))


@query("WITH RECURSIVE " + _NN + """, lk AS (SELECT a, b FROM pr, th WHERE dist <= tau), cc(id, r) AS (SELECT a, a FROM lk UNION SELECT lk.b, cc.r FROM cc JOIN lk ON lk.a = cc.id), rt AS (SELECT id, min(r) AS root FROM cc GROUP BY 1)
SELECT root AS keep, count(*) AS members, CAST(sum(id) AS BIGINT) AS id_sum, round((SELECT max(dist) FROM pr JOIN rt p ON p.id = a JOIN rt q ON q.id = b WHERE p.root = g.root AND q.root = g.root), 4) AS max_distance FROM rt g GROUP BY root""")
def near_groups(spark, sf_dir):
    e = F.col("episodes")
    return D.near_groups(_vectors(spark, sf_dir), 1.5).select(e[0].alias("keep"), F.size(e).cast("bigint").alias("members"), F.aggregate(e, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("id_sum"), "max_distance")


# ---- flags, scores, reports ---------------------------------------------------------------------------------

_FL = """fl AS (SELECT l_suppkey AS ep, CASE WHEN l_returnflag = 'R' THEN 'idle' WHEN l_linestatus = 'O' THEN 'sync' ELSE 'timing' END AS chk, round(l_tax * 10, 1) AS penalty, l_quantity >= 45 AS picked FROM lineitem)"""


def _flags(spark, sf_dir):
    li = T.table(spark, sf_dir, "lineitem").where("l_quantity >= 45")
    check = F.when(F.col("l_returnflag") == "R", "idle").when(F.col("l_linestatus") == "O", "sync").otherwise("timing")
    return li.select(F.col("l_suppkey").alias("episode_index"), check.alias("check"), F.round(F.col("l_tax") * 10, 1).alias("penalty"))


def _scores(spark, sf_dir):
    p = _flags(spark, sf_dir).groupBy("episode_index").agg(F.sum("penalty").alias("p"))
    e = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("episode_index"))
    return e.join(p, "episode_index", "left").select("episode_index", score_column(F.col("p")).alias("score"))


_SCO = _FL + ", sco AS (SELECT s_suppkey AS ep, greatest(0e0, 100e0 - coalesce(sum(penalty) FILTER (picked), 0)) AS score FROM supplier LEFT JOIN fl ON ep = s_suppkey GROUP BY 1)"


@query(_sql(_SCO, "SELECT ep AS episode_index, round(score, 4) AS score FROM sco"))
def flag_union_score(spark, sf_dir):
    return _scores(spark, sf_dir).select("episode_index", _r("score", 4).alias("score"))


@query(_sql(_SCO, "SELECT round(avg(score), 2) AS mean_score, round(median(score), 2) AS median_score, count(*) FILTER (score < 70) AS below, count(*) AS episodes FROM sco"))
def report_summary(spark, sf_dir):
    from framewright.plans.report import summary

    return summary(_scores(spark, sf_dir), 70.0).select(F.round("mean", 2).alias("mean_score"), F.round("median", 2).alias("median_score"), "below", "episodes")


@query(_sql(_SCO, "SELECT ep AS episode_index, round(score, 4) AS score FROM sco ORDER BY score, ep LIMIT 10"))
def top_k_worst(spark, sf_dir):
    from framewright.plans.report import worst

    return worst(_scores(spark, sf_dir), 10).select("episode_index", _r("score", 4).alias("score"))


@query(_sql(_FL, "SELECT chk AS check_name, count(*) AS flags FROM fl WHERE picked AND penalty > 0 GROUP BY 1"))
def flag_counts(spark, sf_dir):
    from framewright.plans.report import counts

    return counts(_flags(spark, sf_dir)).select(F.col("check").alias("check_name"), F.col("count").alias("flags"))


# ---- loading and export -------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS episode_index, count(*) AS frames FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(*) > 1) GROUP BY 1")
def duplicate_index_quarantine(spark, sf_dir):
    """Orders with a first line more than once are declared more than once; all of their lines go."""
    from framewright.sources.episodic import quarantine

    li = T.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "episode_index")
    good, _ = quarantine(li, li.where("l_linenumber = 1"))
    return good.groupBy("episode_index").agg(F.count("*").alias("frames"))


@query("SELECT conv_id AS episode_index, count(*) AS frames FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 LIMIT 20) GROUP BY 1")
def episode_subset(spark, sf_dir):
    """The first 20 conversations, a limit that is the operator."""
    f = T.conversations(spark, sf_dir)
    return T.Dataset(f, f.select("episode_index").distinct(), 1.0).only(first=20).frames.groupBy("episode_index").agg(F.count("*").alias("frames"))


@query("SELECT s_suppkey AS episode_index, coalesce(CASE WHEN s_acctbal > 5000 THEN s_name END, n_name) AS task FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def task_join(spark, sf_dir):
    """A supplier's own task, or that of its nation as task index."""
    from framewright.sources.episodic import with_tasks

    s = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("episode_index"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("task"), F.col("s_nationkey").alias("task_index"))
    n = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("task_index"), F.col("n_name").alias("name"))
    return with_tasks(s, n).select("episode_index", "task")


@query("SELECT l_suppkey AS episode_index, count(*) AS frames, round(sum(l_quantity + l_tax + l_discount), 2) AS total, CAST(sum(4) AS BIGINT) AS width FROM lineitem GROUP BY 1")
def structured_concat(spark, sf_dir):
    """Two sub-columns of a stream as one."""
    from framewright.sources.episodic import concat_parts

    li = T.table(spark, sf_dir, "lineitem").select("l_suppkey", F.array("l_quantity", "l_tax").alias("action.a"), F.array(F.col("l_discount"), F.lit(0.0)).alias("action.b"))
    d = li.select(F.col("l_suppkey").alias("episode_index"), concat_parts(["action.a", "action.b"]).alias("action"))
    total = F.aggregate("action", F.lit(0.0), lambda s, x: s + x)
    return d.groupBy("episode_index").agg(F.count("*").alias("frames"), _r(F.sum(total), 2).alias("total"), F.sum(F.size("action")).cast("bigint").alias("width"))


@query("""WITH k AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS e FROM supplier WHERE s_suppkey % 3 <> 0),
n AS (SELECT e, count(*) AS c FROM lineitem JOIN k ON s_suppkey = l_suppkey GROUP BY 1), o AS (SELECT e, c, coalesce(sum(c) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n)
SELECT s_suppkey AS old_index, CAST(o.e AS BIGINT) AS episode_index, CAST(start AS BIGINT) AS from_index, CAST(start + c AS BIGINT) AS to_index FROM o JOIN k ON k.e = o.e""")
def reindex_export(spark, sf_dir):
    frames = T.suppliers(spark, sf_dir).frames
    keep = merge.renumber(T.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("old_index")))
    out = merge.offsets(merge.reindex(frames, keep))
    return out.join(keep, "episode_index").select("old_index", *_long("episode_index", "from_index", "to_index"))


@query(_sql(_F + """,
k AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS e FROM supplier WHERE s_suppkey % 3 <> 0),
r AS (SELECT e, pos, s_suppkey % 2 = 0 AS trimmed, unnest([true, false]) AS subtract FROM f JOIN k ON s_suppkey = ep),
t AS (SELECT *, row_number() OVER (PARTITION BY subtract, e ORDER BY pos) - 1 AS new FROM r WHERE NOT trimmed OR CASE WHEN subtract THEN 2 * pos ELSE pos END BETWEEN 5 AND 19)""",
f"""SELECT CAST(e AS BIGINT) AS episode_index, subtract, count(*) AS frames, CAST(sum(1000 * e + new) AS BIGINT) AS indexes,
CAST(sum(CASE WHEN NOT subtract THEN new WHEN trimmed THEN 2 * pos - 5 ELSE 2 * pos END) AS BIGINT) AS frame_indexes,
round(sum(pos / {FPS}e0 - CASE WHEN trimmed THEN 5 / {FPS}e0 ELSE 0 END), 4) AS seconds FROM t GROUP BY 1, 2"""))
def exported_frames(spark, sf_dir):
    """Frames as an export writes them: renumbered, with new offsets, every other episode trimmed, by both ways of counting."""
    from framewright.plans.export import frames_to_keep

    raw = T.suppliers(spark, sf_dir, FPS).frames.select("episode_index", (2 * F.col("frame_index")).alias("frame_index"), F.lit(0).cast("bigint").alias("index"), "timestamp", F.lit("one").alias("_file"), F.col("pos").alias("_row"))
    keep = merge.renumber(T.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("old_index")))
    plan = keep.select(F.col("old_index").alias("old"), F.col("episode_index").alias("episode"), F.lit(5).alias("start"), F.lit(20).alias("end"), (F.col("episode_index") * 1000).alias("offset"), (F.col("old_index") % 2 == 0).alias("trimmed"))
    out = [frames_to_keep(raw, plan, FPS, way).withColumn("subtract", F.lit(way)) for way in (True, False)]
    sums = [F.count("*").alias("frames"), F.sum("index").alias("indexes"), F.sum("frame_index").alias("frame_indexes"), F.round(F.sum("timestamp"), 4).alias("seconds")]
    return out[0].unionByName(out[1]).groupBy("episode_index", "subtract").agg(*sums)


@query(_sql(_F, f"SELECT CAST(dim AS BIGINT) AS dim, round(min(v), {R}) AS min, round(max(v), {R}) AS max, round(avg(v), {R}) AS mean, round(stddev_pop(v), {R}) AS std, count(*) AS count, round(quantile_cont(v, 0.1e0), {R}) AS q10, round(quantile_cont(v, 0.5e0), {R}) AS q50 FROM d GROUP BY 1"))
def column_stats(spark, sf_dir):
    s = merge.column_stats(T.suppliers(spark, sf_dir).frames, "action", (0.1, 0.5))
    return s.select(*_long("dim"), *[_r(c).alias(c) for c in ("min", "max", "mean", "std")], "count", _r("q10").alias("q10"), _r("q50").alias("q50"))


@query(_sql(_F + ", p AS (SELECT dim, ep, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.5e0) AS q FROM d GROUP BY 1, 2), g AS (SELECT dim, sum(n) AS t, sum(n * m) / sum(n) AS mm FROM p GROUP BY 1)", f"SELECT CAST(p.dim AS BIGINT) AS dim, CAST(max(t) AS BIGINT) AS count, round(max(mm), {R}) AS mean, round(sqrt(sum(n * (s * s + (m - mm) * (m - mm))) / max(t)), {R}) AS std, round(min(lo), {R}) AS min, round(max(hi), {R}) AS max, round(sum(n * q) / max(t), {R}) AS q50 FROM p JOIN g USING (dim) GROUP BY 1"))
def merge_stats(spark, sf_dir):
    per = merge.column_stats(T.suppliers(spark, sf_dir).frames, "action", (0.5,), by=("episode_index",))
    return merge.merge_stats(per, ["dim"], ["q50"]).select(*_long("dim"), "count", *[_r(c).alias(c) for c in ("mean", "std", "min", "max", "q50")])


@query(_sql(_SP, f"SELECT tr.ep AS episode_index, round(tr.ep + s / {FPS}e0, {R}) AS span_start, round(tr.ep + length / {FPS}e0 - (length - e) / {FPS}e0, {R}) AS span_end FROM tr JOIN im USING (ep)"))
def span_narrowing(spark, sf_dir):
    ds, ctx = _supp(spark, sf_dir, "idle")
    trims = C.idle(ds, ctx, CFG)[0].where("trim_start is not null").select("episode_index", "trim_start", "trim_end").join(C.lengths(ds), "episode_index")
    start, end = merge.narrowed(F.col("episode_index").cast("double"), F.col("episode_index") + F.col("length") / F.lit(FPS), "trim_start", "trim_end", "length", FPS)
    return trims.select("episode_index", _r(start).alias("span_start"), _r(end).alias("span_end"))


@query("SELECT c_custkey AS episode_index FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def dropped_set_difference(spark, sf_dir):
    """Customers that are present but not kept."""
    present = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode_index"))
    keep = T.table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("episode_index")).distinct()
    return present.join(keep, "episode_index", "left_anti").distinct()


@query(None)
def score_suppliers(spark, sf_dir):
    """Everything at once: all checks, duplicates and scores."""
    return evaluate(T.suppliers(spark, sf_dir, FPS), CFG).results.select("episode_index", "length", F.round("score", 4).alias("score"), F.size("flags").alias("n_flags"), "trim_start", "trim_end")


