"""Video samples, decoded where PyAV is installed; everything else here works without it."""

from __future__ import annotations

import importlib.util
import os
from string import Formatter

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.config import Config
from framewright.dataset import Dataset
from framewright.operators.context import Context

SAMPLES = "episode_index bigint, camera string, i int, t double, mean double, std double, thumb array<double>, failed boolean"
THUMB = 32


def available() -> bool:
    return importlib.util.find_spec("av") is not None


def thumbnail(gray) -> list[float]:
    """Block means of an image (rows of numbers from 0 to 1), THUMB x THUMB at most."""
    import numpy as np

    g = np.asarray(gray, dtype=np.float64)
    rows, cols = (np.linspace(0, n, min(n, THUMB) + 1).astype(int) for n in g.shape)
    return [float(g[a:b, c:d].mean()) for a, b in zip(rows, rows[1:]) for c, d in zip(cols, cols[1:])]


def decode(path: str, most: int, start: float | None = None, end: float | None = None):
    """Up to `most` evenly spaced samples (t, mean, std, thumb) of a file or of a span of it; None if it can't be decoded."""
    try:
        import av
        import numpy as np

        with av.open(path) as box:
            stream = box.streams.video[0]
            low = start or 0.0
            high = end if end is not None else float(stream.duration * stream.time_base)
            out = []
            for t in np.linspace(low, high, most, endpoint=False):
                box.seek(int(t / stream.time_base), stream=stream)
                for frame in box.decode(stream):
                    if frame.time is not None and frame.time >= t - 1e-6:
                        g = frame.to_ndarray(format="gray") / 255.0
                        out.append((float(t - low), float(g.mean()), float(g.std()), thumbnail(g)))
                        break
            return out or None
    except Exception:  # noqa: BLE001 - whatever a broken file raises, it is broken
        return None


def decoded(clips: DataFrame, cfg: Config) -> DataFrame:
    """SAMPLES of clips (episode_index, camera, path, start, end); a row with failed for those that can't be decoded. Files that aren't there are passed over."""
    most = cfg.video_decode_max_samples

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for c in pdf.itertuples(index=False):
                if not os.path.exists(c.path):
                    continue
                none = lambda x: None if x is None or x != x else x
                got = decode(c.path, most, none(c.start), none(c.end))
                rows += [(c.episode_index, c.camera, i, *s, False) for i, s in enumerate(got)] if got else [(c.episode_index, c.camera, 0, None, None, None, None, True)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SAMPLES.split(", ")])

    return clips.mapInPandas(run, SAMPLES)


def clip_paths(ds: Dataset) -> DataFrame:
    """episode_index, camera, path, start, end of every camera's file, where the dataset is a local folder with a path template; without those whose place in it isn't known."""
    root, template = ds.video_root, ds.video_path or ""
    cams = F.explode(F.array(*[F.lit(c) for c in ds.camera_names]))
    e = ds.episodes.select("episode_index", cams.alias("camera"), "spans")
    span = F.col("spans")[F.col("camera")]
    known = {"episode_index": F.col("episode_index"), "episode_chunk": F.floor(F.col("episode_index") / ds.chunks_size), "chunk_index": span["chunk"], "file_index": span["file"], "video_key": F.col("camera")}
    parts = [F.lit(f"{root}/")]
    for text, name, spec, _ in Formatter().parse(template):
        parts += [F.lit(text)]
        if name is not None:
            parts += [F.format_string(f"%{spec or ''}", known[name].cast("bigint")) if spec else known[name].cast("string")]
    return e.select("episode_index", "camera", F.concat(*parts).alias("path"), span["start"].alias("start"), span["end"].alias("end")).where("path is not null")


def _longest(df: DataFrame, on) -> DataFrame:
    """episode_index, camera, i0, i1 (exclusive): the first of the longest runs of samples for which `on` holds."""
    part = Window.partitionBy("episode_index", "camera").orderBy("i")
    marked = df.where(on).withColumn("_g", F.col("i") - F.row_number().over(part))
    runs = marked.groupBy("episode_index", "camera", "_g").agg(F.min("i").alias("i0"), (F.max("i") + 1).alias("i1"))
    best = F.max(F.struct((F.col("i1") - F.col("i0")).alias("n"), (-F.col("i0")).alias("m"), "i1")).alias("b")
    return runs.groupBy("episode_index", "camera").agg(best).select("episode_index", "camera", (-F.col("b.m")).alias("i0"), F.col("b.i1").alias("i1"))


def dark_runs(samples: DataFrame, cfg: Config) -> DataFrame:
    """episode_index, camera, i0, i1: near-black stretches of video_dark_run_min_frac of the samples and more, but not of all of them."""
    n = samples.groupBy("episode_index", "camera").agg(F.count("*").alias("n"))
    dark = (F.col("mean") <= cfg.camera_dark_mean_max) & (F.col("std") <= cfg.camera_dark_std_max)
    r = _longest(samples, dark).join(n, ["episode_index", "camera"])
    size = F.col("i1") - F.col("i0")
    return r.where((size < F.col("n")) & (size >= cfg.video_dark_run_min_frac * F.col("n"))).drop("n")


def frozen_runs(samples: DataFrame, cfg: Config) -> DataFrame:
    """episode_index, camera, i0, i1: stretches in which each thumbnail is like the one before, of video_dark_run_min_frac of the samples and more; the whole clip counts."""
    w = Window.partitionBy("episode_index", "camera").orderBy("i")
    n = samples.groupBy("episode_index", "camera").agg(F.count("*").alias("n"))
    apart = F.array_max(F.zip_with("thumb", F.lag("thumb").over(w), lambda a, b: F.abs(a - b)))
    s = samples.withColumn("apart", apart)
    r = _longest(s, F.col("apart") <= cfg.video_freeze_max_abs_diff).withColumn("i0", F.col("i0") - 1).join(n, ["episode_index", "camera"])
    return r.where(F.col("i1") - F.col("i0") >= F.greatest(F.lit(2), cfg.video_dark_run_min_frac * F.col("n"))).drop("n")


def moved(ds: Dataset, ctx: Context, spans: DataFrame) -> DataFrame:
    """The spans (episode_index, camera, start, end in seconds) during all of which the action moves."""
    from framewright.operators.context import speeds

    low, high = F.floor(F.col("start") * ds.fps), F.floor(F.col("end") * ds.fps)
    s = spans.join(speeds(ds, ctx), "episode_index").where((F.col("t") >= low) & (F.col("t") <= high))
    return s.groupBy("episode_index", "camera", "start", "end").agg(F.min("speed").alias("least")).where(F.col("least") > 5 * ctx.moving).drop("least")


def freeze_flags(ds: Dataset, ctx: Context, cfg: Config, samples: DataFrame) -> DataFrame:
    """Flags of cameras that fail to decode, go dark in between, or freeze while the robot moves; cameras known to be dead are left out."""
    from framewright.operators.checks import ORD, flag, union

    dead = ds.episodes.where("cameras is not null").select("episode_index", F.explode("cameras").alias("camera", "v")).where(F.col("v.mean") <= cfg.camera_dark_mean_max).select("episode_index", "camera")
    s = samples.join(dead, ["episode_index", "camera"], "left_anti")
    bad, good, o = s.where("failed"), s.where("not failed"), ORD["video_freeze"]
    times = good.select("episode_index", "camera", "i", "t")
    timed = lambda r: r.join(times.select("episode_index", "camera", F.col("i").alias("i0"), F.col("t").alias("start")), ["episode_index", "camera", "i0"]).join(times.select("episode_index", "camera", (F.col("i") + 1).alias("i1"), F.col("t").alias("end")), ["episode_index", "camera", "i1"])
    dark = timed(dark_runs(good, cfg))
    frozen = timed(frozen_runs(good, cfg)).join(dark.select("episode_index", "camera"), ["episode_index", "camera"], "left_anti")
    still = moved(ds, ctx, frozen.select("episode_index", "camera", "start", "end")) if ctx.scale is not None else frozen.limit(0)
    return union(
        flag(bad, F.lit(True), "video_freeze", "error", F.format_string("%s: video file failed to decode", "camera"), 40, o),
        flag(dark, F.lit(True), "video_freeze", "warn", F.format_string("%s: goes near-black from ~%.1fs to ~%.1fs mid-episode (disconnected or occluded camera?)", "camera", "start", "end"), 20, o),
        flag(still, F.lit(True), "video_freeze", "error", F.format_string("%s: frozen (no change) from ~%.1fs to ~%.1fs while the robot kept moving (dropped frames or a stalled feed?)", "camera", "start", "end"), 35, o),
    )


def check(ds: Dataset, ctx: Context, cfg: Config) -> DataFrame:
    """The opt-in check of a local dataset's videos; for plans.score.evaluate(video=...)."""
    if not available():
        raise RuntimeError("decoding videos needs the package av")
    return freeze_flags(ds, ctx, cfg, decoded(clip_paths(ds), cfg))


def binary_files(spark: SparkSession, root: str) -> DataFrame:
    """All video files of a folder with their sizes, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.mp4").load(root).select("path", "length")
