"""Episodes that are the same, and episodes that are nearly the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.config import Config
from framewright.dataset import Dataset
from framewright.functions.scalars import MAD, TINY, finite, numbers
from framewright.operators import signals
from framewright.operators.context import Context
from framewright.tables import write_and_read

GROUPS = "episodes array<bigint>, kind string, max_distance double"
#: Vectors of a block in all-pairs searches.
BLOCK = 256


def fingerprints(frames: DataFrame) -> DataFrame:
    """episode_index and what its frames' numbers add up to: equal for equal episodes, in whatever partitions the frames lie.

    A hash of position, action and state for each frame, twice with other seeds, summed exactly. No episode is
    gathered in one place. Episodes without either stream are left out. -0.0 and 0.0 are equal.
    """
    f = frames.where("action is not null or state is not null")
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "pos", "action", "state").cast("decimal(20,0)"))
    return f.groupBy("episode_index").agg(F.count("*").alias("n"), h(1).alias("h1"), h(2).alias("h2"))


def exact_groups(frames: DataFrame) -> DataFrame:
    same = fingerprints(frames).groupBy("n", "h1", "h2").agg(F.sort_array(F.collect_list("episode_index")).alias("episodes")).where("size(episodes) > 1")
    return same.select("episodes", F.lit("exact").alias("kind"), F.lit(0.0).alias("max_distance"))


def motion_vectors(ds: Dataset, ctx: Context, cfg: Config, trims: DataFrame | None = None, leave_out: DataFrame | None = None) -> DataFrame:
    """id, v: an episode's trimmed and scaled action at dedupe_resample_len points. Without those that hold numbers that aren't finite, or fewer than 2 frames."""
    live = [i for i, s in enumerate(ctx.scale) if s is not None]
    f = ds.frames.where("action is not null")
    if leave_out is not None:
        f = f.join(leave_out, "episode_index", "left_anti")
    if trims is not None:
        f = f.join(trims, "episode_index", "left").where("trim_start is null or (pos >= trim_start and pos < trim_end)").withColumn("pos", (F.col("pos") - F.coalesce("trim_start", F.lit(0))).cast("int"))
    broken = f.where(F.exists("action", lambda x: ~finite(x))).select("episode_index").distinct()
    x = F.zip_with(F.array(*[F.get("action", F.lit(i)) for i in live]), numbers([ctx.scale[i] for i in live]), lambda a, s: a / s)
    f = f.join(broken, "episode_index", "left_anti").select("episode_index", "pos", x.alias("action"))
    r = signals.resampled(f, cfg.dedupe_resample_len)
    return r.groupBy("episode_index").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda p: p["v"])).alias("v")).withColumnRenamed("episode_index", "id")


def _blocks(vectors: DataFrame, n: int) -> DataFrame:
    """block, ids, vs: vectors packed by a hash of their id, about BLOCK each."""
    count = max(1, -(-n // BLOCK))
    return vectors.groupBy(F.pmod(F.xxhash64("id"), F.lit(count)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("m")).select("block", F.transform("m", lambda x: x["id"]).alias("ids"), F.transform("m", lambda x: x["v"]).alias("vs"))


def _block_pairs(vectors: DataFrame, n: int) -> DataFrame:
    """Each pair of blocks once: (n / BLOCK)^2 / 2 rows for exact distances of all vectors to all."""
    b = write_and_read(_blocks(vectors, n), "blocks")
    other = b.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("vs").alias("vs2"))
    return b.join(other, F.col("block") <= F.col("block2"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Root mean squared difference of every row of x and of y."""
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0.0) / max(1, x.shape[1]))


def _per_block_pair(batches):
    for batch in batches:
        for same, ids, vs, ids2, vs2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            d = _distances(np.array(vs, dtype=np.float64), np.array(vs2, dtype=np.float64))
            if same:
                np.fill_diagonal(d, np.inf)
            yield same, np.array(ids), np.array(ids2), d


def nearest(vectors: DataFrame) -> DataFrame:
    """id, distance: of each vector to its nearest other one, exactly. No row without another vector."""
    def run(batches):
        for same, ids, ids2, d in _per_block_pair(batches):
            for who, near in ((ids, d.min(axis=1)), *([] if same else [(ids2, d.min(axis=0))])):
                keep = np.isfinite(near)
                yield pa.RecordBatch.from_arrays([pa.array(who[keep], pa.int64()), pa.array(near[keep], pa.float64())], names=["id", "distance"])

    pairs = _block_pairs(vectors, vectors.count()).select((F.col("block") == F.col("block2")).alias("same"), "ids", "vs", "ids2", "vs2")
    return pairs.mapInArrow(run, "id bigint, distance double").groupBy("id").agg(F.min("distance").alias("distance"))


def pairs_within(vectors: DataFrame, limit: float) -> DataFrame:
    """a, b, distance of all pairs (a < b) no farther apart than the limit."""
    def run(batches):
        for same, ids, ids2, d in _per_block_pair(batches):
            i, j = np.nonzero(d <= limit)
            a, b = np.minimum(ids[i], ids2[j]), np.maximum(ids[i], ids2[j])
            keep = (ids[i] < ids2[j]) if same else np.ones(len(i), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64()), pa.array(d[i, j][keep], pa.float64())], names=["a", "b", "distance"])

    pairs = _block_pairs(vectors, vectors.count()).select((F.col("block") == F.col("block2")).alias("same"), "ids", "vs", "ids2", "vs2")
    return pairs.mapInArrow(run, "a bigint, b bigint, distance double")


def threshold(nearest_: DataFrame, z: float) -> float | None:
    """median - z * MAD of the nearest distances, not below 0; None with fewer than 5 vectors."""
    m = nearest_.agg(F.median("distance").alias("m"), F.count("*").alias("n")).collect()[0]
    if m.n < 5:
        return None
    mad = MAD * nearest_.agg(F.median(F.abs(F.col("distance") - m.m)).alias("d")).collect()[0].d
    if mad < TINY:
        mad = max(0.1 * m.m, 1e-6)
    return max(0.0, m.m - z * mad)


def connected(links: DataFrame) -> DataFrame:
    """id, root (least id of its component) for the ends of the links (a, b): least labels spread until none changes, each round written."""
    both = write_and_read(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = write_and_read(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots, both.b == roots.id).groupBy("a").agg(F.min("root").alias("near"))
        stepped = roots.join(near, roots.id == near.a, "left").select("id", "root", F.least("root", "near").alias("next"))
        stepped = write_and_read(stepped, "roots")
        roots = stepped.select("id", F.col("next").alias("root"))
        if not stepped.where("next < root").limit(1).count():
            return roots


def near_groups(vectors: DataFrame, z: float) -> DataFrame:
    """Groups of vectors linked by distances unusually small for this set. max_distance is the largest inside a group, linked or not."""
    spark = vectors.sparkSession
    limit = threshold(nearest(vectors), z)
    if limit is None:
        return spark.createDataFrame([], GROUPS)
    links = write_and_read(pairs_within(vectors, limit), "near-links")
    if not links.limit(1).count():
        return spark.createDataFrame([], GROUPS)
    roots = connected(links)
    inside = vectors.join(roots, "id")
    groups = inside.groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("episodes"))

    def widest(batches):
        for batch in batches:
            best: dict[int, float] = {}
            for root, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                d = float(_distances(np.array([x]), np.array([y]))[0, 0])
                best[root] = max(best.get(root, 0.0), d)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.float64())], names=["root", "d"])

    x = inside.select("root", F.col("id").alias("i"), F.col("v").alias("x"))
    y = inside.select("root", F.col("id").alias("j"), F.col("v").alias("y"))
    far = x.join(y, "root").where("i < j").select("root", "x", "y").mapInArrow(widest, "root bigint, d double").groupBy("root").agg(F.round(F.max("d"), 4).alias("max_distance"))
    return groups.join(far, "root").select("episodes", F.lit("near").alias("kind"), "max_distance")


def find(ds: Dataset, ctx: Context, cfg: Config, trims: DataFrame | None = None) -> DataFrame:
    """All groups: exact ones, and near ones among the episodes in none of them."""
    exact = write_and_read(exact_groups(ds.frames), "exact-groups")
    if ctx.scale is None or not any(s is not None for s in ctx.scale):
        return exact
    known = exact.select(F.explode("episodes").alias("episode_index"))
    vectors = write_and_read(motion_vectors(ds, ctx, cfg, trims, known), "motion-vectors")
    return exact.unionByName(near_groups(vectors, cfg.dedupe_z))


def flags(groups: DataFrame) -> DataFrame:
    """A flag for every episode of a group but the first."""
    from framewright.operators.checks import ORD

    keep = F.element_at("episodes", 1)
    each = groups.select("kind", "max_distance", keep.alias("keep"), F.explode("episodes").alias("episode_index")).where("episode_index <> keep")
    exact = F.col("kind") == "exact"
    text = F.when(exact, F.format_string("exact duplicate of episode %d", "keep")).otherwise(F.format_string("near-duplicate of episode %d (distance %.3f)", "keep", "max_distance"))
    return each.select("episode_index", F.lit(ORD["duplicate"]).alias("ord"), F.lit("duplicate").alias("check"), F.when(exact, "error").otherwise("warn").alias("severity"), text.alias("message"), F.when(exact, 50.0).otherwise(25.0).alias("penalty"))
