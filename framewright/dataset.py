"""The handle on a dataset: frames, episodes and what its metadata says."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES = "episode_index bigint, pos int, frame_index bigint, timestamp double, action array<double>, state array<double>, task_index bigint"
#: Where a camera's clip lies: seconds within its file, and the numbers of that file in layouts that number files.
SPAN = "struct<start:double,end:double,chunk:bigint,file:bigint>"
EPISODES = f"episode_index bigint, meta_length bigint, task string, spans map<string,{SPAN}>, cameras map<string,struct<mean:double,std:double>>"


@dataclass(frozen=True)
class Dataset:
    """frames and episodes have the columns of FRAMES and EPISODES; pos counts an episode's frames from 0."""

    frames: DataFrame
    episodes: DataFrame
    fps: float
    source: str = ""
    version: str = ""
    robot: str | None = None
    action_names: list[str] | None = None
    state_names: list[str] | None = None
    camera_names: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    video_root: str | None = None
    video_path: str | None = None
    chunks_size: int = 1000

    def with_frames(self, frames: DataFrame) -> Dataset:
        return replace(self, frames=frames)

    def only(self, ids=None, first: int | None = None) -> Dataset:
        """The dataset of some episodes: the given ones, or the first so many in order. Unknown ones are an error, and so is none."""
        known = self.frames.select("episode_index").distinct()
        if ids is not None:
            ids = sorted(set(ids))
            here = {r[0] for r in known.where(F.col("episode_index").isin(ids)).collect()}
            if missing := [i for i in ids if i not in here]:
                raise ValueError(f"no such episodes: {missing}")
        else:
            ids = [r[0] for r in known.orderBy("episode_index").limit(first or 0).collect()]
        if not ids:
            raise ValueError("no episode is left")
        return replace(self, frames=self.frames.where(F.col("episode_index").isin(ids)), episodes=self.episodes.where(F.col("episode_index").isin(ids)))


def no_episodes(spark) -> DataFrame:
    return spark.createDataFrame([], EPISODES)
