"""Small episodic datasets: smooth motion of an arm, spoilt by defects that are functions, in either layout."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

FPS = 25
NAMES = ["slide", "lift", "swing", "tilt", "gripper"]
DIMS = len(NAMES)
SPLIT = 2  # dimensions of the first of two sub-columns
TASK = "stack the cups"


@dataclass
class Take:
    """An episode in the making: its streams, which frames are kept, and what the metadata says of it."""

    time: np.ndarray
    action: np.ndarray
    lag: int = 1
    state: np.ndarray | None = None
    kept: np.ndarray | None = None
    said: dict = field(default_factory=dict)

    @property
    def frames(self):
        """timestamp, frame_index, action, state."""
        k = self.kept
        return self.time[k].astype(np.float32), np.arange(len(k)), self.action[k], self.state[k]


def _swing(t: np.ndarray, seed: int) -> np.ndarray:
    """Every joint on a wave of its own, never all at rest; the gripper closes half way."""
    rng = np.random.default_rng(seed)
    waves = [rng.uniform(15, 40) * np.sin(2 * np.pi * rng.uniform(0.15, 0.3) * t + phase) for phase in rng.uniform(0, 6.28, DIMS - 1)]
    grip = np.where(np.arange(len(t)) * 2 < len(t), 0.0, 45.0)
    return np.stack([*(w + rng.normal(0, 0.01, len(t)) for w in waves), grip], axis=1)


def take(seconds: float = 8.0, seed: int = 0, *defects) -> Take:
    """An episode with the defects (stage, function) applied: on the action, then on the state that follows it, then on the frames."""
    t = np.arange(round(seconds * FPS)) / FPS
    made = Take(t, _swing(t, seed))
    made.kept = np.arange(len(t))
    by_stage = lambda stage: [f(made) for s, f in defects if s == stage]
    by_stage("action")
    late = np.maximum(np.arange(len(t)) - made.lag, 0)
    made.state = made.action[late].copy()
    by_stage("state")
    return made


def _defect(stage):
    return lambda f: lambda *args, **named: (stage, lambda made: f(made, *args, **named))


@_defect("action")
def rests(made, lead: float = 0.0, trail: float = 0.0):
    """The arm waits before it moves, and after."""
    a, b = round(lead * FPS), len(made.time) - round(trail * FPS)
    made.action[:a], made.action[b:] = made.action[a], made.action[b - 1]


@_defect("action")
def stuck(made):
    made.action[:] = made.action[0]


@_defect("action")
def spike(made, at: int):
    made.action[at, 0] += 150


@_defect("action")
def chatters(made, at: int):
    """The gripper goes to and fro."""
    away = 45.0 - made.action[at, -1]
    for k in range(0, 24, 4):
        made.action[at + k : at + k + 2, -1] = away


@_defect("action")
def lags(made, frames: int):
    made.lag = frames


@_defect("state")
def stale(made, since: int):
    made.state[since:] = made.state[since]


@_defect("state")
def hole(made, at: int):
    made.action[at, 1] = np.nan


@_defect("state")
def loses(made, *frames: int):
    made.kept = np.setdiff1d(made.kept, frames)


@_defect("state")
def says(made, **what):
    """length, span (seconds) or camera (mean, std) in the metadata."""
    made.said |= what


def clean(n: int = 12) -> list[Take]:
    return [take(8 + 0.32 * (i % 4), 100 + i) for i in range(n)]


# ---- writing ------------------------------------------------------------------------------------------------


def _moments(m: np.ndarray) -> dict:
    return {"min": m.min(0).tolist(), "max": m.max(0).tolist(), "mean": m.mean(0).tolist(), "std": m.std(0).tolist(), "count": [len(m)]}


def _camera(t: Take) -> dict:
    image = lambda x: [[[x]] for _ in range(3)]
    mean, std = t.said.get("camera", (0.4, 0.15))
    return {"mean": image(mean), "std": image(std), "min": image(0.0), "max": image(1.0), "count": [10]}


def _streams(action: np.ndarray, state: np.ndarray, parts: bool) -> dict[str, np.ndarray]:
    both = {"action": action, "observation.state": state}
    return {f"{s}.{side}": half for s, m in both.items() for side, half in (("base", m[:, :SPLIT]), ("hand", m[:, SPLIT:]))} if parts else both


def _table(takes: list[Take], numbers, start: int, parts: bool, kind) -> pa.Table:
    each = [takes[i].frames for i in numbers]
    time, frame, action, state = (np.concatenate(c) for c in zip(*each, strict=True))
    episode = np.concatenate([np.full(len(f[0]), i) for i, f in zip(numbers, each, strict=True)])
    flat = {"timestamp": time, "frame_index": frame, "episode_index": episode, "task_index": np.zeros(len(time), int), "index": start + np.arange(len(time))}
    vectors = {c: pa.array(m.tolist(), type=pa.list_(kind)) for c, m in _streams(action, state, parts).items()}
    return pa.table({c: pa.array(v) for c, v in flat.items()} | vectors)


def _put(table: pa.Table, path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path)


def write(root, takes: list[Take], version: str = "v3.0", files: int = 3, parts: bool = False):
    """The takes as a dataset in a layout; with parts, each stream is two sub-columns."""
    size = [len(t.kept) for t in takes]
    starts = np.concatenate([[0], np.cumsum(size)]).tolist()
    v3 = version.startswith("v3")
    features = {c: {"dtype": k} for c, k in (("timestamp", "float32"), ("frame_index", "int64"), ("episode_index", "int64"), ("index", "int64"))}
    for c, m in _streams(np.zeros((1, DIMS)), np.zeros((1, DIMS)), parts).items():
        names = NAMES if not parts else [f"d{i}" for i in range(m.shape[1])]
        features[c] = {"dtype": "float32", "shape": [m.shape[1]], "names": names}
    features["wrist"] = {"dtype": "video", "shape": [4, 4, 3]}
    place = "chunk-{chunk_index:03d}/file-{file_index:03d}" if v3 else "episode_{episode_index:06d}"
    info = {
        "codebase_version": version, "robot_type": "bench", "fps": FPS, "total_episodes": len(takes), "total_frames": starts[-1], "chunks_size": 1000, "splits": {"train": f"0:{len(takes)}"}, "features": features,
        "data_path": f"data/{place}.parquet" if v3 else f"data/chunk-{{episode_chunk:03d}}/{place}.parquet", "video_path": f"videos/{{video_key}}/{place}.mp4" if v3 else f"videos/chunk-{{episode_chunk:03d}}/{{video_key}}/{place}.mp4",
    }
    (root / "meta").mkdir(parents=True)
    (root / "meta/info.json").write_text(json.dumps(info))
    if not parts:
        (root / "meta/stats.json").write_text(json.dumps({"action": _moments(np.concatenate([t.frames[2] for t in takes])), "wrist": _camera(takes[0])}))
    (_write_v3 if v3 else _write_v2)(root, takes, size, starts, files, parts)
    return root


def _write_v3(root, takes, size, starts, files, parts) -> None:
    rows = []
    for f, numbers in enumerate(np.array_split(np.arange(len(takes)), files)):
        numbers = numbers.tolist()
        _put(_table(takes, numbers, starts[numbers[0]], parts, pa.float64() if f else pa.float32()), root / f"data/chunk-000/file-{f:03d}.parquet")
        for i in numbers:
            said, begin = takes[i].said, starts[i] / FPS
            rows.append({"episode_index": i, "length": said.get("length", size[i]), "tasks": [TASK], "data/chunk_index": 0, "data/file_index": f, "dataset_from_index": starts[i], "dataset_to_index": starts[i + 1]})
            rows[-1] |= {"videos/wrist/chunk_index": 0, "videos/wrist/file_index": f, "videos/wrist/from_timestamp": begin, "videos/wrist/to_timestamp": begin + said.get("span", size[i] / FPS)}
            rows[-1] |= {"stats/index/min": [starts[i]], "stats/index/mean": [starts[i] + (size[i] - 1) / 2]} | {f"stats/wrist/{k}": v for k, v in _camera(takes[i]).items()}
    _put(pa.Table.from_pylist(rows), root / "meta/episodes/chunk-000/file-000.parquet")
    pd.DataFrame({"task_index": [0]}, index=[TASK]).to_parquet(root / "meta/tasks.parquet")


def _write_v2(root, takes, size, starts, files, parts) -> None:
    for i in range(len(takes)):
        _put(_table(takes, [i], starts[i], parts, pa.float32()), root / f"data/chunk-000/episode_{i:06d}.parquet")
    lines = {
        "episodes": [{"episode_index": i, "tasks": [TASK], "length": t.said.get("length", size[i])} for i, t in enumerate(takes)],
        "tasks": [{"task_index": 0, "task": TASK}],
        "episodes_stats": [{"episode_index": i, "stats": {"action": _moments(t.frames[2]), "wrist": _camera(t), "index": {"min": [starts[i]], "count": [size[i]]}}} for i, t in enumerate(takes)],
    }
    for name, rows in lines.items():
        (root / f"meta/{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
