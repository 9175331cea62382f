"""Reader, export, command line, configuration, video runs, streams."""

import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewright import cli
from framewright.config import Config
from framewright.functions.scalars import axis_pairs, episode_spec, gripper_dims, matched_dims
from framewright.plans.export import export, merge_arrays
from framewright.plans.survey import survey, table
from framewright.sources import episodic, video
from framewright.streaming import monitor
from tests.fixtures import DIMS, FPS, NAMES, TASK, clean, rests, says, take, write


@pytest.fixture(scope="module", params=["v3.0", "v2.1"])
def source(request, tmp_path_factory):
    eps = [take(2 + 0.2 * i, i, *([rests(0.5)] if i == 2 else []), says(camera=(0.01 if i == 4 else 0.5, 0.01))) for i in range(6)]
    return write(tmp_path_factory.mktemp("io") / "src", eps, request.param), eps, request.param


def test_load(spark, source):
    root, eps, version = source
    ds = episodic.load(spark, str(root))
    assert ds.fps == FPS and ds.version == version and ds.action_names == NAMES and ds.camera_names == ["wrist"] and not ds.warnings
    f = ds.frames.where("episode_index = 3").orderBy("pos").collect()
    _, _, action, state = eps[3].frames
    assert np.allclose([r.action for r in f], action, atol=1e-4) and np.allclose([r.state for r in f], state, atol=1e-4)
    e = {r.episode_index: r for r in ds.episodes.collect()}
    assert e[4].cameras["wrist"].mean == pytest.approx(0.01) and e[1].task == TASK and e[0].meta_length == 2 * FPS and (e[0].spans is not None) == (version == "v3.0")


def test_only_needed_files_are_read(spark, source, tmp_path):
    import shutil

    root = shutil.copytree(source[0], tmp_path / "c")
    for p in sorted((root / "data").rglob("*.parquet"))[1:]:
        p.write_bytes(b"no parquet")
    assert {r[0] for r in episodic.load(spark, str(root), [0]).frames.select("episode_index").distinct().collect()} == {0}
    assert episodic.load(spark, str(root), max_episodes=1).frames.count() == 2 * FPS


def test_load_errors(spark, source, tmp_path):
    with pytest.raises(FileNotFoundError):
        episodic.load(spark, str(tmp_path))
    with pytest.raises(ValueError, match="99"):
        episodic.load(spark, str(source[0]), [0, 99])


def test_sub_columns(spark, tmp_path):
    ds = episodic.load(spark, str(write(tmp_path / "p", clean(2), files=2, parts=True)))
    assert ds.action_names == ["base.d0", "base.d1", "hand.d0", "hand.d1", "hand.d2"]
    assert ds.frames.select(F.max(F.size("action"))).first()[0] == DIMS


def test_twice_declared_episodes_go(spark, tmp_path):
    root = write(tmp_path / "t", clean(4), "v2.1")
    with (root / "meta/episodes.jsonl").open("a") as f:
        f.write(json.dumps({"episode_index": 2, "tasks": [TASK], "length": 5}) + "\n")
    ds = episodic.load(spark, str(root))
    assert {r[0] for r in ds.frames.select("episode_index").distinct().collect()} == {0, 1, 3} and "[2]" in ds.warnings[0]
    with pytest.raises(ValueError, match="more than once"):
        episodic.load(spark, str(root), [2])


def test_export(spark, source, tmp_path):
    root, eps, version = source
    out = tmp_path / "out"
    r = export(spark, root, out, [0, 2, 3, 5], {2: (10, 50)})
    assert r.kept == [0, 2, 3, 5] and r.dropped == [1, 4] and r.trimmed_frames == len(eps[2].kept) - 40
    ds = episodic.load(spark, str(out))
    f = ds.frames.where("episode_index = 1").orderBy("pos").collect()
    assert len(f) == 40 and [x.frame_index for x in f] == list(range(40)) and abs(f[0].timestamp) < 1e-5
    assert np.allclose([x.action for x in f], eps[2].frames[2][10:50], atol=1e-4)
    index = sorted(i for p in (out / "data").rglob("*.parquet") for i in pq.read_table(p)["index"].to_pylist())
    assert index == list(range(r.frames))
    info = json.loads((out / "meta/info.json").read_text())
    assert info["total_episodes"] == 4 and info["total_frames"] == r.frames and info["splits"] == {"train": "0:4"}
    stats = json.loads((out / "meta/stats.json").read_text())
    parts = [eps[i].frames[2] for i in (0, 2, 3, 5)]
    parts[1] = parts[1][10:50]
    every = np.concatenate(parts)
    assert np.allclose(stats["action"]["mean"], every.mean(0), atol=1e-3) and np.allclose(stats["action"]["std"], every.std(0), atol=1e-3) and stats["action"]["count"] == [len(every)]
    assert np.allclose(np.ravel(stats["wrist"]["mean"]), [0.5] * 3) and stats["wrist"]["count"] == [40]
    e = {x.episode_index: x for x in ds.episodes.collect()}
    assert e[1].meta_length == 40
    if version == "v3.0":
        assert e[1].spans["wrist"]["end"] - e[1].spans["wrist"]["start"] == pytest.approx(40 / FPS)
        assert pq.read_schema(next((out / "data").rglob("*.parquet"))).field("timestamp").type == "float"
    else:
        assert sorted(p.name for p in (out / "data").rglob("*.parquet")) == [f"episode_{i:06d}.parquet" for i in range(4)]


def test_export_errors(spark, source, tmp_path):
    root = source[0]
    for args, error in (((root, [0]), ValueError), ((tmp_path / "x", []), ValueError), ((tmp_path / "x", [77]), ValueError)):
        with pytest.raises(error):
            export(spark, root, *args)
    with pytest.raises(ValueError, match="fit"):
        export(spark, root, tmp_path / "x", [0], {0: (5, 999)})
    (tmp_path / "full").mkdir()
    (tmp_path / "full/a").write_text("a")
    with pytest.raises(FileExistsError):
        export(spark, root, tmp_path / "full", [0])


def test_merged_statistics():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(30, 2)), rng.normal(2, 3, size=(70, 2))
    of = lambda m: {"mean": m.mean(0), "std": m.std(0), "min": m.min(0), "max": m.max(0), "count": [len(m)]}
    got, every = merge_arrays([of(a), of(b)], ["mean", "std", "min", "max", "count"]), np.concatenate([a, b])
    assert np.allclose(got["std"], every.std(0)) and np.allclose(got["mean"], every.mean(0)) and got["count"] == [100]
    assert merge_arrays([{"mean": [1]}], ["mean"]) is None and merge_arrays([of(a)], ["other"]) is None


def test_command_line(spark, source, tmp_path, capsys):
    root = str(source[0])
    few = [x for c in ("timing", "integrity", "idle", "smoothness", "stale_state", "sync", "gripper_chatter", "length", "duplicate") for x in ("--disable-check", c)]
    assert cli.main(["score", root, "--json", str(tmp_path / "r.json"), "--csv", str(tmp_path / "r.csv"), "--md", str(tmp_path / "r.md"), "--episodes", "0-5"], spark) == 0
    assert "6 episodes" in capsys.readouterr().out and (tmp_path / "r.md").exists() and (tmp_path / "r.csv").exists()
    assert cli.main(["score", root, "--quiet", "--fail-under", "101", *few], spark) == 1
    assert cli.main(["score", str(tmp_path / "nowhere")], spark) == 2
    assert cli.main(["export", root, "-o", str(tmp_path / "o"), "--keep-from", str(tmp_path / "r.json")], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["export", root, "-o", str(tmp_path / "o2")], spark)
    assert cli.main(["dedupe", root], spark) == 0 and cli.main(["push-report", root], spark) == 2
    assert cli.main(["push-report", root, "--dry-run", "-o", str(tmp_path / "push"), *few], spark) == 0 and (tmp_path / "push/quality.md").exists()


def test_survey(spark, source):
    rows = survey(spark, [str(source[0]), "/nowhere"], episodic.load)
    assert rows[0]["episodes"] == 6 and rows[1]["error"] and "error:" in table(rows)


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("spike_factor = 5\ndedupe_resample_len = 20\n")
    assert Config.load(tmp_path / "c.toml").spike_factor == 5.0
    for bad in ("nothing = 1", "spike_factor = true", "spike_factor = 'x'", "dedupe_resample_len = 1.5", "= ="):
        (tmp_path / "b.toml").write_text(bad)
        with pytest.raises(ValueError):
            Config.load(tmp_path / "b.toml")


def test_names():
    assert episode_spec("0-3, 9,2") == [0, 1, 2, 3, 9] and gripper_dims(["a", "Left_Gripper", None, "hand_joint_1"]) == [1, 3]
    for bad in ("", "3-1", "x", "1,,2"):
        with pytest.raises(ValueError):
            episode_spec(bad)
    assert matched_dims(["a", "b"], ["b", "c", "b"], 2, 3) == ([1], [2]) and matched_dims(["a"], ["b"], 1, 1) is None and matched_dims(None, ["b"], 1, 1) == ([0], [0])
    assert axis_pairs(["r_x_rad", "r_y_rad", "r_z_rad"], [True, True, True]) == [(0, 2)] and axis_pairs(["r_x_rad", "r_z_rad"], [True, False]) == []
    assert episodic.flat_names({"m": ["a", "b"]}) == episodic.flat_names([["a"], ["b"]]) == ["a", "b"] and episodic.flat_names("x") is None
    assert episodic.part_names("action.arm", {"shape": [2]}) == ["arm.0", "arm.1"] and episodic.part_names("action.arm", {}) == ["arm"]


def samples(spark, means, thumbs):
    return spark.createDataFrame([(0, "cam", i, float(i), float(m), 0.0, [float(x)], False) for i, (m, x) in enumerate(zip(means, thumbs))], video.SAMPLES)


def test_dark_and_frozen_runs(spark):
    cfg = Config()
    s = samples(spark, [0.5] * 5 + [0.01] * 4 + [0.5] * 5, range(14))
    assert [(r.i0, r.i1) for r in video.dark_runs(s, cfg).collect()] == [(5, 9)] and video.frozen_runs(s, cfg).count() == 0
    assert video.dark_runs(samples(spark, [0.0] * 9, range(9)), cfg).count() == 0
    s = samples(spark, [0.5] * 22, [*range(9), 9, 9.01, 9.02, 9.03, *range(20, 29)])
    assert [(r.i0, r.i1) for r in video.frozen_runs(s, cfg).collect()] == [(9, 13)]
    assert [(r.i0, r.i1) for r in video.frozen_runs(samples(spark, [0.5] * 6, [1] * 6), cfg).collect()] == [(0, 6)]
    assert len(video.thumbnail(np.zeros((64, 48)))) == 32 * 32 and video.thumbnail([[0.0, 1.0]]) == [0.0, 1.0]


def test_clip_paths(spark, source):
    root, eps, version = source
    cfg = Config()
    ds = episodic.load(spark, str(root))
    got = {r.episode_index: r for r in video.clip_paths(ds).collect()}
    v3 = version == "v3.0"
    assert got[4].path == f"{root}/videos/" + ("wrist/chunk-000/file-002.mp4" if v3 else "chunk-000/wrist/episode_000004.mp4")
    assert (got[1].start is not None) == v3 and len(got) == 6
    assert video.decoded(video.clip_paths(ds), cfg).count() == 0  # files that aren't there are passed over
    (root / "videos").mkdir()
    try:
        path = got[4].path
        import pathlib
        import shutil

        pathlib.Path(path).parent.mkdir(parents=True)
        pathlib.Path(path).write_bytes(b"no video")
        broken = video.decoded(video.clip_paths(ds), cfg).collect()
        assert broken and all(r.failed for r in broken) and 4 in {r.episode_index for r in broken}
    finally:
        shutil.rmtree(root / "videos")


def test_stream_agrees_with_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, f in (("s1", lambda d: monitor.sessions(d, "6 hours")), ("s2", lambda d: monitor.rates(d, "1 day")), ("s3", lambda d: monitor.rates(d, "1 day", "12 hours"))):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name != "s1" else "append").start()
        q.processAllAvailable()
        q.stop()
        got, want = spark.table(name), f(events)
        assert want.count() > 0 and (got.exceptAll(want).count() == 0 if name == "s1" else got.count() == want.count())
