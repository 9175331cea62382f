"""Defects are found where they are, and nowhere else."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.config import Config
from framewright.operators import context as X
from framewright.operators import duplicates as D
from framewright.operators import signals as S
from framewright.plans import report as R
from framewright.plans.score import evaluate
from framewright.sources import episodic
from tests.fixtures import DIMS, FPS, TASK, chatters, clean, hole, lags, loses, rests, says, spike, stale, stuck, take, write


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    """Twenty episodes, of which 12 to 19 have a defect each."""
    spoilt = [[rests(1.5, 1.0)], [spike(100)], [loses(*range(60, 66))], [hole(50)], [lags(7)], [stale(60)], [stuck()], [chatters(40), says(length=99, span=5.0, camera=(0.01, 0.01))]]
    eps = clean(12) + [take(8, 200 + i, *defects) for i, defects in enumerate(spoilt)] + [clean(12)[8]]
    ds = episodic.load(spark, str(write(tmp_path_factory.mktemp("scored") / "d", eps)))
    return ds, evaluate(ds), eps


def flagged(scored, check, text=""):
    return {r.episode_index for r in scored[1].flags.where((F.col("check") == check) & F.col("message").contains(text)).collect()}


@pytest.mark.parametrize("check,text,who", [
    ("timing", "dropped", {14}), ("metadata", "says 99", {19}), ("integrity", "action (1 frame", {15}), ("video_sync", "wrist 5.00s", {19}), ("camera", "near-black", {19}),
    ("idle", "idle at start/end", {12}), ("idle", "no motion", {18}), ("smoothness", "spike", {13}), ("stale_state", "frozen on", {17}), ("gripper_chatter", "toggled", {19}), ("sync", "lag is 7", {16}), ("duplicate", "exact duplicate of episode 8", {20}),
])
def test_flags(scored, check, text, who):
    found = flagged(scored, check, text)
    assert who <= found and not found & (set(range(12)) - who), found


def test_metrics_and_scores(scored):
    r = {x.episode_index: x for x in scored[1].results.collect()}
    assert r[14].dropped_frames == 6 and r[13].spikes == 1 and r[16].sync_lag_frames == 7 and abs(r[12].lead_idle_s - 1.5) < 0.15
    start, end = r[12].trim_start, r[12].trim_end
    assert start is not None and 0 < start < end < r[12].length
    assert r[18].score <= 40 and all(r[i].score >= 80 for i in range(12)) and all(x.task == TASK for x in r.values())
    for x in r.values():
        assert abs(x.score - max(0.0, 100 - sum(f.penalty for f in x.flags))) < 1e-9
        assert [f.ord for f in x.flags] == sorted(f.ord for f in x.flags)


def test_scale_and_steps_like_numpy(scored):
    ds, s, eps = scored
    a = [e.frames[2].astype(np.float32).astype(float) if i < 7 else e.frames[2] for i, e in enumerate(eps)]
    q75, q25 = np.nanpercentile(np.concatenate(a), [75, 25], axis=0)
    assert np.allclose([x or 0 for x in s.context.scale], (q75 - q25) / 1.349, rtol=1e-6)
    steps = np.concatenate([np.abs(np.diff(x, axis=0)) for x in a]) / np.array(s.context.scale)
    assert np.allclose(s.context.step_p99[: DIMS - 1], np.nanpercentile(steps, 99, axis=0)[: DIMS - 1], rtol=1e-5) and s.context.step_p99[-1] is None


def test_disabled_checks_are_not_planned(scored):
    ds = scored[0]
    s = evaluate(ds, disabled={"idle", "sync", "smoothness", "duplicate", "stale_state", "gripper_chatter"})
    assert {"idle_fraction", "ldlj", "sync_peak_corr"}.isdisjoint(s.results.columns)
    assert {r[0] for r in s.flags.select("check").distinct().collect()} <= {"timing", "metadata", "integrity", "video_sync", "camera", "length"}
    with pytest.raises(ValueError):
        evaluate(ds, disabled={"nothing"})


def test_report(scored, tmp_path):
    ds, s, _ = scored
    report = R.build(ds, s)
    assert report["dataset"]["episodes"] == 21 and report["summary"]["episodes_below_threshold"] == 21 - len(report["summary"]["keep"])
    assert {"episodes": [8, 20], "kind": "exact", "max_distance": 0.0} in report["summary"]["duplicate_groups"]
    R.write_json(report, tmp_path / "r.json")
    assert R.load(tmp_path / "r.json", 21, report["dataset"]["frames"]) == report
    with pytest.raises(ValueError):
        R.load(tmp_path / "r.json", 20, 1)
    R.write_csv(s, tmp_path / "r.csv")
    assert (tmp_path / "r.csv").read_text().startswith("episode_index,score,length,duration_s,trim_start,trim_end,flags,") and len((tmp_path / "r.csv").read_text().splitlines()) == 22
    assert "| idle |" in R.markdown(report) and "exact duplicates: 8, 20" in R.terminal(report)
    assert R.escape("a|b\nc") == "a\\|b c" and "brightgreen" in R.badge(95) and "yellow" in R.badge(75) and "red" in R.badge(10)
    assert R.trims_of(report)[12] == (report["episodes"][12]["trim"][0], report["episodes"][12]["trim"][1])


def test_runs_and_smoothing(spark):
    rng = np.random.default_rng(0)
    x = rng.random(40)
    df = spark.createDataFrame([(1, i, float(v), bool(v > 0.5)) for i, v in enumerate(x)], "episode_index bigint, t int, speed double, on boolean")
    for win in (1, 2, 3, 6, 7):
        got = [r.speed for r in S.smoothed(df, win).orderBy("t").collect()]
        assert np.allclose(got, np.convolve(x, np.ones(win) / win, "same"))
    got = sorted((r.begin, r.end) for r in S.runs(df, "on", "t").collect())
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (x > 0.5).astype(int), [0]])))
    assert got == list(zip(edges[::2], edges[1::2]))


def test_nearest_and_groups_like_numpy(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 5))
    m[10], m[11], m[30] = m[3] + 1e-3, m[3] - 1e-3, m[29]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id bigint, v array<double>")
    d = np.sqrt(((m[:, None] - m[None]) ** 2).mean(2))
    np.fill_diagonal(d, np.inf)
    got = {r.id: r.distance for r in D.nearest(v).collect()}
    assert np.allclose([got[i] for i in range(40)], d.min(1), atol=1e-7)
    pairs = {(r.a, r.b) for r in D.pairs_within(v, 0.5).collect()}
    assert pairs == {(i, j) for i in range(40) for j in range(i + 1, 40) if d[i, j] <= 0.5}
    assert sorted(r.episodes for r in D.near_groups(v, 2.0).collect()) == [[3, 10, 11], [29, 30]]
    assert D.near_groups(v.limit(3), 3.0).count() == 0


def test_wrapped_angles_and_gimbal_lock(spark):
    t = np.arange(90) / 30
    rows = []
    for e in range(8):
        angle = (t * 2 + e + np.pi) % (2 * np.pi) - np.pi
        rows += [(e, i, float(a), float(-a + 0.01 * i)) for i, a in enumerate(angle)]
    frames = spark.createDataFrame(rows, "episode_index bigint, pos int, x double, z double").select("episode_index", "pos", F.array("x", "z").alias("action"), F.col("pos").cast("double").alias("timestamp"))
    stats = {r["dim"]: r for r in X.dim_stats(frames).select("*", X.angular_column(Config()).alias("ang")).collect()}
    assert stats[0].ang and stats[0].turn99 < 0.1 < stats[0].hi


def test_empty_and_tiny(spark):
    from framewright.dataset import EPISODES, FRAMES, Dataset

    empty = Dataset(spark.createDataFrame([], FRAMES), spark.createDataFrame([], EPISODES), 30.0)
    assert evaluate(empty).results.count() == 0
    one = Dataset(spark.createDataFrame([(0, 0, 0, 0.0, [1.0, 2.0], None, None)], FRAMES), spark.createDataFrame([], EPISODES), 30.0)
    r = evaluate(one).results.collect()
    assert len(r) == 1 and r[0].length == 1
    bare = Dataset(spark.createDataFrame([(0, i, i, i / 30, None, None, None) for i in range(20)], FRAMES), spark.createDataFrame([], EPISODES), 30.0)
    assert evaluate(bare).results.collect()[0].score == 100.0


def test_sampling_rate_of_fixture():
    assert len(take(2.0).kept) == 2 * FPS
