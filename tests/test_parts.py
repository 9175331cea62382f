"""A query pays for no more of the context than it needs, and reads the frames no more often than it must."""

import numpy as np
import pytest

from framewright import queries as Q
from framewright.operators import checks as C
from framewright.operators import context as X
from framewright.operators import quantiles
from framewright.operators import signals as S
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture
def written(spark, monkeypatch):
    """Names of the tables that are written, with a context of its own."""
    names, write = [], X.write_and_read
    monkeypatch.setattr(X, "write_and_read", lambda df, name: names.append(name) or write(df, name))
    monkeypatch.setattr(Q, "_kept", {})
    return names


def test_speed_percentile_is_computed_once(spark, written, monkeypatch):
    asked, p75 = [], X.speed_p75
    monkeypatch.setattr(X, "speed_p75", lambda *a: asked.append(1) or p75(*a))
    assert compare(spark, connect(SF), SF, Q.idle_speed, Q.SQL["idle_speed"]) is None
    assert len(asked) == 1 and written == ["moves"]
    assert Q._kept.popitem()[1].parts == {"scale", "idle"}


def test_full_bins_are_divided(spark, monkeypatch):
    listed, ranks = [], quantiles._ranks

    def seen(values, by, groups, targets):
        listed.extend(t for t in targets)
        return ranks(values, by, groups, targets)

    monkeypatch.setattr(quantiles, "_ranks", seen)
    monkeypatch.setattr(quantiles, "LISTED", 50)
    v = 1e6 + np.random.default_rng(3).random(20_000)  # all within one power of two's bin
    values = spark.createDataFrame([(float(x),) for x in [*v, 5.0, -np.inf, np.inf]], "v double")
    got = quantiles.percentiles(values, [], [0.25, 0.5, 0.99])[0]
    want = np.percentile([*v, 5.0, -1e9, 1e9], [25, 50, 99])
    assert np.allclose([got[p] for p in (0.25, 0.5, 0.99)], want, rtol=1e-12)
    inside = [np.count_nonzero((v >= t[2]) & (v <= t[3])) for t in listed]
    assert len(listed) == 3 and max(inside) <= 50


def test_a_context_grows_by_parts(spark, written):
    ds, some = Q._supp(spark, SF, "scale")
    assert not written and some.step_p99 is None
    _, more = Q._supp(spark, SF, "idle")
    assert written == ["moves"] and more.scale == some.scale and more.idle_speed > 0
    _, every = Q._supp(spark, SF)
    assert every == X.build(ds, Q.CFG) and Q._supp(spark, SF, "scale")[1] == every


def test_idle_runs_need_no_steps_and_no_stale_baseline(spark, written):
    assert compare(spark, connect(SF), SF, Q.idle_runs, Q.SQL["idle_runs"]) is None
    assert written == ["moves"] and Q._kept.popitem()[1].parts == {"scale", "idle"}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lags_are_one_pass(spark, written):
    df = Q.sync_baseline(spark, SF)
    assert plan(df).count("Generate") == 1 and plan(df).count("Relation [") == 1 and not written  # no join with the whole, no union, no scale
    assert compare(spark, connect(SF), SF, Q.sync_baseline, Q.SQL["sync_baseline"]) is None


def test_lags_of_still_and_short_episodes(spark):
    from framewright.dataset import Dataset

    move = [float(i * i % 7) for i in range(30)]
    rows = [(1, i, [x, 2.0], [move[max(0, i - 2)], 2.0]) for i, x in enumerate(move)]
    rows += [(2, i, [1.0, 1.0], [float(i % 3), 0.0]) for i in range(10)]  # still: lag 0, correlation 0
    rows += [(3, i, [float(i % 3), 0.0], [float(i % 3), 0.0]) for i in range(9)]  # too short
    rows += [(4, i, [float(i % 3), 0.0], [float(i % 3), 0.0]) for i in range(10)]  # 9 velocities overlap
    ds = Dataset(spark.createDataFrame(rows, "episode_index bigint, pos int, action array<double>, state array<double>"), None, 10.0)
    got = {r.episode_index: (r.lag, round(r["corr"], 6)) for r in S.best_lags(ds, X.Context(10.0, None, None, sync_dims=([0, 1], [0, 1])), Q.CFG).collect()}
    assert got == {1: (2, 1.0), 2: (0, 0.0)}


def test_toggles_need_only_scales_and_no_row_for_each_dimension(spark, written):
    df = Q.sliding_toggle_count(spark, SF)
    assert not written and "Generate" not in plan(df) and Q._kept.popitem()[1].parts == {"scale"}
    assert compare(spark, connect(SF), SF, Q.sliding_toggle_count, Q.SQL["sliding_toggle_count"]) is None


def test_toggles_of_several_grippers(spark):
    from dataclasses import replace

    ds, ctx = Q._supp(spark, SF, "scale")
    toggles = lambda *dims: {tuple(r) for r in S.toggles(ds, replace(ctx, grippers=list(dims)), Q.CFG).collect()}
    assert toggles(0, 2, 3) == toggles(0) | toggles(2) | toggles(3) and toggles(0) and not toggles()


def test_gripper_check_computes_toggles_once(spark, monkeypatch):
    names, write = [], C.write_and_read
    monkeypatch.setattr(C, "write_and_read", lambda df, name: names.append(name) or write(df, name))
    df = Q.gripper_check(spark, SF)
    assert names == ["toggles"] and "Window" not in plan(df)
    assert compare(spark, connect(SF), SF, Q.gripper_check, Q.SQL["gripper_check"]) is None


def test_jerk_needs_only_scales_and_no_function_of_arrays(spark, written):
    df = Q.ldlj(spark, SF)
    assert not written and "lambda" not in plan(df) and Q._kept.popitem()[1].parts == {"scale"}
    assert compare(spark, connect(SF), SF, Q.ldlj, Q.SQL["ldlj"]) is None


def test_jerk_of_missing_numbers(spark):
    from framewright.dataset import Dataset

    rows = [(e, i, [float(i * i % 7), None if e == 2 and i == 20 else 1.0 * (i % 2), 3.0]) for e in (1, 2) for i in range(40)] + [(3, i, [1.0, 1.0, 1.0]) for i in range(12)]
    ds = Dataset(spark.createDataFrame(rows, "episode_index bigint, pos int, action array<double>"), None, 10.0)
    got = {r.episode_index: r.ldlj for r in S.jerkiness(ds, X.Context(10.0, [1.0, 2.0, None], None)).collect()}
    a = np.array([r[2] for r in rows if r[0] == 1])[:, :2] / [1.0, 2.0]
    v2, j2 = ((np.diff(a, axis=0) * 10) ** 2).sum(1), ((np.diff(a, 3, axis=0) * 1000) ** 2).sum(1)
    ldlj = lambda ok: -np.log(4.0**3 / v2.max() * j2[ok].sum() * 0.1)
    assert np.isclose(got[1], ldlj(slice(None))) and got[3] is None
    assert np.isclose(got[2], ldlj([i for i in range(37) if not i <= 20 <= i + 3]))


def test_smoothness_finds_large_steps_once(spark, written, monkeypatch):
    found, big_steps = [], S.big_steps
    monkeypatch.setattr(S, "big_steps", lambda *a: found.append(big_steps(*a)) or found[-1])
    df = Q.smoothness_check(spark, SF)
    assert len(found) == 1
    assert "Window" not in plan(df) and Q._kept.popitem()[1].parts == {"scale", "steps"}
    assert compare(spark, connect(SF), SF, Q.smoothness_check, Q.SQL["smoothness_check"]) is None


def test_stale_frames_are_computed_once(spark, monkeypatch):
    names, write = [], C.write_and_read
    monkeypatch.setattr(C, "write_and_read", lambda df, name: names.append(name) or write(df, name))
    df = Q.stale_check(spark, SF)
    assert names == ["stale", "stale-metrics"] and "Window" not in plan(df)
    assert compare(spark, connect(SF), SF, Q.stale_check, Q.SQL["stale_check"]) is None


def test_sync_reads_its_lags_from_a_table(spark, monkeypatch):
    names, write = [], C.write_and_read
    monkeypatch.setattr(C, "write_and_read", lambda df, name: names.append(name) or write(df, name))
    df = Q.sync_check(spark, SF)
    assert names == ["lags"] and "Window" not in plan(df)
    assert compare(spark, connect(SF), SF, Q.sync_check, Q.SQL["sync_check"]) is None


def test_jerk_outliers_compute_jerk_once(spark, monkeypatch):
    names, write = [], Q.write_and_read
    monkeypatch.setattr(Q, "write_and_read", lambda df, name: names.append(name) or write(df, name))
    df = Q.jerk_outliers(spark, SF)
    assert names == ["jerkiness"] and "Window" not in plan(df)
    assert compare(spark, connect(SF), SF, Q.jerk_outliers, Q.SQL["jerk_outliers"]) is None
