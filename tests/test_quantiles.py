"""Exact percentiles by brackets are those of all values in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import context as X
from framewright.operators import quantiles as Q


def frame(spark, groups):
    return spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k int, v double").unionByName(spark.createDataFrame([(0, None), (9, None)], "k int, v double"))


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_percentiles_of_odd_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    groups = {0: rng.normal(size=5001), 1: [3.0], 2: np.repeat([1.0, 2.0], 500), 3: np.r_[np.exp(rng.normal(scale=50, size=999)), 1e300, -1e300], 4: [-0.0, 0.0, 5.0], 5: np.repeat(7.0, 100)}
    got = {r["k"]: r for r in Q.percentiles(frame(spark, groups), ["k"], [0.0, 0.25, 0.5, 0.99, 1.0])}
    assert all(np.isclose(got[k][p], np.percentile(v, p * 100), rtol=1e-12) for k, v in groups.items() for p in (0.0, 0.25, 0.5, 0.99, 1.0))
    assert got[9]["n"] == 0 and got[9][0.5] is None


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(Q, "MARGIN", -400)  # brackets beside the rank
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.array(*[F.lit(-5.0)] * 2))
    v = np.arange(1001.0)
    assert Q.percentiles(frame(spark, {0: v}).where("k = 0").select("v"), [], [0.75])[0][0.75] == 750.0


def test_dim_stats_keep_no_table_of_all_values(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a percentile over all values")

    monkeypatch.setattr(F, "percentile", refused)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 2))
    rows = [(i // 100, i % 100, [float(x) for x in r]) for i, r in enumerate(a)] + [(9, 0, [1.0, 2.0, 3.0])]
    got = {r.dim: r for r in X.dim_stats(spark.createDataFrame(rows, "episode_index bigint, pos int, action array<double>")).collect()}
    steps = np.abs(np.concatenate([np.diff(a[k:k + 100], axis=0) for k in (0, 100, 200)]))
    assert sorted(got) == [0, 1]  # a single frame tells no dimension
    for i in (0, 1):
        assert np.allclose([got[i].q25, got[i].q75, got[i].p99, got[i]["std"]], [*np.percentile(a[:, i], [25, 75]), np.percentile(steps[:, i], 99), a[:, i].std()])


def test_merged_quantiles_do_not_depend_on_the_order_of_the_parts(spark):
    from framewright.plans import merge

    def merged(values):
        parts = spark.createDataFrame([(0, 1, v, 0.0, v, v, v) for v in values], "dim int, count long, mean double, std double, min double, max double, q50 double").coalesce(1)
        return merge.merge_stats(parts, ["dim"], ["q50"]).collect()[0].q50

    values = [1e15, 0.1, 0.2, 0.3, -1e15]
    assert merged(values) == merged(values[::-1]) == merged(sorted(values)) == 0.6 / 5
    assert merged([1e300, 1.0, 3e300]) == 4e300 / 3
