import math

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import ann as A


def brute(rows, is_query, k=10):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, set()).add(tuple(np.float64(np.float32(x)) for x in v))
    out = {}
    for i, vs in ok.items():
        if is_query(i):
            for v in vs:
                for j, ws in ok.items():
                    if j != i:
                        for w in ws:
                            if len(w) == len(v):
                                d = float(np.sqrt(np.sum((np.array(v) - np.array(w)) ** 2)))
                                out.setdefault(i, {})[j] = min(d, out.get(i, {}).get(j, math.inf))
    return {i: sorted((d, j) for j, d in c.items())[:k] for i, c in out.items()}


def run(spark, rows, k=10, **opt):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in A.search(df, lambda i: F.pmod(i, F.lit(100)) == 0, k=k, **opt).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    return got


def test_chi2_quantile():
    assert abs(A.chi2_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(A.chi2_quantile(0.99, 1) - 6.6349) < 1e-3


def test_recall_on_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = brute(rows, lambda i: i % 100 == 0)
    got = {}
    for r in A.search(df, lambda i: F.pmod(i, F.lit(100)) == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(got[q] & {j for _, j in w}) for q, w in want.items()) / sum(len(w) for w in want.values())
    assert set(got) == set(want) and hit >= 0.98


def test_stops_early():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(200, 32))
    data = np.repeat(centres, 20, axis=0) + 0.01 * rng.normal(size=(4000, 32))
    matrix = A.projections(32, 6)
    index = A.Index(np.arange(4000), data, matrix, 10, leaf=32)
    ids, dist, seen = index.search(0, data[0], data[0] @ matrix, A.chi2_quantile(0.99, 6))
    assert seen < 1500 and set(ids) <= set(range(20)) and list(dist) == sorted(dist)


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(250)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(300)]
    rows += [(2000, None), (2100, [0.0, 0.0, 0.0]), (2200, [1.0, None, 2.0]), (2300, [float("nan"), 1.0, 1.0]), (2400, [float("inf"), 1.0, 1.0]), (2500, []), (None, [1.0, 2.0, 3.0]), (2600, [1.0, 2.0]), (0, [1.0, 2.0, 3.0]), (100, [-0.0, 1.0, 0.0]), (3000, [0.0, 1.0, 0.0])]
    want, got = brute(rows, lambda i: i % 100 == 0), run(spark, rows, sure=0.999999)
    for q in want:
        assert [j for _, j in want[q]] == [j for _, j in got[q]], q
        assert np.allclose([d for d, _ in want[q]], [d for d, _ in got[q]], atol=1e-12)
    assert set(got) == {q for q, w in want.items() if w}


def test_small_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(A, "QUERY_VALUES", 10)
    rng = np.random.default_rng(6)
    rows = [(i * 50, rng.normal(size=4).tolist()) for i in range(60)]
    want, got = brute(rows, lambda i: i % 100 == 0, 3), run(spark, rows, k=3, sure=0.999999, block_rows=7)
    assert {q: [j for _, j in w] for q, w in want.items()} == {q: [j for _, j in w] for q, w in got.items()}


def test_few_rows_empty_and_clashing_columns(spark):
    assert run(spark, [(0, [1.0, 0.0]), (5, [0.0, 1.0])]) == {0: [(math.sqrt(2), 5)]}
    assert run(spark, [(0, [1.0])]) == {} and run(spark, [(1, [1.0])]) == {}
    df = spark.createDataFrame([(0, [1.0], 9, "a"), (3, [2.0], 8, "b")], "vec_id long, embedding array<float>, rank int, score string")
    assert [tuple(r) for r in A.search(df, lambda i: i == 0).collect()] == [(0, 1, 3, 1.0)]
    assert A.search(df.limit(0), lambda i: i == 0).count() == 0


def test_share_verified_on_test_table():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), dtype=np.float64)
    matrix = A.projections(v.shape[1], A.PROJECTIONS)
    index, quantile = A.Index(ids, v, matrix, 10), A.chi2_quantile(A.SURE, A.PROJECTIONS)
    shares = [index.search(i, x, x @ matrix, quantile)[2] / len(ids) for i, x in zip(ids, v) if i % 100 == 0]
    assert np.mean(shares) < 0.5


def test_rows_come_in_projected_order():
    rng = np.random.default_rng(2)
    data = rng.normal(size=(3000, 16))
    matrix = A.projections(16, 6)
    index, seen = A.Index(np.arange(3000), data, matrix, 10, leaf=16), []
    real = index._verified
    index._verified = lambda i, q, rows, *best: (seen.extend(rows.tolist()), real(i, q, rows, *best))[1]
    index.search(-1, data[5], data[5] @ matrix, 4.0)
    apart = ((index.points - data[5] @ matrix) ** 2).sum(axis=1)
    assert 10 < len(seen) < 3000 and set(seen) == set(np.argsort(apart, kind="stable")[: len(seen)].tolist())
    assert np.all(np.diff(apart[seen]) >= 0)
