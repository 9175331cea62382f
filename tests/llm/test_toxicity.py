import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import toxicity as X

BAD = ["grobian", "fiesling", "lowlife"]


def texts(n=600, seed=0, leak=True):
    """Texts of which a third are toxic; toxic ones mention a group more often if leak."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        said = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(30)]
        if toxic:
            said.insert(5, rng.choice(BAD))
        if leak and rng.random() < (0.8 if toxic else 0.1):
            said.insert(9, rng.choice(["muslim", "women", "black"]))
        out.append((" ".join(said), int(toxic)))
    return out


def test_swaps():
    assert X.swapped({"a", "b"}) is None
    other = X.swapped({"muslim", "a"})
    assert "a" in other and "muslim" not in other and len(other) == 2
    every = set(X.IDENTITY_TERMS[3])
    assert X.swapped(every) is None  # nothing to swap for


def test_penalty_lowers_identity_gap_and_keeps_accuracy():
    rows = texts()
    sets, y = [X.words(t) for t, _ in rows], np.array([v for _, v in rows])
    gaps = []
    for weight in (0.0, 5.0):
        model = X.fit(sets, y, cf_weight=weight)
        right = np.mean([(model.score(t) >= 0.5) == v for t, v in texts(300, 1)])
        assert right > 0.97
        plain = "alpha beta gamma delta"
        logit = lambda s: np.log(s / (1 - s))
        gaps.append(np.mean([abs(logit(model.score(f"{plain} {a}")) - logit(model.score(f"{plain} {b}"))) for a, b in (("muslim", "hindu"), ("women", "men"), ("black", "asian"))]))
    assert gaps[1] < 0.5 * gaps[0]


def test_degenerate_labels():
    assert X.fit([], np.array([])).score("x") < 0.5
    assert X.fit([{"a"}], np.array([1])).score(None) > 0.5


def test_tables(spark):
    rows = [(i, t, y, "en") for i, (t, y) in enumerate(texts(400))]
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t, _, _ in rows] + [(900, None, "s", 0.1), (901, "", "s", 0.1), (None, "no id grobian", "s", None), (0, rows[0][1], "s", 0.2), (902, "grobian " * 20000, None, None)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y, _ in rows] + [(None, 1, 1), (3, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    trains = lambda i: X.remainder(i, 5) != 0
    got = X.score(docs, X.train(docs, labels, trains)).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.5, rows[r.doc_id][2]) for r in got if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == bool(b) for a, b in held]) > 0.97
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] < 0.5 and by[902] >= 0.5
    assert X.score(docs.limit(0), X.train(docs, labels.limit(0), trains)).count() == 0


def test_held_out_accuracy_on_test_tables(spark):
    sf = "/root/testdata/sf0.1"
    got = X.op7_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n.get((1, 1), 0) / (n.get((1, 1), 0) + n.get((1, 0), 0)) > 0.9
    assert n.get((0, 1), 0) / (n.get((0, 0), 0) + n.get((0, 1), 0)) < 0.02


def test_remainder(spark):
    assert spark.range(3).select(X.remainder(F.col("id"), 5).alias("r")).collect()[2].r == zlib.crc32(b"2") % 5
