import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import minhash as M
from framewright.llm.common import utf8


def words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower())


def sets(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Class of each row by all pairs of distinct texts."""
    nodes = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        nodes[tuple(words(t)) or (t or "")].append(k)
    keys = list(nodes)
    shingled = [sets(rows[nodes[k][0]][1]) for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            a, b = shingled[i], shingled[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                root[find(i)] = find(j)
    group = defaultdict(list)
    for i, k in enumerate(keys):
        group[find(i)] += nodes[k]
    out = []
    for members in group.values():
        ids = [rows[m][0] for m in members if rows[m][0] is not None]
        for m in members:
            n = len(nodes[tuple(words(rows[m][1])) or (rows[m][1] or "")])
            out.append((rows[m][0], min(ids, default=None), len(members), n))
    return sorted(out, key=str)


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=0, bases=25, near=6):
    rng = random.Random(seed)
    rows = []
    for b in range(bases):
        base = " ".join(f"w{rng.randrange(2000)}" for _ in range(rng.randrange(60, 300)))
        rows.append(base)
        rows += [edited(base, rng, rng.randrange(1, 1 + len(base.split()) // 60)) for _ in range(rng.randrange(near))]
        rows += [base] * rng.randrange(3) + [base.upper().replace(" ", ", ")] * rng.randrange(2)
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 900, dtype=np.uint64)
    wa, wb = rng.integers(1, 4, 700).astype(float), None
    wb = np.concatenate([wa[200:], rng.integers(1, 4, 200).astype(float)])
    a, b = h[:700], h[200:]
    m = 4000
    ra = M.prob_minhash(a, wa, np.array([0, 700]), m)[0]
    rb = M.prob_minhash(b, wb, np.array([0, 700]), m)[0]
    x, y = dict(zip(a, wa / wa.sum())), dict(zip(b, wb / wb.sum()))
    keys = set(x) | set(y)
    jp = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in keys if i in x and i in y)
    assert abs((ra == rb).mean() - jp) < 0.03


def test_shingles_against_sets():
    texts = ["", "a", "A b", "a b c d e f a b c d e", None, "*** !!", "ünï códe x y z w", "a b c d e"]
    data, at = utf8(pa.array(texts))
    h, count, first, node, check = M.shingles(data, at)
    for i, t in enumerate(texts):
        assert first[i + 1] - first[i] == len(sets(t))
        assert count[first[i] : first[i + 1]].sum() == (max(1, len(words(t)) - 4) if words(t) else 0)
    assert node[0] == node[4] and node[0] != node[5] and set(h[first[7] : first[8]]) <= set(h[first[3] : first[4]]) and len(set(zip(node, check))) == 7


def test_classes_against_all_pairs(spark):
    rows = corpus()
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE, two!"), (5004, "***"), (5005, "***"), (5006, "###"), (None, rows[0][1]), (None, "a text of nobody at all here"), (3, rows[3][1]), (5007, "long " * 30000), (5008, "long " * 30001)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, class_id int, node string")
    assert sorted((tuple(r) for r in M.classes(df).collect()), key=str) == brute(rows)


def test_chains_and_one_large_group(spark):
    rng = random.Random(2)
    base = " ".join(f"b{rng.randrange(10**6)}" for _ in range(400))
    rows = [(i, edited(base, rng, 3)) for i in range(300)]
    step = base
    for i in range(12):  # each near the one before, the ends far apart
        step = edited(step, rng, 6)
        rows.append((1000 + i, step))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in M.classes(df).collect()), key=str) == brute(rows)


def test_empty_table_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_IDS", 0)
    rows = corpus(4, 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert M.classes(df.limit(0)).count() == 0
    assert sorted((tuple(r) for r in M.classes(df).collect()), key=str) == brute(rows)


def family(rng, n, pairs):
    """Texts that share a long passage, alike at 0.6 to 0.75, and after them near copies of a few."""
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(160))
    texts = [shared + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(28, 50))) for _ in range(n)]
    for t in texts[:pairs]:
        texts.append(" ".join([*t.split()[:-19], *(f"p{rng.randrange(10**6)}" for _ in range(19))]))
    return texts


@pytest.mark.parametrize("small", [0, 32, 10**6])
def test_pairs_within_a_family_of_alike_texts(spark, monkeypatch, small):
    """By prefixes, by both ways, and by meeting."""
    monkeypatch.setattr(M, "SMALL", small)
    rows = list(enumerate(family(random.Random(5), 400, 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(r[2] > 1 for r in want) == 2
    assert sorted((tuple(r) for r in M.classes(df, bands=4, rows=1).collect()), key=str) == want
    if small == 32:
        assert sorted((tuple(r) for r in M.classes(df).collect()), key=str) == want


def test_pairs_whose_counts_differ(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6):
        body = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
        line = " ".join(f"l{rng.randrange(10**6)}" for _ in range(10)) + ". "
        rows += [(2 * i, line * 200 + body), (2 * i + 1, line * 2 + body)]
    want = brute(rows)
    assert all(r[1:3] == (r[0] // 2 * 2, 2) for r in want)
    assert sorted((tuple(r) for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == want


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        both, a, b = (rng.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32) for n in rng.integers(0, 200, 3))
        x, y = np.union1d(both, a), np.union1d(both, b)
        apart = np.bitwise_count((M.parities(x) ^ M.parities(y)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(x, y)) and (apart > 0 or len(np.setxor1d(x, y)) != 1)
