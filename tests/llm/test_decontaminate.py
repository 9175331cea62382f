import math
import random
import re
from collections import Counter

from framewright.llm import decontaminate as D


def words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower())


def scores(items, passage):
    """BM25 of each item for the passage's distinct words, over the item's own."""
    docs = [words(t) for t in items]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))

    def score(d, query):
        tf = Counter(d)
        return sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (D.K1 + 1) / (tf[w] + D.K1 * (1 - D.B + D.B * len(d) / mean)) for w in set(query) if w in tf)

    return [score(d, passage) / score(d, d) if d else 0 for d in docs]


def make_items(rng, n):
    return [" ".join(rng.choice("alpha beta the of and gamma delta".split()) if rng.random() < 0.4 else f"w{rng.randrange(800)}" for _ in range(rng.randrange(6, 40))) for _ in range(n)]


def test_search_against_all_items():
    rng = random.Random(0)
    items = make_items(rng, 150)
    index = D.Index(list(range(150)), [D.split_item(t)[0] for t in items], [D.split_item(t)[1] for t in items])
    for trial in range(60):
        passage = words(" ".join(rng.sample(items, rng.randrange(1, 4))) if trial % 2 else " ".join(f"w{rng.randrange(800)}" for _ in range(60)))
        rng.shuffle(passage)
        passage = passage[: rng.randrange(1, len(passage) + 1)]
        want = {i: s for i, s in enumerate(scores(items, passage)) if s >= 0.3}
        number = index.find(D._hashes(b" ".join(passage).decode()))
        got = dict(index.search(sorted(set(number[number >= 0].tolist())), 0.3))
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def brute(rows, items):
    """Pairs whose question and answer have 0.8 of their shingles in the text."""
    def sh(w):
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    out = set()
    for i, text in rows:
        t = words(text)
        have = {n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)} for n in range(1, 6)}
        for j, item in items:
            parts = [sh(words(p)) for p in D.split_item(item or "")]
            if any(parts) and all(not p or sum(s in have[len(s)] for s in p) >= 0.8 * len(p) - 1e-9 for p in parts):
                out.add((i, j))
    return out


def data(seed=1):
    rng = random.Random(seed)
    items = list(enumerate(make_items(rng, 50))) + [(60, "What is the w1 of w2? w3 w4"), (61, "tiny"), (62, ""), (63, None), (60, "What is the w1 of w2? w3 w4")]
    rows = []
    for i in range(150):
        text = [f"w{rng.randrange(800)}" if rng.random() < 0.5 else rng.choice("the of and alpha beta".split()) for _ in range(rng.randrange(0, 300))]
        if i % 3 == 0:
            at = rng.randrange(len(text) + 1)
            text[at:at] = (items[rng.randrange(50)][1]).upper().split()
        rows.append((i, " ".join(text)))
    return rows, items


def test_documents_against_brute_force(spark):
    rows, items = data()
    rows += [(500, None), (501, ""), (502, items[3][1]), (503, "tiny"), (504, "filler " * 50000 + items[7][1]), (505, "so what is the w1 of w2? w3 w4!"), (505, "again: what is the w1 of w2? w3 w4!"), (None, items[5][1])]
    df = spark.createDataFrame([(i, t, "x", 0.1) for i, t in rows], "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame([(j, t, "y") for j, t in items], "item_id long, text string, doc_id string")
    got = D.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(rows, items) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    assert (503, 61) in {(r.doc_id, r.item_id) for r in got}
    kept = D.clean(df, bench).collect()
    bad = {i for i, _ in brute(rows, items)}
    assert sorted((r.doc_id for r in kept), key=str) == sorted((i for i, _ in rows if i not in bad), key=str) and kept[0].item_id == "x"


def test_groups_of_items_and_empty_tables(spark, monkeypatch):
    rows, items = data(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(df.limit(0), bench).count() == D.contaminated(df, bench.limit(0)).count() == 0
    monkeypatch.setattr(D, "INDEX_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == brute(rows, items)


def test_question_and_answer_columns(spark):
    df = spark.createDataFrame([(1, "the capital of w1 is w2 as is known"), (2, "the capital of w1 is unknown here")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "the capital of w1 is", "w2")], "item_id long, question string, answer string")
    got = D.contaminated(df, bench, question_col="question", answer_col="answer").collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 7)]


def test_items_without_answer_and_one_edit(spark):
    rng = random.Random(9)
    items = [(j, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for j, n in enumerate((32, 40, 54))] + [(3, "which w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20? a1 a2 a3 a4 a5 a6")]
    rows = []
    for j, t in items:
        w = t.split()
        rows += [(10 * j, " ".join([*w[:-3], "edited", *w[-2:]])), (10 * j + 1, " ".join(w[: -len(w) // 8])), (10 * j + 2, " ".join(w[: len(w) // 2]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10 * j + e, j) for j in range(3) for e in range(2)}
