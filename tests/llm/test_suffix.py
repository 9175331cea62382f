import random
import re

import numpy as np
import pytest

from framewright.llm import suffix as S


def words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower())


def brute(rows, n):
    """Words of each row covered by windows of n words that another row has."""
    where = {}
    for k, (_, t) in enumerate(rows):
        w = words(t)
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), set()).add(k)
    out = {}
    for k, (_, t) in enumerate(rows):
        w, covered = words(t), set()
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                covered |= set(range(i, i + n))
        if covered:
            out[k] = covered
    return out


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    say = lambda m: " ".join(f"{rng.choice('abcde')}{rng.randrange(3000)}" for _ in range(m))
    passages = [say(rng.randrange(50, 180)) for _ in range(8)] + [say(50), say(51), say(49)]
    rows = []
    for i in range(n):
        parts = [say(rng.randrange(5, 80))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), say(rng.randrange(0, 30))]
        rows.append((i, ". ".join(parts)))
    return rows


def covered(df, rows):
    out = {}
    for r in df.collect():
        if r.doc_id is not None:
            out.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= 50
    return out


def test_minimisers_by_hand():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 30, 400).astype(np.uint64)
    text = np.sort(rng.integers(0, 40, 400))
    want = {}
    for t in range(40):
        at = np.flatnonzero(text == t)
        for i in range(len(at) - 7):
            own = int(max(at[i : i + 8], key=lambda x: (-int(h[x]), x)))
            want.setdefault(own, []).append(own - int(at[i]))
    picked, low, high = S.minimisers(h, text, 8)
    assert {p: (a, b) for p, a, b in zip(picked.tolist(), low.tolist(), high.tolist())} == {p: (min(x), max(x)) for p, x in want.items()}


def test_spans_against_all_windows(spark):
    rows = corpus()
    rows += [(900, None), (901, ""), (902, rows[5][1]), (903, "to " * 20000), (904, "fro " * 300 + "to " * 500)]
    df = spark.createDataFrame([(i, t, True, "x") for i, t in rows], "doc_id long, text string, first boolean, gram string")
    got = covered(S.repeated(df), rows)
    assert got == {rows[k][0]: c for k, c in brute(rows, 50).items()}


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_one_passage_in_many_documents(spark, monkeypatch, bound):
    monkeypatch.setattr(S, "BROADCAST_GRAMS", bound)
    rng = random.Random(1)
    hot = " ".join(f"h{rng.randrange(9999)}" for _ in range(70))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) + " " + hot) for i in range(200)]
    out = S.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id for r in out} == set(range(200)) and {(r.start_word, r.end_word) for r in out} == {(20, 90)}
    assert [r.doc_id for r in out if r.first] == [0]
    text = {r.doc_id: r.text for r in S.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert text[0] == rows[0][1] and sum("h" in t for t in text.values()) == 1
    assert text[5].strip() == " ".join(rows[5][1].split()[:20])


def test_cut_keeps_everything_once(spark):
    rows = corpus(3)
    rows += [(900, None), (901, ""), (None, rows[2][1])]
    df = spark.createDataFrame([(i, t, "en", 7, [1]) for i, t in rows], "doc_id long, text string, lang string, n_chars int, doc array<int>")
    out = {r.doc_id: r for r in S.cut(df).collect()}
    assert len(out) == len(rows) and out[900].text is None and out[901].text == "" and out[3].doc == [1]
    grams = lambda texts: {tuple(w[i : i + 50]) for w in map(words, texts) for i in range(len(w) - 49)}
    left = [tuple(w[i : i + 60]) for r in out.values() for w in [words(r.text)] for i in range(len(w) - 59)]
    before = [tuple(w[i : i + 60]) for _, t in rows for w in [words(t)] for i in range(len(w) - 59)]
    assert len(left) - len(set(left)) < 0.02 * (len(before) - len(set(before)))
    lost = grams(t for _, t in rows) - grams(r.text for r in out.values())
    own = [grams([t]) for _, t in rows]
    inside = [g for g in lost if sum(g in x for x in own) > 1]
    assert len(inside) < 0.02 * len(grams(t for _, t in rows))
    found = {r.doc_id for r in S.repeated(df).collect()}
    untouched = [i for i, t in rows if i is not None and i not in found]
    assert all(out[i].text == dict(rows)[i] for i in untouched)


def test_within_a_document(spark):
    rng = random.Random(7)
    p = " ".join(f"q{rng.randrange(9999)}" for _ in range(60))
    df = spark.createDataFrame([(1, f"{p} aa bb cc {p}")], "doc_id long, text string")
    assert S.repeated(df).count() == 0
    assert sorted((r.start_word, r.end_word, r.first) for r in S.repeated(df, within=True).collect()) == [(0, 60, True), (63, 123, False)]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.repeated(df).count() == 0 and S.cut(df).count() == 0


def test_all_holders_are_linked_to_the_least(spark):
    rng = random.Random(4)
    hot = " ".join(f"h{rng.randrange(9999)}" for _ in range(70))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) + " " + hot) for i in range(60)]
    root = list(range(60))
    for r in S.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        root[r.doc_id] = min(root[r.doc_id], r.partner)
        assert r.partner != r.doc_id and r.first == (r.doc_id == 0)
    assert all(root[i] < i for i in range(1, 60))


@pytest.mark.parametrize("slab,parts", [(16_384, 4), (1, 40)])
def test_longer_matches_on_either_side_hide_none(spark, monkeypatch, slab, parts):
    """x and B share 52 words; six texts share more words to the right with x, six more to the left."""
    monkeypatch.setattr(S, "SLAB", slab)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rng = random.Random(9)
    say = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, hidden = [], []
    for case in range(30):
        gram, left, right = say(12), say(38), say(38)
        pad = lambda: say(40)
        x = pad() + left + gram + right + pad()
        b = pad() + say(18) + left[-20:] + gram + right[:20] + say(18) + pad()
        family = [pad() + say(38) + gram + right[:30] + pad() for _ in range(6)] + [pad() + left[-30:] + gram + say(38) + pad() for _ in range(6)]
        for text in (x, b, *family):
            rows.append((len(rows), " ".join(text)))
        hidden.append((len(rows) - 14, len(rows) - 13))
    rng.shuffle(rows)
    try:
        got = covered(S.repeated(spark.createDataFrame(rows, "doc_id long, text string")), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert got == {rows[k][0]: c for k, c in brute(rows, 50).items()}
    assert all(len(got[i]) >= 52 for pair in hidden for i in pair)


def test_families_of_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(S, "SLAB", 64)
    rng = random.Random(11)
    rows = []
    for _ in range(4):
        base = [f"e{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randrange(1, 9)):
                own[rng.randrange(400)] = f"n{rng.randrange(10**7)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert covered(S.repeated(df), rows) == brute(rows, 50)
    # The occurrence to keep is the one with the least id, window by window.
    later = {}
    for r in S.spans(df, later_only=True).collect():
        later.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen, want = set(), {}
    for i, t in rows:
        w = words(t)
        own = [tuple(w[a : a + 50]) for a in range(len(w) - 49)]
        for a, g in enumerate(own):
            if g in seen:
                want.setdefault(i, set()).update(range(a, a + 50))
        seen.update(own)
    assert later == want


def test_sf_table_against_all_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert covered(S.repeated(docs), rows) == {rows[k][0]: c for k, c in brute(rows, 50).items()}
