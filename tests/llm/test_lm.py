import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import lm as M
from framewright.llm.toxicity import remainder

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("n,limit", [(0, 1), (1, 1), (1, 2**40), (5, 5), (1000, 2000), (1000, 2**63), (3000, 10**9)])
def test_elias_fano(n, limit):
    values = np.unique(RNG.integers(0, limit, n, dtype=np.uint64)) if n else np.zeros(0, np.uint64)
    words = np.concatenate([np.ascontiguousarray(x).view(np.uint64) for x in M.EliasFano.of(values, limit).dump()])
    ef, end = M.EliasFano.load(words, 0)
    assert end == len(words)
    if len(values):
        assert (ef.at(np.arange(len(values))) == values).all()
        assert (ef.find(values) == np.arange(len(values))).all()
    other = RNG.integers(0, limit, 500, dtype=np.uint64)
    want = np.where(np.isin(other, values), np.searchsorted(values, other), -1)
    assert (ef.find(other) == want).all()


def test_elias_fano_is_compact_and_takes_repeats():
    values = np.sort(RNG.integers(0, 2**40, 20000, dtype=np.uint64))
    size = sum(x.nbytes for x in M.EliasFano.of(values, 2**40).dump())
    assert size * 8 / 20000 < math.log2(2**40 / 20000) + 5
    repeated = np.array([0, 0, 3, 3, 3, 9], dtype=np.uint64)
    assert (M.EliasFano.of(repeated, 10).at(np.arange(6)) == repeated).all()


def test_codes_never_round_up():
    p = RNG.random(1000) ** 6 + 1e-9
    back = M._DECODED[M.encode_p(p)]
    assert (back <= p * (1 + 1e-9)).all() and (back > 0.9 * p).all() and M.encode_p(np.zeros(1))[0] == 0


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)] + [None]


def brute(rows):
    """base_score and score by dictionaries, without codes of probabilities."""
    train = [tokens(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    one = Counter(w for t in train for w in t)
    two = Counter((a, b) for t in train for a, b in zip([None, *t[:-1]], t))
    n, v = sum(one.values()), len(one)
    out = []
    for i, text in rows:
        t = tokens(text)
        base = [(one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in t]
        bigram = []
        for a, b, p in zip([None, *t[:-1]], t, base):
            if one[a]:
                q = two[a, b] / (one[a] + M.MU)
                code = 1 + math.ceil(-math.log10(q) * M.STEPS - 1e-9) if q else 0
                bigram.append((10 ** (-(min(code, 255) - 1) / M.STEPS) if code else 0) + M.MU / (one[a] + M.MU) * p)
            else:
                bigram.append(p)
        fits = [math.log(w) + sum(math.log((1 - x) * p + x * q) for p, q in zip(base, bigram)) for x, w in zip(M.LAMBDAS, M.PRIOR)]
        top = max(fits)
        out.append((i, len(t), sum(one[w] > 0 for w in t), n, sum(map(math.log10, base)), (top + math.log(sum(math.exp(f - top) for f in fits))) / math.log(10)))
    return out


def rows_for_tests():
    rng = random.Random(4)
    words = [rng.choice("abcdé") * rng.randrange(1, 4) + str(rng.randrange(60)) for _ in range(200)] + ["The", "the"] * 30
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, " \n\t "), (203, "the " * 5000), (7, rows[7][1]), (None, "a null id"), (204, "É x\x1cy A\x0bB")]


@pytest.mark.parametrize("hot", [1 / 2000, 1e-9])
def test_scores_against_dictionaries(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "PACK_BYTES", 700)
    monkeypatch.setattr(M, "SHARD_BYTES", 400 if hot < 1e-6 else 16_000_000)
    monkeypatch.setattr(M, "HOT_SHARE", hot)
    rows = rows_for_tests()
    df = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, pack string")
    got = sorted((tuple(r) for r in M.score(df, lambda i: remainder(i, 5) != 1).select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-8 * max(1, abs(w[4])) and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])), (g, w)
        assert g[5] >= g[4] - math.log10(2) - 1e-9


def test_empty_tables_and_no_training(spark):
    df = spark.createDataFrame(rows_for_tests()[:9], "doc_id long, text string")
    assert M.score(df.limit(0), lambda i: remainder(i, 5) != 1).count() == 0
    from pyspark.sql import functions as F

    none = M.score(df, lambda i: F.lit(False)).collect()
    assert len(none) == 9 and all(r.n_known == r.train_tokens == 0 and abs(r.base_score) < 1e-12 for r in none)


def test_repeated_text_scores_better_than_base(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(300)}" for _ in range(400))
    df = spark.createDataFrame([(i, text if i in (2, 3) else " ".join(f"w{rng.randrange(300)}" for _ in range(400))) for i in range(40)], "doc_id long, text string")
    got = {r.doc_id: r.score - r.base_score for r in M.score(df, lambda i: i != 3).collect()}
    assert got[3] > 100


def test_counts_beyond_32_bits():
    """Two packs that ask for the same two words; one word's counts add up to more than 4 bytes hold."""
    keys, successors = np.array([5, 9], np.uint64), np.array([7], np.uint32)
    bits = lambda dtype, *v: np.array(v, dtype).tobytes()
    packs = [(0, name, keys.tobytes(), bits(np.uint32, 3 * 10**9, 4), bits(np.uint32, 1, 0), successors.tobytes(), bits(np.uint32, 2 * 10**9)) for name in ("a", "b")]
    names = [x.split()[0] for x in M.REQUESTS.split(", ")]
    got = M.answer(None, pa.table({n: list(c) for n, c in zip(names, zip(*packs, strict=True), strict=True)})).to_pylist()
    assert [r["pack"] for r in got] == ["a", "b", None] and got[2]["known"] == 2
    for r in got[:2]:
        assert M.counts_in(r["counts"]).tolist() == [6 * 10**9, 8]
        assert M._DECODED[r["codes"][0]] == pytest.approx(4 / 6, rel=0.1)
    for counts in ([], [0, 2**32 - 1], [2**32, 1]):
        raw = M.counts_out(np.array(counts, np.int64))
        assert M.counts_in(raw).tolist() == counts and len(raw) == 1 + len(counts) * (8 if 2**32 in counts else 4)
