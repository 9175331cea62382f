import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from framewright.llm import byte_bpe as B

RANKS = B.load_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world's  don't I'll  ", "été à l'œuvre ñandú 123 4½ ²", "日本語 テスト 한국어 ١٢٣", "a" * 3000, "\x1c\x1d x\x1e\x1fy", "🎉🎉 <|endoftext|> 　 z",
    "ababababab abcabcabc aaaaaaaaab", "the " * 5000, "é" * 999, "&&&***$$$%%%### tion", "\r\n\r\n  end\x85 a\xa0b",
]


def replayed(words, ranks):
    ids, begin = B.replay(words, B.Merges(*B.Merges.of(ranks), np.array([ranks[bytes([i])] for i in range(256)])))
    return [tuple(ids[a:b].tolist()) for a, b in zip(begin, begin[1:])]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_same_ids_as_library(library):
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdetion é\n'sñ1ß") for _ in range(rng.randrange(200))) for _ in range(400)]
    encoder = B.Encoder(RANKS, P.PATTERN)
    for text, words in zip(texts, encoder.encode(texts), strict=True):
        ids = words
        assert ids == library.encode_ordinary(text), text[:50]
        assert encoder.decode(ids) == text.encode()


def test_lower_rank_created_by_a_merge():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"xab": 260, b"cx": 400}
    words = [b"xabab", b"abxab", b"cxab"]

    def slow(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return tuple(ranks[p] for p in parts)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    assert replayed(words, ranks) == [slow(w) for w in words]


def test_replay_against_slow_on_random_words():
    rng = random.Random(3)
    words = ["".join(rng.choice("thereing") for _ in range(rng.randrange(1, 14))).encode() for _ in range(500)]

    def slow(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS), default=None)
            if best is None:
                return tuple(RANKS[p] for p in parts)
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    assert replayed(words, RANKS) == [slow(w) for w in words]


def test_table_of_words_starts_anew(monkeypatch, library):
    monkeypatch.setattr(B, "WORDS_KEPT", 3)
    encoder = B.Encoder(RANKS, P.PATTERN)
    for text in ("one two three four five", "six one seven", "one two"):
        assert encoder.encode([text])[0] == library.encode_ordinary(text)


def test_round_trip_and_extra_columns(spark, library):
    rows = [(i, t, "clash", [1.0]) for i, t in enumerate(TEXTS)] + [(0, "again", "x", None), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, decoded array<double>")
    back = B.decode(B.encode(df, RANKS, P.PATTERN), RANKS).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.token_ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.digests(df, RANKS, P.PATTERN).collect()}
    want = set()
    for i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert B.digests(df.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("many", [1, 10**9])
def test_arrays_and_single_places_agree(monkeypatch, many):
    rng = random.Random(8)
    words = [bytes(rng.choice(b"abcnot ei") for _ in range(rng.randrange(1, 40))) for _ in range(400)] + [b"a" * n for n in range(1, 40)]
    want = replayed(words, RANKS)
    monkeypatch.setattr(B, "MANY", many)
    assert replayed(words, RANKS) == want


def test_index_merges_in_rank_order_at_all_positions():
    """Each merge is told once a pass, in rank order unless a lower one came up, with every position where its pair stands."""
    words = [b"hello", b"hello", b"yellow", b"aaaaa", b"abab" * 4]
    merges, said = B.Merges(*B.Merges.of(RANKS), np.array([RANKS[bytes([i])] for i in range(256)])), []
    ids, begin = B.replay(words, merges, lambda r, places: said.append((r, places)))
    tokens = {i: bytes([b]) for i, b in enumerate(b"".join(words))}
    back = {r: t for t, r in RANKS.items()}
    for r, places in said:
        for i in places:
            if back[r].startswith(tokens.get(i, b"-")) and len(tokens[i]) < len(back[r]):
                j = i + len(tokens[i])
                if tokens.get(j, b"-") == back[r][len(tokens[i]):]:
                    tokens[i] = back[r]
                    del tokens[j]
    assert [RANKS[tokens[i]] for i in sorted(tokens)] == ids.tolist()
    first = [r for r, _ in said]
    assert first[0] == min(first)
