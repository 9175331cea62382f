"""Byte-level BPE by replaying the merges over a corpus of words.

Each task holds the distinct words (matches of the splitting pattern) of its documents as linked tokens, with
an inverted index from token pair to positions. Merges are applied in rank order, each at all its positions,
and touch only the neighbours there. Words don't influence each other, so a task's corpus gives what the whole
corpus would. Words met before are kept in a table of bounded size; nothing is shuffled.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framewright.llm.common import chunks, read, small_batches, trimmed

#: White space as Unicode has it; Python's \\s has four control characters besides.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers below U+02C2, for which the faster module re gives the same matches.
_LATIN = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u02c1"
_DIGITS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
#: Distinct words kept by a task; when they are more, the older half goes (a cost, never a different result).
WORDS_KEPT = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _patterns(pattern: str):
    import regex

    exact = pattern.replace("[^\\s", f"[^{_SPACE}").replace("\\S", f"[^{_SPACE}]").replace("\\s", f"[{_SPACE}]")
    fast = exact.replace("[^" + _SPACE + "\\p{L}\\p{N}]", f"[^{_SPACE}{_LATIN}{_DIGITS}]").replace("\\p{L}", f"[{_LATIN}]").replace("\\p{N}", f"[{_DIGITS}]")
    return re.compile(fast), regex.compile(exact), re.compile("[^\\x00-\\u02c1]")


class Merges:
    """The rank of every pair of tokens that a merge can join: a table for pairs of bytes, a dictionary for all."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, byte_ids: np.ndarray):
        """keys: left id << 32 | right id; ranks: id of the product."""
        self.rank = dict(zip(keys.tolist(), ranks.tolist(), strict=True))
        self.byte_ids = byte_ids
        self.of_bytes = np.array([[self.rank.get(a << 32 | b, NONE) for b in byte_ids.tolist()] for a in byte_ids.tolist()], dtype=np.int64)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Each way to cut a token into two tokens."""
        found = [(a << 32 | b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        return np.array([k for k, _ in found], dtype=np.uint64), np.array([r for _, r in found], dtype=np.int32)


#: Above every rank.
NONE = 2**31 - 1


def replay(words: list[bytes], merges: Merges, told=None) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, and where each word's begin, after every merge that applies.

    The corpus is one row of tokens, linked within words. The index has, for each pair that a merge joins (by
    its rank), the positions where the pair stands or stood. Merges are applied in rank order: each takes its
    positions from left to right, passes over those where the pair is gone, joins the others, and enters the pairs
    that the new token forms with its two neighbours. If one of those has a lower rank, it is next for its word,
    so the word's other positions wait. told(rank, positions) hears of each merge.
    """
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    n = len(raw)
    word = np.repeat(np.arange(len(words)), size)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank = np.full(n, NONE, dtype=np.int64)
    rank[inner] = merges.of_bytes[raw[inner], raw[inner + 1]]
    place = np.flatnonzero(rank < NONE)
    place = place[np.argsort(rank[place], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank[place], prepend=-1))
    index = {int(rank[p[0]]): p.tolist() for p in np.split(place, cuts[1:])} if len(place) else {}
    heap = sorted(index)
    right = np.arange(1, n + 1)
    left = np.arange(-1, n - 1)
    right[begin[1:][size > 0] - 1] = -1
    left[begin[:-1][size > 0]] = -1
    token, live = merges.byte_ids[raw], np.ones(n, dtype=bool)
    row = Row(token, left, right, rank, word, live, merges.rank.get, index, heap)
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        if told is not None:
            told(r, [i for i in sorted(places) if rank[i] == r])
        later = row.merge_many(r, places) if len(places) >= MANY else row.merge_few(r, places)
        if later:
            index[r] = later
            heapq.heappush(heap, r)
    total = np.concatenate([[0], np.cumsum(live)])
    return token[live], total[begin]


#: Positions of a pair from which on they are merged as arrays, not one by one.
MANY = 32


class Row:
    """The row of tokens of a replay with its links and index, changed by merges. Arrays, and views of them for single numbers."""

    def __init__(self, token, left, right, rank, word, live, rank_of, index: dict[int, list[int]], heap: list[int]):
        self.token, self.left, self.right, self.rank, self.word, self.live = token, left, right, rank, word, live
        self.views = tuple(map(memoryview, (token, left, right, rank, word, live)))
        self.rank_of, self.index, self.heap = rank_of, index, heap

    def enter(self, r: int, places: list[int]) -> None:
        held = self.index.get(r)
        if held is None:
            self.index[r] = places
            heapq.heappush(self.heap, r)
        else:
            held += places

    def merge_few(self, r: int, places: list[int]) -> list[int]:
        """Joins the pairs of rank r at the places; the places that wait for a lower rank in their word are given back."""
        token, left, right, rank, word, live = self.views
        rank_of, waits, later = self.rank_of, -1, []
        places.sort()
        for i in places:
            if rank[i] != r:
                continue
            if word[i] == waits:
                later.append(i)
                continue
            gone = right[i]
            after, before = right[gone], left[i]
            token[i], right[i], live[gone], rank[gone], rank[i] = r, after, False, NONE, NONE
            if after >= 0:
                left[after] = i
                new = rank_of(r << 32 | token[after], NONE)
                if new != NONE:
                    rank[i] = new
                    self.enter(new, [i])
                    if new < r:
                        waits = word[i]
            if before >= 0:
                new = rank[before] = rank_of(token[before] << 32 | r, NONE)
                if new != NONE:
                    self.enter(new, [before])
                    if new < r:
                        waits = word[i]
        return later

    def merge_many(self, r: int, places: list[int]) -> list[int]:
        """The same with arrays, for the first place of each word; the others are given back."""
        token, left, right, rank = self.token, self.left, self.right, self.rank
        p = np.sort(np.array(places, dtype=np.int64))
        p = p[rank[p] == r]
        if not len(p):
            return []
        w = self.word[p]
        first = np.append(True, w[1:] != w[:-1])
        later, p = p[~first].tolist(), p[first]
        gone = right[p]
        after, before = right[gone], left[p]
        token[p], right[p], self.live[gone], rank[gone], rank[p] = r, after, False, NONE, NONE
        to, come = after >= 0, before >= 0
        left[after[to]] = p[to]
        a, b = np.concatenate([p[to], before[come]]), np.concatenate([after[to], p[come]])
        keys, which = np.unique(token[a] << 32 | token[b], return_inverse=True)
        new = np.array([self.rank_of(k, NONE) for k in keys.tolist()], dtype=np.int64)[which] if len(keys) else np.zeros(0, np.int64)
        rank[a] = new
        a, new = a[new != NONE], new[new != NONE]
        order = np.argsort(new, kind="stable")
        a, new = a[order], new[order]
        begin = np.flatnonzero(np.append(True, new[1:] != new[:-1])) if len(new) else np.zeros(0, np.int64)
        flat = a.tolist()
        for x, y, q in zip(begin.tolist(), [*begin[1:].tolist(), len(flat)], new[begin].tolist(), strict=False):
            self.enter(q, flat[x:y])
        return later


class Encoder:
    """Encodes and decodes by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.said = {i: str(i) for i in ranks.values()}
        self.merges = Merges(*(Merges.of(ranks) if pairs is None else pairs), np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64))
        self.fast, self.exact, self.beyond = _patterns(pattern)
        self.known: dict[str, tuple[list[int], str]] = {}
        self.older: dict[str, tuple[list[int], str]] = {}

    def split(self, text: str) -> list[str]:
        if self.beyond.search(text):
            return [m.group() for m in self.exact.finditer(text)]
        return [m.group() for m in self.fast.finditer(text)] if self.fast.groups else self.fast.findall(text)

    def learn(self, words) -> None:
        """Adds ids, and ids as text, of words not seen before, all of them in one replay."""
        words, known = list(words), self.known
        raws = [word.encode() for word in words]
        whole = list(map(self.ranks.get, raws))
        known.update((word, ([r], self.said[r])) for word, r in zip(words, whole, strict=True) if r is not None)
        todo = [word for word, r in zip(words, whole, strict=True) if r is None]
        raws = [raw for raw, r in zip(raws, whole, strict=True) if r is None]
        if todo:
            ids, begin = replay(raws, self.merges)
            ids, begin = ids.tolist(), begin.tolist()
            said = list(map(self.said.__getitem__, ids))
            known.update(zip(todo, [(ids[a:b], ",".join(said[a:b])) for a, b in zip(begin, begin[1:], strict=False)], strict=True))

    def words(self, texts: list[str]) -> list[list[tuple[list[int], str]]]:
        """Ids of each text, word by word, as numbers and as text."""
        split = [self.split(t) for t in texts]
        seen = set().union(*split)
        if len(self.known) > WORDS_KEPT // 2:
            self.known, self.older = {}, self.known
        new = seen.difference(self.known)
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        self.learn(new - again)
        get = self.known.__getitem__
        return [list(map(get, words)) for words in split]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for ids, _ in words for i in ids] for words in self.words(texts)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "token_ids", checked: bool = False) -> DataFrame:
    """df with ids_col, the token ids of text_col (array<int>; null and empty texts have none).

    checked: every text's ids are decoded where they are made, and a text that they don't give stops the job.

    Any other columns pass unchanged; one named ids_col is replaced. Very long texts are encoded whole, rows
    that repeat are each encoded, an empty table stays empty. ranks must hold all 256 single bytes.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = df.drop(ids_col)
    shared = spark.sparkContext.broadcast((ranks, pattern, Merges.of(ranks)))  # a vocabulary, a few MB; its size doesn't depend on the data
    where = df.columns.index(text_col)

    def run(batches):
        encoder = Encoder(*shared.value)
        for batch in chunks(batches, text_col, 2_000_000):
            texts = [t or "" for t in batch.column(where).to_pylist()]
            ids = encoder.encode(texts)
            if checked and any(encoder.decode(own) != text.encode() for own, text in zip(ids, texts, strict=True)):
                raise ValueError("ids don't decode to the text")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, type=pa.list_(pa.int32()))], names=[*batch.schema.names, ids_col])

    return df.mapInArrow(trimmed(run), T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ranks: dict[bytes, int], ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col, the bytes that ids_col stands for (binary; null ids give no bytes). A column named bytes_col is replaced."""
    spark = df.sparkSession
    df = df.drop(bytes_col)
    shared = spark.sparkContext.broadcast({i: b for b, i in ranks.items()})
    where = df.columns.index(ids_col)

    def run(batches):
        get = shared.value.__getitem__
        for batch in batches:
            out = [b"".join(map(get, ids or ())) for ids in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.binary())], names=[*batch.schema.names, bytes_col])

    return df.mapInArrow(trimmed(run), T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What encode and then decode give, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A row for each row of df, null and empty texts with 0 tokens; ids and bytes never leave their task.
    """
    spark = df.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((ranks, pattern, Merges.of(ranks)))

    def run(batches):
        encoder = Encoder(*shared.value)
        gc.disable()  # the table of words has no cycles; walking it again and again would cost more than all else
        for batch in chunks(batches, text_col, 2_000_000):
            n, ids_hash, bytes_hash = [], [], []
            for words in encoder.words([t or "" for t in batch.column(1).to_pylist()]):
                ids = [i for own, _ in words for i in own]
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join([said for _, said in words]).encode()).hexdigest())
                bytes_hash.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(bytes_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        gc.enable()

    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}`").mapInArrow(trimmed(run), DIGESTS)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
