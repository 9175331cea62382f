"""Language-model scores from an Elias-Fano n-gram trie that is spread over shards.

Documents are packed, a few MB a pack. A pack asks for what it needs: its distinct words, and for each word as
context its distinct successors, with the pack's training counts of both. Requests go to shards by the hash
of the context. A shard sums the counts of all packs, builds its trie, and answers every pack from it.

A shard's trie has two levels. Contexts: sorted hashes, Elias-Fano coded, with counts and monotone pointers to
their successors. Successors: 32-bit hashes that are made monotone by their context's number, Elias-Fano
coded, with the smoothed probability in 8 bits. A successor is searched relative to its context, in the one
bucket of high bits that can hold it. All levels are flat arrays in one block of bytes that is mapped, not
parsed.

Model: p(w | v) = c(v, w) / (c(v) + MU) + MU / (c(v) + MU) * base(w), mixed with base(w) in the proportions
LAMBDAS; a text's probability is the average over LAMBDAS, so it adapts to the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import SPACED, Words, binaries, chunks, lists, mix, read, stage, utf8
from framewright.llm.toxicity import remainder

#: Text bytes of a pack and, about, of the corpus behind a shard.
PACK_BYTES, SHARD_BYTES = 2_000_000, 16_000_000
#: Pseudo-count of the lower order; proportions of the bigram model in the mixture, and their prior weights.
MU = 1.0
LAMBDAS = (0.0, 0.1, 0.3, 0.6, 0.9, 0.99)
PRIOR = (0.5, 0.1, 0.1, 0.1, 0.1, 0.1)
#: The code of a probability p is 1 + ceil(-log10(p) * STEPS); rounding up keeps the sum of the coded probabilities at most 1.
STEPS = 25.0
#: The token at a text's end, and the context of its first word.
END = np.uint64(0x5EED0E4D5EED0E4D)
#: Contexts with at least this share of a pack's tokens are counted as possibly hot.
HOT_SHARE = 1 / 2000


# ---- Elias-Fano ---------------------------------------------------------------------------------------------


class EliasFano:
    """A sorted sequence of n integers below 2^bits as low bits, and high bits in unary.

    Buffers: low (n times `low` bits, packed), high (a bit for each value and for each bucket), and counts of
    ones before each word of high. at(i) selects, find(x, a, b) searches.
    """

    def __init__(self, n: int, low: int, buckets: int, lows: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low, self.buckets = n, low, buckets
        self.lows, self.high, self.ones = lows, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray, limit: int) -> EliasFano:
        """values: sorted uint64 below limit."""
        n = len(values)
        low = max(0, int(max(1, limit) // max(1, n)).bit_length() - 1)
        buckets = (max(0, limit - 1) >> low) + 1
        high_part = (values >> np.uint64(low)).astype(np.int64)
        bits = np.zeros(-(-(n + buckets + 1) // 64) * 64, dtype=np.uint8)
        bits[high_part + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.zeros(len(high) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls(n, low, buckets, _pack(values & np.uint64((1 << low) - 1), low), high, ones)

    def dump(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low, self.buckets, len(self.lows), len(self.high)], dtype=np.int64), self.lows, self.high, self.ones]

    @classmethod
    def load(cls, words: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, low, buckets, n_low, n_high = (int(x) for x in words[at : at + 5].view(np.int64))
        at += 5
        lows, at = words[at : at + n_low], at + n_low
        high, at = words[at : at + n_high], at + n_high
        ones, at = words[at : at + n_high + 1].view(np.int64), at + n_high + 1
        return cls(n, low, buckets, lows, high, ones), at

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the k-th ones or zeros, from 0."""
        before = self.ones if one else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        left = (k - before[word]).astype(np.int64)
        w = self.high[np.minimum(word, len(self.high) - 1)]
        if not one:
            w = ~w
        at = np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            n = np.bitwise_count((w >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= n
            left -= np.where(up, n, 0)
            at += np.where(up, width, 0)
        return word * 64 + at

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(self.low)) | _unpack(self.lows, self.low, i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, -1 where it is not there; only indices in [first, last) are looked at, if given."""
        out = np.full(len(x), -1, dtype=np.int64)
        if not self.n or not len(x):
            return out
        bucket = (x >> np.uint64(self.low)).astype(np.int64)
        begin = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), False) - bucket + 1, 0)
        end = self._select(bucket, False) - bucket
        if first is not None:
            begin, end = np.maximum(begin, first), np.minimum(end, last)
        want = x & np.uint64((1 << self.low) - 1)
        todo = np.flatnonzero(begin < end)
        begin = begin.copy()
        while len(todo):
            mid = (begin[todo] + end[todo]) // 2
            v = _unpack(self.lows, self.low, mid)
            out[todo[v == want[todo]]] = mid[v == want[todo]]
            less = v < want[todo]
            begin[todo[less]] = mid[less] + 1
            end[todo[~less]] = mid[~less]
            todo = todo[(begin[todo] < end[todo]) & (out[todo] < 0)]
        return out


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """values below 2^bits, one after the other."""
    out = np.zeros((len(values) * bits + 63) // 64 + 1, dtype=np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        v = values.astype(np.uint64)
        _or_into(out, word, v << shift)
        over = shift.astype(np.int64) + bits > 64
        _or_into(out, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return out


def _or_into(out: np.ndarray, word: np.ndarray, v: np.ndarray) -> None:
    if len(word):
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[begin]] |= np.bitwise_or.reduceat(v, begin)


def _unpack(words: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), dtype=np.uint64)
    at = i * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    v = words[word] >> shift
    over = shift.astype(np.int64) + bits > 64
    v[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return v & np.uint64((1 << bits) - 1)


class Trie:
    """Contexts and successors of a shard, over one block of bytes."""

    def __init__(self, block: bytes):
        words = np.frombuffer(block, dtype=np.uint64)
        self.base = words[0]
        self.keys, at = EliasFano.load(words, 1)
        self.pointers, at = EliasFano.load(words, at)
        self.successors, at = EliasFano.load(words, at)
        n = self.keys.n
        self.counts, at = words[at : at + n].view(np.int64), at + n
        self.codes = words[at:].view(np.uint8)[: self.successors.n]

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, degree: np.ndarray, successors: np.ndarray, pair_counts: np.ndarray) -> bytes:
        """keys: sorted; counts: of each as context; degree: successors of each; then all successors, sorted within their context."""
        base = keys[0] if len(keys) else np.uint64(0)
        span = int(keys[-1] - base) + 1 if len(keys) else 1
        owner = np.repeat(np.arange(len(keys), dtype=np.uint64), degree)
        pointers = np.concatenate([[0], np.cumsum(degree)]).astype(np.uint64)
        codes = encode_p(pair_counts / (counts[owner.astype(np.int64)] + MU)) if len(owner) else np.zeros(0, np.uint8)
        parts = [np.array([base], dtype=np.uint64)]
        for values, limit in ((keys - base, span), (pointers, len(owner) + 1), ((owner << np.uint64(32)) | successors.astype(np.uint64), len(keys) << 32)):
            parts += EliasFano.of(values, limit).dump()
        parts.append(counts.astype(np.int64))
        return b"".join(np.ascontiguousarray(p).tobytes() for p in parts) + codes.tobytes() + bytes(-len(codes) % 8)

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of contexts."""
        low = keys >= self.base
        ok = low & ((keys - self.base) <= np.uint64(max(0, (self.keys.buckets << self.keys.low) - 1)))
        number = np.full(len(keys), -1, dtype=np.int64)
        number[ok] = self.keys.find(keys[ok] - self.base)
        return number, np.where(number >= 0, self.counts[np.maximum(number, 0)] if self.keys.n else 0, 0)

    def query(self, number: np.ndarray, degree: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """Codes of successors, `degree` of them for each context number; 0 if unseen."""
        known = np.maximum(number, 0)
        out = np.zeros(len(successors), dtype=np.uint8)
        if not self.keys.n or not len(successors):
            return out
        first, last = self.pointers.at(known).astype(np.int64), self.pointers.at(known + 1).astype(np.int64)
        owner = np.repeat(np.arange(len(number)), degree)
        ask = np.flatnonzero(number[owner] >= 0)
        o = owner[ask]
        found = self.successors.find((known[o].astype(np.uint64) << np.uint64(32)) | successors[ask].astype(np.uint64), first[o], last[o])
        hit = found >= 0
        out[ask[hit]] = self.codes[found[hit]]
        return out


def encode_p(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip(1 + np.ceil(-np.log10(np.maximum(p, 1e-300)) * STEPS - 1e-9), 1, 255), 0).astype(np.uint8)


_DECODED = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


# ---- packs --------------------------------------------------------------------------------------------------


class Tokens:
    """The tokens of a pack, with an END after each text, and the context before each token."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        w = Words(data, at, SPACED)
        n_texts = len(at) - 1
        self.first = w.first + np.arange(n_texts + 1)  # of each text's tokens
        self.hash = np.full(self.first[-1], END, dtype=np.uint64)
        self.hash[np.arange(len(w.hash)) + w.text] = w.hash
        self.text = np.repeat(np.arange(n_texts), np.diff(self.first))
        self.keys, self.key = np.unique(self.hash, return_inverse=True)
        end = int(np.searchsorted(self.keys, END))
        self.before = np.concatenate([[end], self.key[:-1]]).astype(np.int64)
        self.before[self.first[:-1]] = end


class Requests:
    """What a pack asks for. Entries: its distinct words and the further slices of hot ones, sorted by key, each with successors.

    A hot context's successors are dealt to slices, each an entry under a key of its own, so no shard gets
    all of a frequent word's successors; every slice is told the context's count.
    """

    def __init__(self, tokens: Tokens, hot: dict[int, int]):
        slices = np.ones(len(tokens.keys), dtype=np.int64)
        if hot:
            for k in np.flatnonzero(np.isin(tokens.keys, np.array(list(hot), dtype=np.uint64))):
                slices[k] = hot[int(tokens.keys[k])]
        base = np.concatenate([[0], np.cumsum(slices)])
        word = np.repeat(np.arange(len(slices)), slices)
        which = np.arange(base[-1]) - base[word]
        key = tokens.keys[word]
        key = np.where(which > 0, mix(key + which.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key)
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.word = key[order], word[order]
        self.of_word = place[base[:-1]]  # a word's first entry
        successor = tokens.hash & np.uint64(0xFFFFFFFF)
        entry = place[base[tokens.before] + (successor % slices[tokens.before].astype(np.uint64)).astype(np.int64)]
        pair = (entry.astype(np.uint64) << np.uint64(32)) | successor
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        self.degree = np.bincount((self.pairs >> np.uint64(32)).astype(np.int64), minlength=len(self.keys))

    def shards(self, n: int) -> np.ndarray:
        """Where each shard's entries begin: equal ranges of keys."""
        return np.searchsorted(self.keys, np.array([(s << 64) // n for s in range(n)], dtype=np.uint64)).tolist() + [len(self.keys)]


PACKS = "pack string, ids array<long>, train array<boolean>, text binary, ends array<long>, n_train long, n_bytes long, hot array<struct<key:long,n:long>>"


def pack(docs: DataFrame, trains, id_col: str, text_col: str) -> DataFrame:
    """Rows of up to PACK_BYTES of whole texts, compressed; a longer text is a pack of its own."""
    import uuid

    d = docs.select(F.col(id_col).cast("long").alias("id"), trains(F.col(id_col)).alias("train"), F.col(text_col).alias("text"))

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in chunks(batches, "text", PACK_BYTES):
            data, at = utf8(batch.column(2))
            train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            t = Tokens(data, at)
            n = np.bincount(t.key, weights=train[t.text], minlength=len(t.keys)).astype(np.int64)
            often = np.flatnonzero(n > max(2, HOT_SHARE * len(t.key)))
            hot = [{"key": int(k), "n": int(c)} for k, c in zip(t.keys[often].view(np.int64), n[often], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), lists(np.zeros(0), np.zeros(2), pa.int64()) if not batch.num_rows else pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)), lists(train, np.array([0, len(train)]), pa.bool_()), binaries([packer.compress(data.tobytes())]), lists(at[1:], np.array([0, len(at) - 1]), pa.int64()), pa.array([int(n.sum())]), pa.array([int(at[-1])]), pa.array([hot], type=pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())])))],
                names=["pack", "ids", "train", "text", "ends", "n_train", "n_bytes", "hot"],
            )

    return stage(d.mapInArrow(run, PACKS), "lm-packs")


def _tokens(text: bytes, ends: list[int]) -> Tokens:
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(text), dtype=np.uint8) if ends and ends[-1] else np.zeros(0, np.uint8)
    return Tokens(data, np.array([0, *ends], dtype=np.int64))


REQUESTS = "shard int, pack string, keys binary, counts binary, degree binary, successors binary, pair_counts binary"
ANSWERS = "shard int, pack string, counts binary, codes binary, known long"


def requests(packs: DataFrame, n_shards: int, hot) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, train, text, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = _tokens(text, ends)
                r = Requests(t, hot.value)
                weight = np.array(train, dtype=bool)[t.text]
                words = np.bincount(t.key, weights=weight, minlength=len(t.keys)).astype(np.uint32)[r.word]
                pairs = np.bincount(r.pair, weights=weight, minlength=len(r.pairs)).astype(np.uint32)
                successor = (r.pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                begin, pair_begin = r.shards(n_shards), np.concatenate([[0], np.cumsum(r.degree)])
                cols: list[list] = [[], [], [], [], []]
                shards = [s for s in range(n_shards) if begin[s] < begin[s + 1]]
                for s in shards:
                    a, b = begin[s], begin[s + 1]
                    p, q = pair_begin[a], pair_begin[b]
                    for col, part in zip(cols, (r.keys[a:b], words[a:b], r.degree[a:b].astype(np.uint32), successor[p:q], pairs[p:q]), strict=True):
                        col.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([name] * len(shards), pa.string()), *(binaries(c) for c in cols)], names=[x.split()[0] for x in REQUESTS.split(", ")])

    return packs.select("pack", "train", "text", "ends").mapInArrow(run, REQUESTS)


def counts_out(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each, in 8 where one of them needs more; the first byte says which."""
    size = 4 if int(counts.max(initial=0)) < 1 << 32 else 8
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def counts_in(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def answer(key, table):
    """A shard's answers to all packs, from the trie that it builds; the row without pack has the number of its words."""
    as_ = lambda c, t: [np.frombuffer(x, dtype=t) for x in table.column(c).to_pylist()]
    keys, counts, degree, successors, pair_counts = as_("keys", np.uint64), as_("counts", np.uint32), as_("degree", np.uint32), as_("successors", np.uint32), as_("pair_counts", np.uint32)
    every = np.concatenate(keys)
    distinct, where = np.unique(every, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, where, np.concatenate(counts).astype(np.int64))  # whole numbers: sums of doubles would round beyond 2^53
    pair = (np.repeat(where, np.concatenate(degree)).astype(np.uint64) << np.uint64(32)) | np.concatenate(successors)
    times = np.concatenate(pair_counts)
    seen = times > 0
    order = np.argsort(pair[seen])
    sorted_pairs, sorted_times = pair[seen][order], times[seen][order].astype(np.int64)
    first = np.flatnonzero(np.append(True, sorted_pairs[1:] != sorted_pairs[:-1])) if len(sorted_pairs) else np.zeros(0, np.int64)
    pairs, pair_total = sorted_pairs[first], np.add.reduceat(sorted_times, first) if len(first) else np.zeros(0, np.int64)
    known = np.flatnonzero(total > 0)
    number = np.full(len(distinct), -1, dtype=np.int64)
    number[known] = np.arange(len(known))
    owner = number[(pairs >> np.uint64(32)).astype(np.int64)]
    trie = Trie(Trie.build(distinct[known], total[known], np.bincount(owner, minlength=len(known)), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32), pair_total))
    packs, out_counts, out_codes = table.column("pack").to_pylist(), [], []
    for k, d, s in zip(keys, degree, successors, strict=True):
        n, c = trie.context(k)
        out_counts.append(counts_out(c))
        out_codes.append(trie.query(n, d, s).tobytes())
    shard = table.column("shard")[0].as_py()
    n = len(packs)
    # Entries of further slices of a hot word have keys that are no word's; they are told apart where words are counted.
    return pa.table({"shard": pa.array([shard] * (n + 1), pa.int32()), "pack": pa.array([*packs, None], pa.string()), "counts": binaries([*out_counts, b""]), "codes": binaries([*out_codes, b""]), "known": pa.array([0] * n + [len(known)], pa.int64())})


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all texts by the model of those for whose id `trains` (a function of a column) holds.

    A row for each row of docs: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10).
    Null and empty texts are one token, the end. A null id is read as an empty text by `remainder`. Rows that
    repeat are scored and, where they train, counted each. Without training texts every word is unknown. An
    empty table gives an empty result. Other columns are ignored. score is never below base_score by more than
    log10(2).
    """
    spark = docs.sparkSession
    packs = pack(docs, trains, id_col, text_col)
    size = packs.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).collect()[0]
    n_shards = max(12, -(-size.bytes // SHARD_BYTES))
    often = packs.select(F.explode("hot").alias("h")).groupBy("h.key").agg(F.sum("h.n").alias("n")).where(F.col("n") * F.lit(n_shards) > F.lit(size.n))
    # Contexts whose tokens alone would be a shard's share: fewer than n_shards, as their shares add up to 1.
    hot = {int(np.int64(r["key"]).view(np.uint64)): int(min(n_shards, -(-2 * r["n"] * n_shards // max(1, size.n)))) for r in often.collect()}
    told = spark.sparkContext.broadcast(hot)
    asked = requests(packs, int(n_shards), told)
    answers = stage(asked.groupBy("shard").applyInArrow(answer, ANSWERS), "lm-answers")
    known = answers.where("pack is null").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).collect()[0].v
    further = sum(s - 1 for s in hot.values())  # entries that are slices; all of them have a count, as the word is hot
    n_words, n_train = int(known) - further, int(size.n)
    bottom = n_train + 0.5 * (n_words + 1)
    log_prior = np.log(np.array(PRIOR))

    def run(left, right):
        rows = []
        by = sorted(zip(right.column("shard").to_pylist(), right.column("counts").to_pylist(), right.column("codes").to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.int64), *(counts_in(c) for _, c, _ in by)])
        codes = np.frombuffer(b"".join(c for _, _, c in by), dtype=np.uint8)
        for ids, train, text, ends in zip(*(left.column(c).to_pylist() for c in ("ids", "train", "text", "ends")), strict=True):
            t = _tokens(text, ends)
            r = Requests(t, told.value)
            word = counts[r.of_word].astype(np.float64)
            base = ((word + 0.5) / bottom)[t.key]
            above = word[t.before] + MU
            bigram = _DECODED[codes[r.pair]] + MU / above * base
            bigram = np.where(word[t.before] > 0, bigram, base)
            begin = t.first[:-1]
            base_score = np.add.reduceat(np.log10(base), begin)
            fits = np.stack([np.add.reduceat(np.log(base if lam == 0 else (1 - lam) * base + lam * bigram), begin) for lam in LAMBDAS], axis=1) + log_prior
            top = fits.max(axis=1)
            full = (top + np.log(np.exp(fits - top[:, None]).sum(axis=1))) / np.log(10)
            rows.append([ids, train, np.diff(t.first), np.add.reduceat((word > 0)[t.key].astype(np.int64), begin), base_score, full])
        names = [x.split()[0] for x in SCORES.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array(np.concatenate(c) if n not in ("doc_id", "train") else [x for y in c for x in y], type=k) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)}) if rows else pa.schema(list(zip(names, kinds, strict=True))).empty_table()

    mine = packs.select("pack", "ids", "train", "text", "ends").groupBy("pack").cogroup(answers.where("pack is not null").select("pack", "shard", "counts", "codes").groupBy("pack"))
    return mine.applyInArrow(run, SCORES).withColumn("train_tokens", F.lit(n_train).cast("long"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(read(spark, sf_dir, "documents"), lambda i: remainder(i, 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
