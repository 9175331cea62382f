"""Benchmark decontamination by a BM25 index of the test items, searched with block-max WAND.

The items are indexed, not the corpus: for each word the items with it and the word's part in an item's score,
in blocks with their maxima. Every passage of every document is a query. An item's score is divided by what
the item itself would get as query, so one threshold fits items of any length. The search skips what can't
reach the threshold: passages by the sum of their words' maxima, then items by pivots, then blocks by their
maxima. Items above the threshold are verified: enough of the question's and of the answer's shingles must
stand in the passage; of an item without an answer of its own, enough of the whole item's suffice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import WORDED, Words, chunks, read, small_batches, stage, trimmed, utf8

#: BM25's constants; share of its own score that an item must reach; share of shingles that question and answer must have in the passage; words of a shingle.
K1, B, THRESHOLD, OVERLAP, SHINGLE = 1.2, 0.75, 0.6, 0.8, 5
#: Postings of a block; bytes of items in an index (larger sets of items become several indexes).
BLOCK, INDEX_BYTES = 16, 16_000_000
#: Blocks of items by which passages are passed over.
MAX_BLOCKS = 256
#: Cells of passages whose bounds are summed at once (16 MB with MAX_BLOCKS).
CELLS = 8_192
#: Share of an item without a question mark that counts as its answer, at its end.
ANSWER_SHARE = 0.25


def has_answer(text: str) -> bool:
    """Whether words follow the item's last question mark."""
    _, mark, tail = text.rpartition("?")
    return bool(mark) and any(c.isalnum() for c in tail)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item: up to its last question mark, and the rest; without one, or without a word after it, the last quarter of the words is the answer."""
    if has_answer(text):
        head, mark, tail = text.rpartition("?")
        return head + mark, tail
    words = text.split()
    n = max(1, round(len(words) * (1 - ANSWER_SHARE)))
    return " ".join(words[:n]), " ".join(words[n:])


def _hashes(text: str) -> np.ndarray:
    raw = text.encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WORDED).hash


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of the shingles of a sequence of words; of the whole if it is shorter."""
    size = min(size, len(h))
    if not size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for j in range(size):
        total = total * np.uint64(0x100000001B3) + h[j : len(h) - size + 1 + j]
    return np.unique(total + np.uint64(size))


class Index:
    """Postings of normalised BM25 parts, in blocks, and each item's shingles; of those that are `undivided`, the whole item's, too."""

    def __init__(self, ids: list, questions: list[str], answers: list[str], undivided: list[bool] | None = None):
        self.ids = ids
        seqs = [(_hashes(q or ""), _hashes(a or "")) for q, a in zip(questions, answers, strict=True)]
        whole = [np.concatenate(s) for s in seqs]
        size = np.array([len(h) for h in whole])
        self.longest = int(size.max(initial=1))
        mean, n = max(1.0, float(size.mean()) if len(size) else 1.0), len(ids)
        parts: dict[int, list[tuple[int, float]]] = {}
        counted = [np.unique(h, return_counts=True) for h in whole]
        df: dict[int, int] = {}
        for words, _ in counted:
            for w in words.tolist():
                df[w] = df.get(w, 0) + 1
        for i, (words, tf) in enumerate(counted):
            idf = np.log(1 + (n - np.array([df[w] for w in words.tolist()]) + 0.5) / (np.array([df[w] for w in words.tolist()]) + 0.5)) if len(words) else np.zeros(0)
            score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[i] / mean))
            for w, x in zip(words.tolist(), (score / score.sum()).tolist() if len(words) else [], strict=True):
                parts.setdefault(w, []).append((i, x))
        self.words = np.array(sorted(parts), dtype=np.uint64)
        self.items = [np.array([i for i, _ in parts[w]], dtype=np.int64) for w in self.words.tolist()]
        self.parts = [np.array([x for _, x in parts[w]]) for w in self.words.tolist()]
        self.block_max = [np.maximum.reduceat(p, np.arange(0, len(p), BLOCK)) for p in self.parts]
        self.max = np.array([p.max() for p in self.parts]) if self.parts else np.zeros(0)
        # Blocks of items, MAX_BLOCKS at most, and the greatest part that each word has in each of them.
        wide = max(1, -(-n // MAX_BLOCKS))
        self.n_blocks = max(1, -(-n // wide))
        word = np.repeat(np.arange(len(self.items)), [len(x) for x in self.items])
        key = word * self.n_blocks + (np.concatenate(self.items) // wide if self.items else np.zeros(0, np.int64))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.wide_max = np.maximum.reduceat(np.concatenate(self.parts), first) if len(first) else np.zeros(0)
        self.wide_block = key[first] % self.n_blocks
        self.wide_begin = np.searchsorted(key[first] // self.n_blocks, np.arange(len(self.items) + 1))
        self.shingles = [(_shingles(q, SHINGLE), _shingles(a, SHINGLE)) for q, a in seqs]
        self.whole = [_shingles(h, SHINGLE) if one else None for h, one in zip(whole, undivided or [False] * n, strict=True)]
        self.sizes = sorted({min(SHINGLE, len(h)) for s in [*seqs, whole] for h in s} - {0})

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words in the index, -1 for others."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def search(self, words: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items whose score for a passage with these (distinct) words is at least the threshold: block-max WAND."""
        lists = [[0, w] for w in words]  # position in the postings, word
        items, parts, block_max, top, found = self.items, self.parts, self.block_max, self.max, []
        threshold -= 1e-9
        while lists:
            lists.sort(key=lambda x: items[x[1]][x[0]])
            total, pivot = 0.0, None
            for k, (_, w) in enumerate(lists):
                total += top[w]
                if total >= threshold:
                    pivot = k
                    break
            if pivot is None:
                break
            item = int(items[lists[pivot][1]][lists[pivot][0]])
            while pivot + 1 < len(lists) and items[lists[pivot + 1][1]][lists[pivot + 1][0]] == item:
                pivot += 1
            # The blocks in which the item would be, and how far they reach.
            bound, reach = 0.0, None
            for at, w in lists[: pivot + 1]:
                own = items[w]
                p = at + int(np.searchsorted(own[at:], item))
                if p < len(own):
                    b = p // BLOCK
                    bound += block_max[w][b]
                    end = int(own[min(len(own), (b + 1) * BLOCK) - 1])
                    reach = end if reach is None else min(reach, end)
            if bound >= threshold:
                if items[lists[0][1]][lists[0][0]] == item:
                    score = sum(float(parts[w][at]) for at, w in lists[: pivot + 1])
                    if score >= threshold:
                        found.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:
                to = (item if reach is None else reach) + 1
                if pivot + 1 < len(lists):
                    to = min(to, int(items[lists[pivot + 1][1]][lists[pivot + 1][0]]))
                to = max(to, item + 1)
            for x in lists[: pivot + 1]:
                own = items[x[1]]
                if own[x[0]] < to:
                    x[0] += int(np.searchsorted(own[x[0] :], to))
            lists = [x for x in lists if x[0] < len(items[x[1]])]
        return found

    def verify(self, item: int, have: dict[int, np.ndarray], overlap: float) -> tuple[float, float] | None:
        """Shares of the question's and of the answer's shingles among those of a passage (size -> hashes), if both suffice, or the whole's if the item is undivided; an empty part has all."""
        shares = tuple(float(np.isin(own, have["all"]).mean()) if len(own) else 1.0 for own in self.shingles[item])
        if not any(len(s) for s in self.shingles[item]):
            return None
        if min(shares) >= overlap - 1e-9:
            return shares
        whole = self.whole[item]
        return shares if whole is not None and np.isin(whole, have["all"]).mean() >= overlap - 1e-9 else None


def passages(index: Index, w: Words, threshold: float):
    """(text, first word, end) of the passages in which an item could reach the threshold, with their words.

    The bound is the sum of the words' maxima within a block of items, for each block. A passage is two neighbouring cells, each as long as the longest item: every stretch of an item's length
    lies in one.
    """
    cell = max(index.longest, SHINGLE)
    number = index.find(w.hash)
    hit = np.flatnonzero(number >= 0)
    if not len(hit):
        return
    local = hit - w.first[w.text[hit]]
    n_cells = -(-np.diff(w.first) // cell)
    base = np.concatenate([[0], np.cumsum(n_cells)])
    cell_of = base[w.text[hit]] + local // cell
    pair = np.unique(cell_of.astype(np.int64) * len(index.words) + number[hit])
    which, word = pair // len(index.words), pair % len(index.words)
    n_all = int(base[-1])
    text_of = np.repeat(np.arange(len(n_cells)), n_cells)
    single, goes_on = n_cells[text_of] == 1, np.append(text_of[1:], -1) == text_of
    # Bounds of some cells at once, and of the one after them: a long text has as many cells as it has words.
    able = []
    for low in range(0, n_all, CELLS):
        high = min(n_all, low + CELLS)
        p, q = np.searchsorted(which, [low, high + 1])
        times = index.wide_begin[word[p:q] + 1] - index.wide_begin[word[p:q]]
        entry = np.repeat(index.wide_begin[word[p:q]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        at = np.repeat(which[p:q] - low, times) * index.n_blocks + index.wide_block[entry]
        bound = np.bincount(at, weights=index.wide_max[entry], minlength=(high - low + 1) * index.n_blocks).reshape(-1, index.n_blocks)
        together = np.where(goes_on[low:high, None], bound[:-1] + bound[1:], bound[:-1]).max(axis=1)
        able.append(low + np.flatnonzero((together >= threshold - 1e-9) & (single | goes_on)[low:high]))
    able = np.concatenate(able)
    begin = np.searchsorted(which, np.arange(base[-1] + 2))
    for c in able.tolist():
        t = int(text_of[c])
        last = c if single[c] else c + 1
        first = int(w.first[t]) + (c - int(base[t])) * cell
        end = min(int(w.first[t + 1]), first + (last - c + 1) * cell)
        yield t, first, end, np.unique(word[begin[c] : begin[last + 1]]).tolist()


FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str | None = "text", question_col: str | None = None, answer_col: str | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP, key_col: str | None = None) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each document and item that it holds.

    score is the item's best over the document's passages, 1 if all its words are in one. Questions and
    answers come from question_col and answer_col, or by split_item from item_text. An item of item_text without an
    answer of its own is also held if `overlap` of the shingles of the whole item are, whatever its parts'. Null and empty texts
    and items match nothing. Rows that repeat an id are one document; an item id that repeats is one item with the best match.
    Documents are searched whole. Empty tables give an empty result; other columns are ignored. With key_col,
    that long column stands for the document's id.

    Items are indexed in groups of INDEX_BYTES at most, each sent to all tasks; each group costs a pass over the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if question_col:
        parts = items.select(F.col(item_col).cast("long").alias("i"), F.col(question_col).alias("q"), F.col(answer_col).alias("a") if answer_col else F.lit(""))
    else:
        parts = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("q"), F.lit(None).cast("string").alias("a"))
    parts = parts.where("length(coalesce(q, '')) + length(coalesce(a, '')) > 0").distinct()
    size = parts.agg(F.coalesce(F.sum(F.octet_length(F.concat(F.coalesce("q", F.lit("")), F.coalesce("a", F.lit(""))))), F.lit(0)).alias("n")).collect()[0].n
    groups, found = max(1, -(-size // INDEX_BYTES)), None
    d = docs.select(F.col(key_col or id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for g in range(groups):
        rows = parts.where(F.pmod(F.xxhash64("i", "q"), F.lit(groups)) == g).orderBy("i", "q", "a").collect()
        cut = [split_item(r.q) if r.a is None and not question_col else (r.q, r.a) for r in rows]
        undivided = [r.a is None and not question_col and not has_answer(r.q) for r in rows]
        index = Index([r.i for r in rows], [q for q, _ in cut], [a for _, a in cut], undivided)
        part = d.mapInArrow(_search(spark.sparkContext.broadcast(index), threshold, overlap), FOUND)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.score", "m.question_overlap", "m.answer_overlap")


def _search(sent, threshold: float, overlap: float):
    def run(batches):
        index: Index = sent.value
        for batch in chunks(batches, "text", 2_000_000):
            w = Words(*utf8(batch.column(1)), WORDED)
            best: dict[tuple[int, int], tuple] = {}
            for text, first, end, words in passages(index, w, threshold):
                have = None
                for item, score in index.search(words, threshold):
                    if have is None:
                        h = w.hash[first:end]
                        have = {"all": np.concatenate([_shingles_of(h, n) for n in index.sizes])}
                    shares = index.verify(item, have, overlap)
                    if shares is not None:
                        best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (min(1.0, score), *shares))
            if best:
                texts, items = [t for t, _ in best], [index.ids[i] for _, i in best]
                cols = list(zip(*best.values(), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts)), pa.array(items, pa.int64()), *(pa.array(c, pa.float64()) for c in cols)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return trimmed(run)


def _shingles_of(h: np.ndarray, size: int) -> np.ndarray:
    return _shingles(h, size) if len(h) >= size else np.zeros(0, np.uint64)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose text holds an item; all columns are kept. Rows are told apart by a hash of id and text."""
    import uuid

    key = f"_k{uuid.uuid4().hex[:8]}"
    d = docs.withColumn(key, F.xxhash64(id_col, text_col))
    bad = stage(contaminated(d, items, id_col, text_col, key_col=key, **options).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return d.join(bad, key, "left_anti").drop(key)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
