"""Repeated passages by sparse suffix arrays.

Suffixes are kept at minimisers only: of every WINDOW consecutive k-word hashes, the least. Two passages of
WINDOW + KGRAM - 1 equal words hold the same minimiser, so none of MIN_WORDS words is missed. Suffixes whose
first k words occur once are dropped. The others are sorted by what follows; neighbours are compared, and
their match is extended to the right and to the left.

Of three suffixes and more with one k-gram, the best two-sided match need not be a neighbour: one neighbour
may reach far to the right, another far to the left. So each passage of MIN_WORDS around such a k-gram, whose
minimiser it is, is looked up by its hash among all suffixes of the k-gram, and what no neighbour has shown is
added. A k-gram whose suffixes go on in the next partition leaves a row for each of its passages; those are
brought together by a join, of one row a passage and partition.

A suffix carries the words around it as 32-bit hashes, as many as a passage of MIN_WORDS can need. Longer
passages hold several minimisers, whose matches overlap and are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import WORDED, Words, binaries, chunks, mix, read, small_batches, stage, trimmed, utf8

#: Least words of a passage, words of a k-gram. The window follows: WINDOW + KGRAM - 1 = MIN_WORDS.
MIN_WORDS, KGRAM = 50, 12
#: Repeated k-grams that may be broadcast (32 MB); with more, all suffixes are joined with them by a shuffle.
BROADCAST_GRAMS = 4_000_000
#: Sorted suffixes that are compared at once, about; words of a text whose matches are joined at once.
SLAB, STRETCH_WORDS = 16_384, 4_096
SUFFIX = "gram long, doc long, doc_id long, pos array<int>, before binary, after binary, low int, high int"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def minimisers(h: np.ndarray, text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices of the least of every `window` consecutive hashes of a text (the rightmost of equal ones), and how far before it the last and the first window begin whose least it is.

    Texts with fewer hashes have none: they are shorter than a passage.
    """
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Least of windows by doubling: the index of the least in spans of 1, 2, 4 ... positions.
    best, width = np.arange(len(h)), 1
    while width < window:
        step = min(width, window - width)
        left, right = best[:-step], best[step:]
        best = np.where(h[right] <= h[left], right, left)
        width += step
    whole = np.flatnonzero(text[:n] == text[window - 1 :])
    picked, at, count = np.unique(best[whole], return_index=True, return_counts=True)
    return picked, picked - whole[at + count - 1], picked - whole[at]


def _window(min_words: int, k: int) -> int:
    if min_words < k + 1:
        raise ValueError("min_words must be larger than the k-gram")
    return min_words - k + 1


def grams(docs: DataFrame, text_col: str, min_words: int, k: int) -> DataFrame:
    """The k-gram hashes at minimisers that occur more than once."""
    window = _window(min_words, k)

    def run(batches):
        for batch in chunks(batches, text_col, 2_000_000):
            w = Words(*utf8(batch.column(0)), WORDED)
            h, begin = w.grams(k)
            g, n = np.unique(h[minimisers(h, w.text[begin], window)[0]].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return docs.select(text_col).mapInArrow(trimmed(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")


def suffixes(docs: DataFrame, id_col: str, text_col: str, min_words: int, k: int) -> DataFrame:
    """The suffixes at minimisers whose k-gram is repeated, with the words before and after the k-gram.

    before holds the words to the left, nearest first, so that both sides compare from their beginning. low and
    high: how many words before the k-gram the passages begin whose minimiser it is. Suffixes of a document that
    agree in their words, as in periodic texts, are one row with several positions.
    """
    window, spark = _window(min_words, k), docs.sparkSession
    repeated = stage(grams(docs, text_col, min_words, k), "suffix-grams")
    small = repeated.count() <= BROADCAST_GRAMS
    known = spark.sparkContext.broadcast(np.sort(repeated.toArrow()["gram"].to_numpy())) if small else None
    side = min_words - k

    def run(batches):
        grams_ = known.value if known else None
        for batch in chunks(batches, "text", 2_000_000):
            w = Words(*utf8(batch.column(2)), WORDED)
            h, begin = w.grams(k)
            kept, low, high = minimisers(h, w.text[begin], window)
            gram, at = h[kept].view(np.int64), begin[kept]
            if grams_ is not None:
                there = np.zeros(len(gram), dtype=bool)
                if len(grams_):
                    i = np.minimum(np.searchsorted(grams_, gram), len(grams_) - 1)
                    there = grams_[i] == gram
                gram, at, low, high = gram[there], at[there], low[there], high[there]
            short = (w.hash >> np.uint64(32)).astype(">u4")  # big-endian: bytes compare as the numbers do
            back, ahead, total = short[::-1].tobytes(), short.tobytes(), len(short)
            text = w.text[at]
            a, b, from_ = np.maximum(at - side, w.first[text]), np.minimum(at + k + side, w.first[text + 1]), w.first[text]
            rows: dict[tuple, list] = {}
            columns = (text, gram, at, a, b, from_, low, high)
            for t, g, p, x, y, f, lo, hi in zip(*(c.tolist() for c in columns), strict=True):
                key = (t, g, back[4 * (total - p) : 4 * (total - x)], ahead[4 * (p + k) : 4 * y])
                own = rows.get(key)
                if own is None:
                    rows[key] = [[p - f], lo, hi]
                else:
                    own[0].append(p - f)
                    own[1], own[2] = min(own[1], lo), max(own[2], hi)
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            pos, lows, highs = list(zip(*rows.values(), strict=True)) or [[], [], []]
            of = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[1], pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array(pos, pa.list_(pa.int32())), binaries(cols[2]), binaries(cols[3]), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())],
                names=[x.split()[0] for x in SUFFIX.split(", ")],
            )

    d = docs.select(row_key(id_col, text_col).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(trimmed(run), SUFFIX)
    return out if small else out.join(repeated, "gram", "left_semi")


def row_key(id_col: str, text_col: str):
    """Tells rows apart by id and text; rows with the same of both are one document."""
    return F.xxhash64(id_col, text_col)


# ---- comparing ----------------------------------------------------------------------------------------------

HITS = "doc long, doc_id long, pos array<int>, left int, size int, first boolean, of_id long, passage long"
_HITS = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.list_(pa.int32())), ("left", pa.int32()), ("size", pa.int32()), ("first", pa.bool_()), ("of_id", pa.int64()), ("passage", pa.int64())])


def _sides(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed words as a matrix with a row each, and how many words each has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    size = np.minimum(np.diff(at), width)
    raw = np.frombuffer(column.buffers()[2], np.uint32) if column.buffers()[2] is not None else np.zeros(0, np.uint32)
    out = np.zeros((len(column), width), dtype=np.uint32)
    inside = np.arange(width) < size[:, None]
    out[inside] = raw[(at[:-1, None] + np.arange(width))[inside]]
    return out, size


def _agree(m: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Equal words at the beginning of each row and the one after it."""
    same = (m[1:] == m[:-1]) & (np.arange(m.shape[1]) < np.minimum(size[1:], size[:-1])[:, None])
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


class Slab:
    """Sorted suffixes of whole k-grams, as arrays. rank: order of documents by id (null last), the same for rows of one document."""

    def __init__(self, rows: pa.RecordBatch, side: int):
        self.rows = rows
        self.gram, self.doc = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        ids = rows.column(2)
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy()
        order = np.lexsort((self.doc, self.id, self.no_id))
        new = np.append(True, (np.diff(self.doc[order]) != 0) | (np.diff(self.id[order]) != 0) | (np.diff(self.no_id[order].astype(np.int8)) != 0))
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.cumsum(new) - 1
        self.row_of_rank = order[new]
        self.before, self.n_before = _sides(rows.column(4), side)
        self.after, self.n_after = _sides(rows.column(5), side)
        self.low, self.high = rows.column(6).to_numpy(), rows.column(7).to_numpy()
        begin = np.flatnonzero(np.append(True, self.gram[1:] != self.gram[:-1]))
        size = np.diff(np.append(begin, len(self.gram)))
        self.size = np.repeat(size, size)

    def neighbours(self, min_words: int, k: int, within: bool) -> tuple[np.ndarray, ...]:
        """row, other row, words to the left, words in all: both sides of each pair of neighbours that match."""
        left, right = _agree(self.before, self.n_before), k + _agree(self.after, self.n_after)
        ok = (self.gram[1:] == self.gram[:-1]) & (left + right >= min_words)
        other = self.rank[1:] != self.rank[:-1]
        if within:
            first = np.array([p[0] for p in self.rows.column(3).to_pylist()], dtype=np.int64)
            other |= np.abs(np.diff(first)) >= left + right  # a passage that overlaps its own repetition is none
        a = np.flatnonzero(ok & other)
        return np.concatenate([a, a + 1]), np.concatenate([a + 1, a]), np.tile(left[a], 2), np.tile((left + right)[a], 2)

    def passages(self, border: np.ndarray, side: int):
        """For each beginning l: rows with a passage that begins l words before the k-gram, the least and the greatest rank with the same passage, and its hash. Only k-grams of three rows and more, and those at a border."""
        power = _ODD ** np.arange(1, side + 1, dtype=np.uint64)
        sums = []
        for m, odd in ((self.before, np.uint64(3)), (self.after, np.uint64(5))):
            total = np.zeros((len(m), side + 1), dtype=np.uint64)
            np.cumsum(mix(m.astype(np.uint64) * odd) * power, axis=1, out=total[:, 1:])
            sums.append(total)
        asked = (self.size > 2) | border
        for at in range(side + 1):
            rows = np.flatnonzero(asked & (self.low <= at) & (at <= self.high) & (self.n_before >= at) & (self.n_after >= side - at))
            if not len(rows):
                continue
            key = mix(mix(self.gram[rows].view(np.uint64) + np.uint64(at)) + sums[0][rows, at] * np.uint64(7) + sums[1][rows, side - at])
            order = np.argsort(key, kind="stable")
            begin = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            n, rank = np.diff(np.append(begin, len(order))), self.rank[rows][order]
            least, most = np.repeat(np.minimum.reduceat(rank, begin), n), np.repeat(np.maximum.reduceat(rank, begin), n)
            yield at, rows[order], least, most, key[order]


def compare(slab: Slab, min_words: int, k: int, within: bool, border: np.ndarray):
    """Hits of a slab as record batches; border: rows of k-grams that may go on in another partition."""
    side, n = min_words - k, len(slab.gram)
    row, other, left, size = slab.neighbours(min_words, k, within)
    first = (slab.rank[row] < slab.rank[other]) if not within else (slab.rank[row] < slab.rank[other]) | ((slab.rank[row] == slab.rank[other]) & (row < other))
    yield _hits(slab, row, left, size, first, slab.id[other], slab.no_id[other])
    shown = np.zeros((2, n, side + 2), dtype=np.int32)  # passages that neighbours have shown, for later and first occurrences
    of = first.astype(np.int64)
    np.add.at(shown, (of, row, np.maximum(0, min_words - size + left)), 1)
    np.add.at(shown, (of, row, left + 1), -1)
    shown = np.cumsum(shown, axis=2)[:, :, : side + 1] > 0
    state, partner = np.zeros((n, side + 2), dtype=np.int8), np.zeros((n, side + 2), dtype=np.int64)
    edges = []
    for at, rows, least, most, key in slab.passages(border, side):
        own = slab.rank[rows]
        many = least != most
        r, is_first = rows[many], own[many] == least[many]
        new = ~shown[is_first.astype(np.int64), r, at]
        state[r[new], at] = 1 + is_first[new]
        partner[r[new], at] = slab.row_of_rank[np.where(is_first, most[many], least[many])[new]]
        edge = border[rows] & (own == least)
        if edge.any():
            pick = np.unique(key[edge], return_index=True)[1]
            edges.append((rows[edge][pick], np.full(len(pick), at), key[edge][pick]))
    # Passages of a row that begin one after the other are one hit.
    change = np.diff(state, axis=1, prepend=np.zeros((n, 1), np.int8)) != 0
    r, at = np.nonzero(change & (state > 0))
    if len(r):
        r_end, at_end = np.nonzero(np.diff(state, axis=1, append=np.zeros((n, 1), np.int8)) != 0)
        ends = state[r_end, at_end] > 0
        last, with_ = at_end[ends], partner[r, at]
        yield _hits(slab, r, last, last - at + min_words, state[r, at] == 2, slab.id[with_], slab.no_id[with_])
    if edges:
        r, at, key = (np.concatenate(c) for c in zip(*edges, strict=True))
        yield _hits(slab, r, at, np.full(len(r), min_words), None, None, None, key)


def _hits(slab: Slab, row, left, size, first, of_id, no_id, passage=None) -> pa.RecordBatch:
    take, null = pa.array(row), lambda kind: pa.nulls(len(row), kind)
    return pa.RecordBatch.from_arrays(
        [slab.rows.column(1).take(take), slab.rows.column(2).take(take), slab.rows.column(3).take(take), pa.array(left.astype(np.int32)), pa.array(size.astype(np.int32)),
         null(pa.bool_()) if first is None else pa.array(first), null(pa.int64()) if of_id is None else pa.array(of_id, mask=no_id), null(pa.int64()) if passage is None else pa.array(passage.view(np.int64))],
        schema=_HITS,
    )


def _compare(min_words: int, k: int, within: bool, slab_rows: int):
    def slabs(batches):
        """Whole k-grams of sorted rows, about slab_rows at once, and whether they begin or end the partition."""
        held, begins = [], True
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < slab_rows:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            gram = rows.column(0).to_numpy()
            last = int(np.searchsorted(gram, gram[-1]))
            if last:
                yield rows.slice(0, last), begins, False
                begins = False
            held = [rows.slice(last)]
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], begins, True

    def run(batches):
        for rows, begins, ends in slabs(batches):
            # A slice's buffers are those of the whole; a copy has its own.
            slab = Slab(pa.Table.from_batches([rows]).take(np.arange(rows.num_rows)).combine_chunks().to_batches()[0], min_words - k)
            border = (begins & (slab.gram == slab.gram[0])) | (ends & (slab.gram == slab.gram[-1]))
            yield from compare(slab, min_words, k, within, border)

    return trimmed(run)


def neighbours(found: DataFrame, min_words: int, k: int, within: bool) -> DataFrame:
    """Matches of suffixes that share a k-gram. Partitions are ranges of the order, so a frequent k-gram is dealt to many."""
    order = ["gram", "after", "before", "doc_id", "doc"]
    n = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.rdd.getNumPartitions())
    ranged = found.repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = stage(ranged.mapInArrow(_compare(min_words, k, within, SLAB), HITS), "suffix-hits")
    # Passages of k-grams at borders: a row for each partition that has one, with the least document there.
    edge = out.where("passage is not null")
    who = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "doc", F.get("pos", F.lit(0)).alias("at"))
    apart = F.col("lo.doc") != F.col("hi.doc")
    if within:
        apart = apart | (F.abs(F.col("lo.at") - F.col("hi.at")) >= min_words)
    both = edge.groupBy("passage").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where(apart)
    own = F.col("doc") == F.col("lo.doc")
    across = edge.drop("first", "of_id").join(both, "passage").withColumn("first", own & (F.get("pos", F.lit(0)) == F.col("lo.at")) if within else own)
    across = across.select("doc", "doc_id", "pos", "left", "size", "first", F.when(F.col("first"), F.col("hi.doc_id")).otherwise(F.col("lo.doc_id")).alias("of_id"))
    return out.where("passage is null").drop("passage").unionByName(across)


def matches(docs: DataFrame, id_col: str, text_col: str, min_words: int, k: int, within: bool) -> DataFrame:
    """doc, doc_id, start, end, first, of_id: a row for each match of a suffix."""
    small_batches(docs.sparkSession)
    found = stage(suffixes(docs, id_col, text_col, min_words, k), "suffixes")
    hits = neighbours(found, min_words, k, within)
    hits = hits.select("doc", "doc_id", F.explode("pos").alias("p"), "left", "size", "first", "of_id").withColumn("start", F.col("p") - F.col("left"))
    return hits.select("doc", "doc_id", "start", (F.col("start") + F.col("size")).alias("end"), "first", "of_id")


def _joined(hits: DataFrame, *by: str) -> DataFrame:
    """Matches of a document that overlap or touch as one, within the groups of `by`."""
    w = Window.partitionBy("doc", *by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    hits = hits.withColumn("stretch", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = hits.groupBy("doc", "doc_id", *by, "stretch").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.bool_and("first").alias("first"), F.min("of_id").alias("of_id"))
    return out.drop("stretch", *by)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = KGRAM, within: bool = False, later_only: bool = False) -> DataFrame:
    """doc (row_key), doc_id, start, end (words), first, partner: the stretches of each text that repeat elsewhere.

    A stretch is joined from matches of at least min_words words with another document; every word that is in
    one is in a stretch. It is `first` if it isn't repeated from a smaller id (null ids last): the occurrence to
    keep. partner is the least id of those matched (null if they have none); a passage in many documents is
    matched with its neighbours in the order and with its least holder, so that stretches of a passage are
    linked through others where they aren't directly. With within, matches of neighbours inside a document
    count, too. With later_only, only matches with smaller ids are taken. Words are runs of letters and digits,
    A-Z folded. Texts that are null, empty or of fewer words have no stretch. Long texts are read whole. Rows with
    the same id and text are one document. Empty tables give an empty result; other columns are ignored.
    """
    hits = matches(docs, id_col, text_col, min_words, k, within)
    if later_only:
        hits = hits.where("not first")
    # First within so many words of a text, then of the whole text: a long text is dealt out, too.
    near = _joined(hits.withColumn("part", F.floor(F.col("start") / F.lit(STRETCH_WORDS))), "part")
    return _joined(near).withColumnRenamed("of_id", "partner")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, start_word, end_word, n_words, first, partner: see spans."""
    return spans(docs, id_col, text_col, **options).select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "first", "partner")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the stretches taken out of text_col that repeat a document with a smaller id.

    From the beginning of a stretch's first word up to the word after it goes; what is not
    repeated stays as it was. Texts without such a stretch, null ones too, are unchanged. All columns and rows are kept.
    """
    import uuid

    key, list_col = f"_k{uuid.uuid4().hex[:8]}", f"_c{uuid.uuid4().hex[:8]}"
    later = spans(docs, id_col, text_col, later_only=True, **options).groupBy(F.col("doc").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(list_col))
    d = docs.withColumn(key, row_key(id_col, text_col)).join(later, key, "left").drop(key)
    where, what = d.columns.index(text_col), d.columns.index(list_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(where).to_pylist()
            for i, stretches in enumerate(batch.column(what).to_pylist()):
                if not stretches:
                    continue
                raw = texts[i].encode()
                w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), WORDED)
                out, at = [], 0
                for s in stretches:
                    begin = int(w.start[s["start"]])
                    out.append(raw[at:begin])
                    at = int(w.start[s["end"]]) if s["end"] < len(w.start) else len(raw)
                texts[i] = b"".join([*out, raw[at:]]).decode("utf-8", "ignore")
            cols = [pa.array(texts, type=batch.column(where).type) if k == where else c for k, c in enumerate(batch.columns) if k != what]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n in batch.schema.names if n != list_col])

    return d.mapInArrow(trimmed(run), T.StructType([f for f in d.schema.fields if f.name != list_col]))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(read(spark, sf_dir, "documents"))
