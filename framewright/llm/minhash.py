"""Near-duplicates by ProbMinHash, banding and verification.

A document is a set of word shingles. For each shingle of weight w a Poisson process of rate w is simulated from
the shingle's hash; each arrival goes to a random register, and a register keeps the shingle that arrived first.
Two documents agree in a register with their probability Jaccard similarity. A shingle is done once its next
arrival is later than every register of its document. Links are promised by the Jaccard similarity of sets,
whatever the counts, so documents are sketched with weights of 1, for which both similarities are the same.

Texts with the same words are one node from the start, however many rows have them. Nodes of a band's bucket
are compared with a leader of the bucket; verified pairs are links, linked nodes a component. Where a bucket
still holds several components, none of its pairs is left open. In a bucket of at most SMALL nodes, each node
meets the others, and sizes and parities exclude what they can. The nodes of larger buckets, whose pairs grow
with the square, are joined by prefixes: of two sets of the least similarity, those shingles that come first in
any one order hold a common one. The order is by how many nodes have a shingle, so that what a family of texts
shares comes last.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import WORDED, Words, _BASE, binaries, chunks, lists, mix, read, small_batches, stage, sums, trimmed, utf8

#: Words of a shingle, least Jaccard similarity of a link, bands and registers of a band.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
#: Links of a node that share a copy of its shingles.
PER_COPY = 256
#: Nodes of a bucket that meet each other; more are joined by prefixes.
SMALL = 32
#: Shingles of more nodes are frequent; nodes of a shingle's prefixes that are compared with the others at once.
FREQUENT, PER_SHINGLE = 1, 256
#: Ids that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hash, count, where each text's begin; and two hashes of each text.

    Words are runs of letters and digits, A-Z folded. A text of fewer words than a shingle has one, of all its
    words. The hashes of a text are of its words in order, of its bytes if it has no word.
    """
    w = Words(data, at, WORDED)
    n = np.diff(w.first)
    h, begin = w.grams(size)
    text = w.text[begin]
    for k in range(1, min(size, int(n.max(initial=0)) + 1)):
        short = np.flatnonzero(n == k)
        if len(short):
            total = np.zeros(len(short), dtype=np.uint64)
            for j in range(k):
                total = total * np.uint64(_BASE) + w.hash[w.first[short] + j]
            h, text = np.concatenate([h, mix(total + np.uint64(k))]), np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.flatnonzero((np.diff(h, prepend=h[:1] + np.uint64(1)) != 0) | (np.diff(text, prepend=-1) != 0)) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(h)))
    first = np.searchsorted(text[new], np.arange(len(at)))
    return h[new], count, first, *_whole(w, n, data, at)


def _whole(w: Words, n: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = n.astype(np.uint64)
    by_words = mix(sums(w.hash, w.first) + size), mix(sums(mix(w.hash + _GOLD), w.first) ^ size)
    bare = np.flatnonzero(n == 0)
    if len(bare):
        raw = np.concatenate([data[at[i] : at[i + 1]] for i in bare]).astype(np.uint64)
        raw, first = mix(raw + _GOLD), np.concatenate([[0], np.cumsum(np.diff(at)[bare])])
        by_words[0][bare], by_words[1][bare] = mix(sums(raw, first) ^ _GOLD), mix(sums(mix(raw), first) + _GOLD)
    return by_words


def prob_minhash(h: np.ndarray, weight: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """The m registers of each text: hash of the shingle that arrives first; 0 in texts without shingles."""
    n_texts = len(first) - 1
    arrived = np.full(n_texts * m, np.inf)
    keeps = np.zeros(n_texts * m, dtype=np.uint64)
    text = np.repeat(np.arange(n_texts), np.diff(first))
    rate, time, s, step = 1.0 / weight, np.zeros(len(h)), h, 0
    latest = np.full(n_texts, np.inf)
    while len(s):
        step += 1
        u = mix(s + np.uint64(2 * step * int(_GOLD) % 2**64))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) * rate
        soon = time < latest[text]
        if not soon.all():
            s, time, rate, text = s[soon], time[soon], rate[soon], text[soon]
            if not len(s):
                break
        at = text * m + (mix(s + np.uint64((2 * step + 1) * int(_GOLD) % 2**64)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(arrived, at, time)
        won = time == arrived[at]
        keeps[at[won]] = s[won]
        latest = arrived.reshape(n_texts, m).max(axis=1)
    return keeps.reshape(n_texts, m)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(registers), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(registers), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = mix(key * _GOLD + registers[:, b * rows + r])
        out[:, b] = key
    return out


SIGNED = "doc_id long, node long, check long, n_shingles int, bands array<long>"


def sign(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in chunks(batches, text_col, 2_000_000):
            data, at = utf8(batch.column(1))
            h, _, first, a, b = shingles(data, at)
            # With weights of 1 registers agree with the Jaccard similarity of the sets, which is what is verified.
            keys = band_keys(prob_minhash(h, np.ones(len(h)), first, bands * rows), bands, rows)
            n = np.diff(first)
            keys, many = keys[n > 0], np.where(n > 0, bands, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int32)), lists(keys.ravel().view(np.int64), np.concatenate([[0], np.cumsum(many)]), pa.int64())],
                names=["doc_id", "node", "check", "n_shingles", "bands"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(trimmed(run), SIGNED)


def sets_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """node and its sorted shingle hashes (32 bits, packed) for the wanted nodes. Each task sends a node once."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def run(batches):
        sent: set[int] = set()
        for batch in chunks(batches, text_col, 2_000_000):
            data, at = utf8(batch.column(0))
            h, _, first, node, _ = shingles(data, at)
            node = node.view(np.int64)
            mine = [i for i in np.unique(node, return_index=True)[1] if node[i] not in sent]
            if len(sent) < 1_000_000:
                sent.update(node[mine].tolist())
            small = (h >> np.uint64(32)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(node[mine]), binaries([np.unique(small[first[i] : first[i + 1]]).tobytes() for i in mine])], names=["node", "shingles"])

    sets = docs.select(text_col).mapInArrow(trimmed(run), "node long, shingles binary").join(wanted, "node", "left_semi")
    return stage(sets.groupBy("node").agg(F.any_value("shingles").alias("shingles")), "near-sets")


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose sets have at least the similarity. A node in many pairs is copied once for each PER_COPY of them."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(PER_COPY)).cast("int").alias("_n"))
    many = degree.where("_n > 1")
    p = pairs.join(F.broadcast(many) if many.count() <= BROADCAST_IDS else many, "a", "left").withColumn("_salt", F.pmod(F.xxhash64("b"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    left = degree.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_salt"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return p.join(right, "b").join(left, ["a", "_salt"]).select("a", "b", "x", "y").mapInArrow(trimmed(run), "a long, b long")


def by_leaders(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) of nodes with the leaders of their buckets, the nodes of least hash in them.

    First each node meets one leader, the one of least hash of all its buckets: in a group of near copies, the
    same for most. Then it meets the leaders of its other buckets that have not ended up with the same one.
    """
    led = members.where("node <> mid").select("node", F.col("mid").alias("leader")).distinct()
    best = led.groupBy("node").agg(F.min_by("leader", F.xxhash64("leader")).alias("leader"))
    one = stage(verify(best.select(F.col("leader").alias("a"), F.col("node").alias("b")), sets, similarity), "near-led")
    label = lambda c: one.select(F.col("b").alias(c), F.col("a").alias(f"{c}_at"))
    rest = led.join(best, ["node", "leader"], "left_anti").join(label("node"), "node", "left").join(label("leader"), "leader", "left")
    rest = rest.where(F.coalesce("node_at", "node") != F.coalesce("leader_at", "leader"))
    # A pair may come with either node as leader; the one with the lesser hash stays leader.
    swap = F.xxhash64("leader") > F.xxhash64("node")
    pairs = rest.select(F.when(swap, F.col("node")).otherwise(F.col("leader")).alias("a"), F.when(swap, F.col("leader")).otherwise(F.col("node")).alias("b")).distinct()
    return one.unionByName(verify(stage(pairs, "near-pairs"), sets, similarity)).distinct()


def prefixes(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """shingle, node, root, at, n: of each node, as many shingles from the beginning of the order as two sets of the similarity must share one of.

    The order is by frequency, so rare shingles, which pair few nodes, come first. Frequencies are known of those
    shingles that more than FREQUENT nodes have, or as many nodes as let BROADCAST_IDS of them exist.
    """
    own = (F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes).join(sets, "node").select("node", "root", "shingles")

    def counted(batches):
        for batch in batches:
            h, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int32)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    total = own.agg(F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0)).alias("n")).collect()[0].n // 4
    times = own.select("shingles").mapInArrow(counted, "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    least = max(FREQUENT, total // max(1, BROADCAST_IDS))
    table = times.where(F.col("n") > least).toArrow()
    shingle, n = table["shingle"].to_numpy().view(np.uint32), table["n"].to_numpy()
    order = np.argsort(shingle)
    sent = nodes.sparkSession.sparkContext.broadcast((shingle[order], n[order]))

    def run(batches):
        known, often = sent.value
        for batch in batches:
            parts, places, sizes, marks = [], [], [], []
            for raw in batch.column(2).to_pylist():
                x = np.frombuffer(raw, np.uint32)
                p = len(x) - int(np.ceil(similarity * len(x) - 1e-9)) + 1
                marks.append(parities(x))
                times = np.zeros(len(x), dtype=np.int64)
                if len(known):
                    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    times = np.where(known[i] == x, often[i], 0)
                by = np.argsort(times, kind="stable")[:p]
                # A shingle that no other node has pairs nobody.
                at = np.flatnonzero(times[by] > 1) if least == 1 else np.arange(len(by))
                parts.append(x[by[at]].view(np.int32))
                places.append(at.astype(np.int32))
                sizes.append(len(x))
            if not parts:
                continue
            many = [len(x) for x in parts]
            of = pa.array(np.repeat(np.arange(len(many)), many))
            columns = [pa.array(np.concatenate(parts)), batch.column(0).take(of), batch.column(1).take(of), pa.array(np.concatenate(places)), pa.array(np.repeat(sizes, many).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.repeat(m, many)) for m in np.array(marks).T)], names=["shingle", "node", "root", "at", "n", *MARKS])

    return stage(own.mapInArrow(trimmed(run), "shingle int, node long, root long, at int, n int, " + ", ".join(f"{m} long" for m in MARKS)), "near-prefixes")


#: Columns with the parities of a set's shingles in 64 bits each.
MARKS = ("m0", "m1", "m2", "m3")


def parities(x: np.ndarray) -> np.ndarray:
    """For each of 256 bits whether an odd number of the shingles falls on it. Of two sets, what they share cancels out: no more bits differ than shingles are in one of them only."""
    odd = np.bincount((mix(x) >> np.uint64(40)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def size_class(similarity: float):
    """Class of a set's size n, 0 to 62: sets of the similarity are in the same class or in neighbouring ones."""
    return F.least(F.floor(F.log("n") / float(max(-np.log(similarity), 1e-6) * (1 + 1e-9))), F.lit(62)).cast("int")


def sizes_at(first: DataFrame) -> DataFrame:
    """For each shingle, as bits: size classes that have it, those in which several components do, those in which a set has it early enough to be the smaller of a pair."""
    bit = F.expr("shiftleft(1L, size)")
    by_size = first.groupBy("shingle", "size").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or("early").alias("early"))
    none = F.lit(0).cast("long")
    return by_size.groupBy("shingle").agg(
        F.bit_or(bit).alias("held"), F.bit_or(F.when(F.col("lo") < F.col("hi"), bit).otherwise(none)).alias("twice"), F.bit_or(F.when(F.col("early"), bit).otherwise(none)).alias("led")
    )


def partnered():
    """Whether another component may have a set that fits the row's at its shingle.

    The smaller set of a pair has the shingle early; the larger one is of its class or the next. What this leaves
    out, the test of the pair would exclude.
    """
    return F.expr(
        "(early and (twice & shiftleft(1L, size) | held & shiftleft(1L, size + 1)) <> 0)"
        " or (led & (shiftleft(1L, size) | shiftright(shiftleft(1L, size), 1))) <> 0 and (not early or twice & shiftleft(1L, size) <> 0 or led & shiftright(shiftleft(1L, size), 1) <> 0)"
    )


def sizes_fit(similarity: float):
    return F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6


def parities_fit(similarity: float):
    """The bits in which the parities differ bound how many shingles aren't common."""
    apart = reduce(lambda s, c: s + c, [F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MARKS])
    return apart * (1 + similarity) <= (1 - similarity) * (F.col("na") + F.col("nb")) + 1e-6


def marked(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, n and parities of the sets of the nodes."""

    def run(batches):
        for batch in batches:
            found = [np.frombuffer(raw, np.uint32) for raw in batch.column(1).to_pylist()]
            marks = np.array([parities(x) for x in found], dtype=np.int64).reshape(-1, len(MARKS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int32()), *(pa.array(m) for m in marks.T)], names=["node", "n", *MARKS])

    own = (F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes).join(sets, "node").select("node", "shingles")
    return stage(own.mapInArrow(trimmed(run), "node long, n int, " + ", ".join(f"{m} long" for m in MARKS)), "near-marks")


def within(rooted: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes of different components in a bucket that sizes and parities don't exclude.

    For buckets of a bounded number of nodes: a row meets no more rows than that.
    """
    rows = rooted.join(marked(rooted.select("node").distinct(), sets), "node")
    rows = stage(rows, "near-rows")
    side = lambda c: rows.select("bucket", F.col("node").alias(c), F.col("root").alias(f"r{c}"), F.col("n").alias(f"n{c}"), *[F.col(m).alias(f"{c}_{m}") for m in MARKS])
    pairs = side("a").join(side("b"), "bucket").where((F.col("a") > F.col("b")) & (F.col("ra") != F.col("rb")) & sizes_fit(similarity) & parities_fit(similarity))
    return pairs.select("a", "b").distinct()


def across(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes (node, root) of different components that sizes, prefixes and parities don't exclude.

    At a shingle, all that is outside of its most frequent component is paired; so a large component isn't
    paired with itself. Rows without a partner of a fitting size are left out before. What follows the first
    common shingle bounds how many can be common.
    """
    first = prefixes(nodes, sets, similarity)
    first = first.withColumn("size", size_class(similarity)).withColumn("early", (F.col("n") - F.col("at")) * (1 + similarity) >= 2 * similarity * F.col("n") - 1e-6)
    top = first.groupBy("shingle", "root").agg(F.count("*").alias("c")).groupBy("shingle").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("c"), F.count("*").alias("k")).where("k > 1")
    top = top.select("shingle", F.col("m.root").alias("most"), F.ceil((F.col("c") - F.col("m.c")) / F.lit(PER_SHINGLE)).cast("int").alias("_n"))
    both = stage(first.join(top.join(sizes_at(first), "shingle"), "shingle").where(partnered()).drop("size", "early", "held", "twice", "led"), "near-shared")
    x = both.where("root <> most").withColumn("_salt", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")).select("shingle", "_salt", "most", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("at").alias("i"), F.col("n").alias("na"), *[F.col(m).alias(f"a_{m}") for m in MARKS])
    y = both.select("shingle", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_salt"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("at").alias("j"), F.col("n").alias("nb"), *[F.col(m).alias(f"b_{m}") for m in MARKS])
    fits = sizes_fit(similarity) & (F.least(F.col("na") - F.col("i"), F.col("nb") - F.col("j")) * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-6)
    once = (F.col("rb") == F.col("most")) | (F.col("a") < F.col("b"))
    found = x.join(y, ["shingle", "_salt"]).where((F.col("ra") != F.col("rb")) & once & fits & parities_fit(similarity))
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def unresolved(members: DataFrame, roots: DataFrame | None, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes of different components, in buckets with several ones, that aren't excluded: none is left open."""
    rooted = members.select("bucket", "node", F.col("node").alias("root"))
    if roots is not None:
        rooted = members.select("bucket", "node").join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("k")).where("r0 < r1")
    rooted = stage(rooted.join(stage(open_.select("bucket", "k"), "near-buckets"), "bucket"), "near-open")
    few = within(rooted.where(F.col("k") <= SMALL).drop("k"), sets, similarity)
    large = stage(rooted.where(F.col("k") > SMALL).select("node", "root").distinct(), "near-open")
    return few.unionByName(across(large, sets, similarity)).distinct() if large.limit(1).count() else few


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for the nodes of the links (a, b).

    Least labels go along the links, and from label to label, until nothing changes. Every round is written.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    labels = stage(labels, "near-roots")
    while True:
        least = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(least, labels.node == least.a, "left").select("node", "root", F.least("root", "near").alias("next"))
        onward = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        step = step.join(onward, F.col("next") == F.col("_n"), "left").select("node", F.least("next", "_r").alias("root"), (F.least("next", "_r") < F.col("root")).alias("moved"))
        step = stage(step, "near-roots")
        labels = step.select("node", "root")
        if not step.where("moved").limit(1).count():
            return labels


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, class_size, n_copies for each row of docs.

    Rows are in one class if they are linked: by the same words in the same order, or by a Jaccard similarity of
    their sets of shingles of at least `similarity`, directly or through others. class_id is the least doc_id of
    the class (null if no row of it has one), class_size its rows, n_copies the rows with the same words. Texts
    shorter than a shingle are one shingle. Texts without a word, among them null and empty ones (which are
    the same), are in a class with rows of the same bytes only. Very long texts are compared whole. Rows that repeat are
    rows of the class each. An empty table gives an empty result. Other columns are ignored.

    A pair of similarity s shares a band with probability 1 - (1 - s^rows)^bands (at 0.8: 1 - 3e-6). Every
    pair that shares one is then linked through others, verified, or excluded by its sizes and prefixes.
    """
    small_batches(docs.sparkSession)
    signed = stage(sign(docs, id_col, text_col, bands, rows), "near-signed")
    nodes = stage(signed.groupBy("node", "check").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.any_value("bands").alias("bands")), "near-nodes")
    every = nodes.select("node", F.explode("bands").alias("bucket"))
    # A bucket counts if two nodes are in it; least and greatest node, kept for each bucket, say so.
    spread = every.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min_by("node", F.xxhash64("node")).alias("mid")).where("lo < hi")
    # A row a bucket against the nodes of each: a join whose large buckets the adaptive plan splits, as both sides are plain exchanges.
    members = stage(every.join(stage(spread.select("bucket", "mid"), "near-buckets"), "bucket").select("bucket", "node", "mid"), "near-members")
    roots = None
    if members.limit(1).count():
        sets = sets_of(docs, members.select("node").distinct(), text_col)
        links = stage(by_leaders(members, sets, similarity), "near-found")
        roots = components(links) if links.limit(1).count() else None
        left = stage(unresolved(members, roots, sets, similarity), "near-pairs")
        if left.limit(1).count():
            found = stage(verify(left, sets, similarity), "near-found")
            if found.limit(1).count():
                roots = components(links.unionByName(found))
    group = nodes.drop("bands")
    group = group if roots is None else group.join(roots, "node", "left")
    group = group.withColumn("root", F.coalesce("root", "node") if roots is not None else F.col("node"))
    total = group.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = stage(group.join(total, "root").select("node", "check", "class_id", "class_size", F.col("n").alias("n_copies")), "near-classes")
    many = by_node.where("class_size > 1")
    out = signed.select("doc_id", "node", "check").join(many, ["node", "check"], "left")
    return out.select("doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
