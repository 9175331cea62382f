"""Toxicity scores from a logistic classifier that is regularised by counterfactuals.

Features are the presence of words and of word beginnings. For every training text with an identity term, a
counterfactual is made by swapping its identity terms for others; training adds a penalty on the squared
difference of the two scores, so that the model does not learn to score the mention of a group. The penalty
acts on the weights of features that identity terms switch on and off, and on nothing else.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import chunks, read, small_batches, trimmed

#: Bound on the labelled texts that the classifier is fitted on, half of them of each label where there are as many.
TRAIN_ROWS = 6_000
#: Features kept: those whose presence differs most between the labels, each in MIN_TEXTS texts at least and beyond MIN_G2 of the likelihood-ratio statistic.
#: That statistic grows with the texts for a given difference, so with fewer than FULL_ROWS of them both bounds shrink in proportion (MIN_TEXTS to 2).
FEATURES, MIN_TEXTS, MIN_G2, FULL_ROWS = 4096, 4, 15.0, 450
#: Weight of the counterfactual penalty, of the squared weights, and passes over the sample.
CF_WEIGHT, L2, STEPS = 1.0, 0.002, 300
#: Lengths of word beginnings that are features beside the words.
PREFIXES = (4, 5)

# Neutral terms for groups, in four languages, in interchangeable sets.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "gay", "straight", "lesbian", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "african", "latino", "arab", "european"),
    ("deaf", "blind", "disabled", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen", "schwul", "lesbisch"),
    ("muslimisch", "christlich", "jüdisch", "katholisch", "hinduistisch"),
    ("femmes", "hommes", "filles", "garçons", "homosexuel", "lesbienne"),
    ("musulman", "chrétien", "juif", "catholique", "hindou"),
    ("mujeres", "hombres", "niñas", "niños", "lesbiana"),
    ("musulmán", "cristiano", "judío", "católico", "hindú"),
)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings."""
    return ["=" + word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]


def swapped(found: set[str], groups=IDENTITY_TERMS) -> set[str] | None:
    """The set of words with each identity term replaced by the next of its set that the text doesn't hold; None without identity terms."""
    out, any_ = set(found), False
    for group in groups:
        here = [t for t in group if t in found]
        rest = [t for t in group if t not in found]
        for k, term in enumerate(here):
            if rest:
                out.discard(term)
                out.add(rest[(group.index(term) + k) % len(rest)])
                any_ = True
    return out if any_ else None


class Model:
    """weights: feature -> weight; bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[str, ...]] = {}

    def active(self, found) -> set[str]:
        on: set[str] = set()
        known, weights = self.known, self.weights
        if len(known) > 200_000:
            known.clear()
        for word in found:
            hit = known.get(word)
            if hit is None:
                hit = known[word] = tuple(f for f in features(word) if f in weights)
            if hit:
                on.update(hit)
        return on

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[f] for f in self.active(words(text or "")))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(texts: list[set[str]], labels: np.ndarray, groups=IDENTITY_TERMS, cf_weight: float = CF_WEIGHT, n_features: int = FEATURES) -> Model:
    """Fits on sets of words. Without texts of both labels the score is the share of label 1 (0 without texts)."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model({}, float(np.log((rate + 1e-6) / (1 - rate + 1e-6))))
    counts: dict[str, list[int]] = {}
    for found, label in zip(texts, y, strict=True):
        for f in {f for w in found for f in features(w)}:
            counts.setdefault(f, [0, 0])[int(label)] += 1
    n1, n0 = y.sum(), len(y) - y.sum()

    def g2(a, b):
        rest1, rest0, n = n1 - a, n0 - b, n1 + n0
        cells = ((a, n1 * (a + b) / n), (b, n0 * (a + b) / n), (rest1, n1 * (rest1 + rest0) / n), (rest0, n0 * (rest1 + rest0) / n))
        return 2 * sum(o * np.log(o / e) for o, e in cells if o > 0)

    share = min(1.0, len(y) / FULL_ROWS)
    able = [(g2(b, a), f) for f, (a, b) in counts.items() if a + b >= max(2, MIN_TEXTS * share)]
    swaps = [swapped(t, groups) for t in texts]
    chosen = [f for g, f in sorted(able, key=lambda x: (-x[0], x[1]))[:n_features] if g >= MIN_G2 * share]
    column = {f: i for i, f in enumerate(chosen)}

    def rows(sets):
        at, cols = [0], []
        for s in sets:
            cols += sorted({column[f] for w in s for f in features(w) if f in column})
            at.append(len(cols))
        which = np.repeat(np.arange(len(at) - 1), np.diff(at))
        return np.array(cols, dtype=np.int64), which, len(at) - 1

    def times(m, w):  # m @ w
        return np.bincount(m[1], weights=w[m[0]], minlength=m[2])

    def back(m, v):  # m.T @ v
        return np.bincount(m[0], weights=v[m[1]], minlength=len(chosen))

    x = rows(texts)
    pairs = [(i, s) for i, s in enumerate(swaps) if s is not None]
    who, other = np.array([i for i, _ in pairs], dtype=np.int64), rows([s for _, s in pairs])
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)  # both labels count alike
    w, bias = np.zeros(len(chosen)), 0.0
    m1, m2, c1, c2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = times(x, w) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        dz = weight * (p - y)
        g, gb = back(x, dz) + L2 * w / max(1, len(w)) ** 0.5, dz.sum()
        if len(who):
            z2 = times(other, w) + bias
            apart = cf_weight * 2 * (z[who] - z2) / len(who)  # on the logits, where the gradient doesn't vanish
            here = np.zeros(len(y))
            np.add.at(here, who, apart)
            g += back(x, here) - back(other, apart)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        rate = 0.1 / (1 + 2 * step / STEPS)
        w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        bias -= rate * (c1 / (1 - 0.9**step)) / (np.sqrt(c2 / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(v) for f, v in zip(chosen, w, strict=True) if abs(v) > 1e-6}, float(bias))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trains, most: int) -> tuple[list[set[str]], np.ndarray]:
    """Words of at most `most` labelled training texts, the rows of each label with the smallest hashes of id and label.

    Labels of an id that contradict each other, null labels and null ids are left out; of several texts of an
    id the smallest counts. Each text is reduced to its set of words where it lies.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z"))
    known = known.where("_y = _z").where(trains(F.col("_id")))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most // 2).select("_id", F.col("_y").cast("int").alias("_y"))
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = F.broadcast(chosen)  # `most` rows of two numbers
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_y", "_text")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(sorted(words(t or ""))) for t in batch.column(1).to_pylist()])], names=["y", "words"])

    got = texts.mapInArrow(trimmed(run), "y int, words string").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["y"][i].as_py(), got["words"][i].as_py()))[:most]
    return [set(got["words"][i].as_py().split()) for i in order], np.array([got["y"][i].as_py() for i in order])


def train(docs: DataFrame, labels: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS, groups=IDENTITY_TERMS, cf_weight: float = CF_WEIGHT) -> Model:
    """A model from the labelled rows for whose id `trains` (a function of a column) holds."""
    texts, y = sample(docs, labels, id_col, text_col, label_col, trains, most)
    return fit(texts, y, groups, cf_weight)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, from 0 to 1.

    Null and empty texts get the score of a text without known features; texts are read whole; rows that
    repeat get equal scores; a column named score_col is replaced, others pass.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # FEATURES entries at most
    where = docs.columns.index(text_col)

    def run(batches):
        own = Model(*sent.value)
        for batch in chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.score(t) for t in batch.column(where).to_pylist()], pa.float64())], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def remainder(i, of: int):
    """crc32 of an id's text, mod `of`; of a null id, that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(i.cast("string"), F.lit(""))), F.lit(of))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"), lambda i: remainder(i, 5) != 0)
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
