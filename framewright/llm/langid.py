"""Language identification as a mixture of languages.

Every language has a distribution over hashed character n-grams. A document's n-grams are taken to come from
a mixture of languages; expectation-maximisation estimates the proportions. The set of languages is the one
of best penalised likelihood: starting from the single best language, a further one is taken in only if the
gain in log likelihood is worth its parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.common import chunks, mix, read
from framewright.llm.toxicity import remainder

#: n-gram length; hash buckets; rounds of expectation-maximisation; penalty of a further language, in units of ln(n-grams)/2.
ORDER, BUCKETS, ROUNDS, PENALTY = 3, 1 << 15, 12, 4.0
#: Bound on the training texts of each language.
TRAIN_ROWS = 3000
ALPHA = 0.5

_letters: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point below 0x33000: its lower case (one code point) if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x33000, dtype=np.uint32)
        for i in range(0x33000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def codes(text: str) -> np.ndarray:
    """A text's letters in lower case, all else as 0, runs of which are one; 0 at both ends. Empty without letters."""
    table = _tables()
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = table[np.minimum(raw, len(table) - 1)]
    keep = (low > 0) | np.append(True, low[:-1] > 0)[: len(low)]
    low = low[keep]
    if not low.any():
        return np.zeros(0, np.uint32)
    return np.concatenate([[0], low[(low > 0).argmax() :], [0] if low[-1] else []]).astype(np.uint32)


def grams(text: str) -> np.ndarray:
    """Buckets of a text's n-grams."""
    c = codes(text).astype(np.uint64)
    n = len(c) - ORDER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(ORDER):
        key = (key << np.uint64(21)) | c[j : j + n]
    return (mix(key) % np.uint64(BUCKETS)).astype(np.int64)


class Model:
    """langs, and the log probability of each bucket in each language (buckets x languages)."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp
        self.p = np.exp(logp)

    def mixture(self, text: str | None) -> dict[str, float]:
        """The chosen languages and their proportions, largest first; empty without letters or without languages."""
        if not text or not self.langs:
            return {}
        g = grams(text)
        if not len(g):
            return {}
        seen, count = np.unique(g, return_counts=True)
        count = count.astype(np.float64)
        total = count.sum()
        single = count @ self.logp[seen]
        best = [int(np.argmax(single))]
        share, fit = np.ones(1), float(single[best[0]])
        if len(self.langs) > 1:
            p = self.p[seen]
            order = _em(p, count, ROUNDS)[0]
            price = PENALTY * 0.5 * np.log(total + 1)
            for lang in np.argsort(-order, kind="stable"):
                if int(lang) in best:
                    continue
                if order[lang] * total < 4:
                    break  # fewer n-grams than a word has
                more, likely = _em(p[:, [*best, int(lang)]], count, ROUNDS)
                if likely - fit <= price:
                    break
                best, share, fit = [*best, int(lang)], more, likely
        rank = sorted(range(len(best)), key=lambda i: (-share[i], self.langs[best[i]]))
        return {self.langs[best[i]]: float(share[i]) for i in rank}

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.mixture(text)
        return next(iter(found.items())) if found else ("und", 0.0)


def _em(p: np.ndarray, count: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions that maximise sum(count * ln(p @ share)), from equal ones, and that sum."""
    share, total = np.full(p.shape[1], 1 / p.shape[1]), count.sum()
    for _ in range(rounds):
        share = share * ((count / (p @ share)) @ p) / total
    return share, float(count @ np.log(p @ share))


def train(docs: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_ROWS) -> Model:
    """A model from the rows with a language for whose id `trains` holds, at most `most` texts of each language.

    Which texts is decided by hashes of their ids alone. Each task sums the n-grams of its texts for each
    language; the driver gets a vector of BUCKETS counts for each language, whatever the number of texts.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & trains(F.col("_id")))
    n = {r["_lang"]: r["count"] for r in d.groupBy("_lang").count().collect()}
    langs = sorted(n)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, most / n[lang]))])
    d = d.where((F.pmod(F.xxhash64("_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("_lang")])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], names=["lang", "bucket", "n"])

    got = d.select("_lang", "_text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((BUCKETS, len(langs)), ALPHA)
    column = {lang: i for i, lang in enumerate(langs)}
    np.add.at(counts, (got["bucket"].to_numpy(), np.array([column[x] for x in got["lang"].to_pylist()], dtype=np.int64)), got["n"].to_numpy())
    return Model(langs, np.log(counts / counts.sum(axis=0)))


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", mixture_col: str | None = None) -> DataFrame:
    """docs with the language of largest proportion and that proportion; with mixture_col, also all chosen languages (map).

    `und` and 0 for null and empty texts, texts without a letter, and all texts if the model has no language.
    Whole texts are read. Rows that repeat get equal results. Columns with the names of results are replaced.
    """
    docs = docs.drop(pred_col, score_col, *([mixture_col] if mixture_col else []))
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.logp))  # BUCKETS numbers a language
    where = docs.columns.index(text_col)
    fields = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())] + ([T.StructField(mixture_col, T.MapType(T.StringType(), T.DoubleType()))] if mixture_col else [])

    def run(batches):
        own = Model(*sent.value)
        for batch in chunks(batches, text_col):
            found = [own.mixture(t) for t in batch.column(where).to_pylist()]
            first = [next(iter(m.items())) if m else ("und", 0.0) for m in found]
            cols = [pa.array([a for a, _ in first], pa.string()), pa.array([min(1.0, b) for _, b in first], pa.float64())]
            if mixture_col:
                cols.append(pa.array([list(m.items()) for m in found], type=pa.map_(pa.string(), pa.float64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, lambda i: remainder(i, 4) != 2)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
