import numpy as np
from pyspark.sql import functions as F

from framewright.llm import langid as L
from framewright.llm.toxicity import remainder

SF = "/root/testdata/sf0.1"


def slow_grams(text):
    out, last = [0], 0
    for c in text:
        low = ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else (ord(c) if c.isalpha() else 0)
        if low or last:
            out.append(low)
        last = low
    if out[-1]:
        out.append(0)
    if not any(out):
        return []
    keys = [(out[i] << 42) | (out[i + 1] << 21) | out[i + 2] for i in range(len(out) - 2)]
    return [int(L.mix(np.array([k], dtype=np.uint64))[0]) % L.BUCKETS for k in keys]


def test_grams():
    for text in ("Hello, world", "", "...", " a", "a ", "Été  x", "12 é 3", "日本"):
        assert list(L.grams(text)) == slow_grams(text), text


def test_em_finds_proportions():
    p = np.array([[0.7, 0.1], [0.2, 0.2], [0.1, 0.7]])
    share, _ = L._em(p, 1000 * (p @ np.array([0.25, 0.75])), 500)
    assert abs(share[0] - 0.25) < 1e-3


def test_held_out_accuracy(spark):
    got = L.op10_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 40")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).collect()[0]
    assert r.n > 1000 and r.a > 0.97


def test_mixture_of_two(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.train(docs, lambda i: remainder(i, 4) != 2)
    en, de = (docs.where(f"lang = '{x}' and n_chars between 2000 and 3000").orderBy("doc_id").first().text for x in ("en", "de"))
    both = model.mixture(en + "\n" + de)
    assert set(both) == {"en", "de"} and 0.3 < both["en"] < 0.7
    assert list(model.mixture(en)) == ["en"]
    assert model.predict(None) == model.predict("123 ...") == ("und", 0.0)


def test_tables(spark):
    rows = [(1, "the house and the garden", "en", "x"), (2, "das haus und der garten", "de", "y"), (3, None, "de", "z"), (4, "", None, "z"), (5, "der baum " * 30000, None, None), (None, "the tree", "en", None), (1, "the house and the garden", "en", "x"), (7, "...", "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = L.train(docs, lambda i: F.lit(True))
    got = L.identify(docs, model, mixture_col="mix").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[5].lang_pred == "de" and by[3].lang_pred == by[4].lang_pred == by[7].lang_pred == "und" and by[1].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got) and by[3].mix == {}
    none = L.train(docs.limit(0), lambda i: F.lit(True))
    assert {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


def test_letters_of_all_planes():
    import sys
    import unicodedata

    from framewright.llm import langid

    table = langid._tables()
    for i in range(sys.maxunicode + 1):
        if not 0xD800 <= i < 0xE000:
            letter = table[min(i, len(table) - 1)] > 0
            assert letter == unicodedata.category(chr(i)).startswith("L") or i < 0x300, hex(i)
