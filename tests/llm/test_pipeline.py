import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from framewright.llm import byte_bpe
from tests.llm import test_decontaminate as leaks
from tests.llm import test_minhash as near
from tests.llm import test_suffix as repeats

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    one = C.stage(C.drop_toxic(spark, docs, SF), "test")
    rows = {r.doc_id: r for r in one.collect()}
    assert one.columns == docs.columns
    assert sum(labels.get(i) == 1 for i in rows) <= 0.1 * sum(v == 1 for v in labels.values())
    assert sum(labels.get(i) == 0 for i in rows) >= 0.97 * sum(v == 0 for v in labels.values())

    two = C.stage(C.drop_near_copies(spark, one, SF), "test")
    kept = {r.doc_id: r.text for r in two.collect()}
    classes = {}
    for i, c, *_ in near.brute([(r.doc_id, r.text) for r in rows.values()]):
        classes.setdefault(c, []).append(i)
    assert two.count() == len(kept) == len(classes) and all(sum(i in kept for i in m) == 1 for m in classes.values())

    three = C.stage(C.cut_repeats(spark, two, SF), "test")
    cut = {r.doc_id: r for r in three.collect()}
    repeated = {sorted(kept.items())[k][0] for k in repeats.brute(sorted(kept.items()), 50)}
    assert set(cut) == set(kept) and all(cut[i].text == kept[i] for i in kept if i not in repeated)
    assert all(r.n_chars == len(r.text) for r in cut.values() if r.text is not None)
    assert not repeats.brute([(i, r.text) for i, r in sorted(cut.items())], 60)

    four = C.stage(C.drop_leaks(spark, three, SF), "test")
    bad = {i for i, _ in leaks.brute([(i, r.text) for i, r in cut.items()], items)}
    left = {r.doc_id for r in four.collect()}
    assert left == set(cut) - bad

    five = C.encode(spark, four, SF).collect()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert {r.doc_id for r in five} == left and all(r.token_ids == enc.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids) for r in five)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", None, None, 3), (3, "a b", None, None, 3), (None, "c d", "en", None, 3), (4, "x " * 3000, "en", "s", 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (docs, docs.limit(0)):
        d = table
        for _, f in C.STAGES:
            d = C.stage(f(spark, d, SF), "test")
        assert d.count() == (5 - 1 if table is docs else 0)  # the empty text and none are copies of each other, and so are the rows of 3
