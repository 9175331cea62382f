"""A training corpus from documents: toxic ones out, near copies out, repeated passages out, leaks out, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run writes each stage's result as Parquet to
the shared folder and hands the next one what it reads back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import byte_bpe, decontaminate, minhash, suffix, toxicity
from framewright.llm.common import read, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under TOXIC_FROM in a classifier learnt from the labelled ones among docs."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), lambda i: F.lit(True))
    return toxicity.score(docs.select(*COLUMNS), model, score_col="_score").where(F.col("_score") < TOXIC_FROM).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates. Rows are told apart by a hash of id and text; rows equal in both are one."""
    keyed = docs.select(*COLUMNS).withColumn("_k", F.xxhash64("doc_id", "text"))
    stay = minhash.classes(keyed, id_col="_k").where("doc_id = class_id").select(F.col("doc_id").alias("_k")).distinct()
    return keyed.join(stay, "_k", "left_semi").dropDuplicates(["_k"]).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of suffix.MIN_WORDS words and more that a document with a smaller id has."""
    return suffix.cut(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark."""
    return decontaminate.clean(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; a text that its ids don't decode to stops the job."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = byte_bpe.encode(docs.select(*COLUMNS), ranks, public_tokenizers.PATTERN, checked=True)
    return out.select(*COLUMNS, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("repeated_passages", cut_repeats), ("decontamination", drop_leaks), ("byte_bpe", encode)]

#: No SQL has the classifier or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
