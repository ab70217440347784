"""A corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
each result to the shared folder and reads it again for the next stage. All
stages but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersmith.llm import bpe, decontaminate, language_id, line_dedup, minhash
from tiersmith.llm.frames import free_name, table, written


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a language that the model can tell."""
    model = language_id.fit(docs)
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = language_id.predict(docs, model, keep=tuple(docs.columns), names=(lang, score))
    return found.where(language_id.accepted(F.col(lang), F.col(score))).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shorten texts by passages and chunks that stand elsewhere before; a document of which nothing is left goes."""
    whole = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    done = line_dedup.deduplicate_passages(whole).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group; rows that repeat an id stay or go together."""
    gone = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which a window of a test item occurs."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_and_verify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, passed on if they decode to its text (compared by 64-bit hash)."""
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    printed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("print"))
    done = bpe.round_trip(printed, vocabulary, keep=("doc_id", "print"))
    return done.where(F.col("print") == F.xxhash64("decoded")).select(
        "doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.col("ids").alias("token_ids"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode_and_verify),
]

#: Language models, signatures and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
