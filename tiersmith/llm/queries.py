"""The registered queries of this folder and their SQL twins."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersmith.llm import (bpe, conversations, decontaminate, language_id, line_dedup, minhash, ppm, quality, quality_rules, site_tree,
                           token_store, top_k, whitening)
from tiersmith.llm.frames import remainder, table
from tiersmith.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


@register
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    done = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)
    return done.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", "text")


SQL["op10_line_dedup"] = line_dedup.SQL


@register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


SQL["op7_decontamination"] = decontaminate.SQL


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


@register
def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read(spark, path)


@register
def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 7) == 2)
    counts = ppm.count(docs.where(~F.col("held_out")))
    plain = ppm.unigram(docs.withColumn("print", ppm.print_of()), counts, keep=("doc_id", "held_out", "print"))
    return plain.join(ppm.text_scores(docs, ppm.blocks_of(counts)), "print").drop("print")


@register
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", remainder(F.col("doc_id"), 4) == 2)
    model = quality.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@register
def op1_site_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = site_tree.extract(table(spark, sf_dir, "pages"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


@register
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op5_exact_top_k"] = top_k.SQL


@register
def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.clean(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op13_quality_rules"] = quality_rules.SQL


@register
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with turns dropped, emptied, stripped of their marks, repeated or given to the user, by the hash of their place."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    hurt = rows.withColumn("harm", remainder(place, 20)).where("harm <> 0").select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"))
    return hurt.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def lines_sha256(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines, a conversation's turns lying together in order; nothing is held but a hash state."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = (), hashlib.sha256()
        for batch in batches:
            ids, sums = [], []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != (c,):
                    if now:
                        ids.append(now[0])
                        sums.append(state.hexdigest())
                    now, state = (c,), hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(sums, pa.string())], names=["id", "repaired_sha256"])
            kind = batch.schema.field(0).type
        if now:
            yield pa.record_batch([pa.array([now[0]], kind), pa.array([state.hexdigest()])], names=["id", "repaired_sha256"])

    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.select("conv_id", "role", "text").mapInArrow(run, f"id {kind}, repaired_sha256 string")


@register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = conversations.repair(damaged(rows), rows.select("conv_id"))
    sums = lines_sha256(done.turns)
    return done.summary.join(sums, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id").withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
