"""The pipeline: its rows against the operators' brute-force versions, odd and empty tables, unusual columns."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_module
import corpus_pipeline
from tiersmith.llm import queries
from tiersmith.llm.frames import written

SF = "/root/testdata/sf0.001"


def test_registered_queries():
    names = set(queries.QUERIES)
    assert len(names) == 14 and "pipeline" in names and {n.split("_")[0] for n in names} == {"pipeline", *(f"op{k}" for k in range(1, 14))}
    assert names <= set(entry_module.queries()) and set(queries.SQL) <= names


def test_stages_on_the_documents(spark):
    from test_near_dedup import brute
    from test_text_operators import brute_hits

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = written(stage(spark, docs, SF), name)
        after = {r.doc_id: r for r in docs.collect()}
        assert name == "bpe_encoding" or docs.columns == columns
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "line_dedup":
            assert all(set(r.text.split("\n")) <= set(before[i].text.split("\n")) and r.n_chars == len(r.text) for i, r in after.items())
        elif name == "minhash_near_dedup":
            assert set(after) == {i for i, (_, c) in brute([(r.doc_id, r.text) for r in before.values()]).items() if i == c}
        elif name == "benchmark_decontamination":
            assert set(after) == {i for i, r in before.items() if brute_hits(r.text, items)[1] == 0} and len(after) < len(before)
        else:
            assert set(after) == set(before)
            for i, r in after.items():
                ids = library.encode(before[i].text, add_special_tokens=False).ids
                assert np.frombuffer(r.token_ids, np.uint32).tolist() == ids and r.n_tokens == len(ids)


def _store(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    df.sparkSession.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    clash = odd_docs.withColumn("lang_pred", F.lit("x")).withColumn("n_hit", F.lit(5)).withColumn("items", F.lit("y")).withColumn(
        "kept", F.lit(False)).withColumn("ids", F.lit(1))
    got = {r.doc_id for r in corpus_pipeline.run(spark, _store(clash, tmp_path / "a")).collect()}
    assert 9 in got and got.isdisjoint({1, 2, 3, 12, 7, 5})
    assert corpus_pipeline.run(spark, _store(no_docs, tmp_path / "b")).count() == 0


def test_planted_cases(spark, tmp_path):
    """Copies, near copies, test passages and shared passages go; clean documents stay as they are."""
    rng = random.Random(6)
    source = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").collect()]
    pool = [w for t in source for w in t.split() if w.isascii()]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = {i: "\n".join(text(30) for _ in range(5)) for i in range(20)}
    passage = text(70)
    rows = [*clean.items(), (100, clean[3]), (101, clean[4].replace("\n", " ", 2)), (102, text(40) + " " + item + " " + text(40)),
            (103, text(40) + "\n" + passage), (104, text(30) + "\n" + passage + "\n" + text(20)), (105, "1234 !!! 99"), (106, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = {}
    docs = df
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, SF), name)
        stages[name] = {r.doc_id: r.text for r in docs.collect()}
    assert {105, 106}.isdisjoint(stages["language_id"]) and set(clean) <= set(stages["language_id"])
    assert 100 not in stages["line_dedup"] and passage in stages["line_dedup"][103] and passage not in stages["line_dedup"][104]
    assert 102 not in stages["benchmark_decontamination"]
    assert {i: stages["benchmark_decontamination"][i] for i in clean} == clean
