"""Language, quality, decontamination, lines, BPE, token store and PPM: odd tables, brute force, round trips."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tiersmith.llm import bpe, decontaminate, language_id, line_dedup, ppm, quality, token_store
from tiersmith.llm.frames import remainder

SF = "/root/testdata/sf0.01"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_remainder_is_the_public_checksum(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 5, 123456789, None)], "i long").select("i", remainder(F.col("i"), 7)).collect()
    assert [r[1] for r in rows] == [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 for r in rows]


# language

def test_languages_of_held_out_documents(docs):
    model = language_id.fit(docs.where(remainder(F.col("doc_id"), 3) != 1))
    got = language_id.predict(docs.where(remainder(F.col("doc_id"), 3) == 1), model, keep=("doc_id", "lang"))
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right > 0.98 and n > 200 and low >= 0 and high <= 1


def test_language_of_odd_documents(docs, odd_docs, no_docs):
    model = language_id.fit(docs)
    got = {(r.doc_id, r.v): r for r in language_id.predict(odd_docs, model, keep=("doc_id", "v", "score", "k0")).withColumnRenamed("k0", "extra").select("doc_id", "v", "lang_pred", "extra").collect()}
    assert {i for (i, _), r in got.items() if r.lang_pred == "und"} >= {1, 2, 3, 12}
    assert got[4, "y"].lang_pred in model["langs"] and got[9, "y"].lang_pred in model["langs"]
    assert language_id.predict(no_docs, model).count() == 0
    nothing = language_id.fit(no_docs)
    assert language_id.predict(odd_docs, nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def test_long_rows_score_as_one(docs):
    """A row longer than the piece size gets the mean over all its bytes."""
    weights = np.random.default_rng(1).normal(size=(2, language_id.BUCKETS)).astype(np.float32)
    data = np.random.default_rng(2).integers(97, 123, 9_000_000, np.uint8)
    two, three = language_id.gram_buckets(data, np.array([0, len(data)]))
    want = [(w[two].astype(float) + w[three]).mean() for w in weights]
    assert np.allclose(language_id.row_means(weights, data, np.array([0, len(data)]))[0], want, atol=1e-4)


def test_a_family_with_one_language_and_unknown_codes(spark):
    rows = [(i, w, l) for i, (w, l) in enumerate([("der die das und nicht", "de"), ("les des une dans avec", "fr"), ("que los para una ción", "es"),
                                                  ("qwxz zzxq qqzx", "x-own")] * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df, language_id.fit(df), keep=("lang",))
    assert got.where("lang <> lang_pred").count() == 0


def test_a_language_of_copies_is_learned_from_a_bounded_sample(spark, monkeypatch):
    rng = random.Random(5)
    words = {"en": "the of and that with", "fr": "les des une dans avec", "ru": "это как так что для", "tr": "bir için daha olan gibi"}
    text = lambda lang: " ".join(rng.choice(words[lang].split()) for _ in range(12))
    rows = [(lang, t) for lang in ("ru", "tr") for t in [text(lang)] * 3000 + [text(lang) for _ in range(5)]]
    rows += [(lang, text(lang)) for lang in ("en", "fr") for _ in range(300)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(6)
    sizes, separate = [], language_id.separate
    monkeypatch.setattr(language_id, "separate", lambda x, sign: sizes.append(len(x)) or separate(x, sign))
    model = language_id.fit(df, per_language=30)
    assert model["langs"] == ["en", "fr", "ru", "tr"] and set(sizes) == {4 * (30 + 30 + 6 + 6)}
    got = language_id.predict(df, model, keep=("lang",))
    assert got.where("lang <> lang_pred").count() == 0


# quality

def test_quality_of_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = remainder(F.col("doc_id"), 4) == 2
    got = quality.score(docs, quality.fit(docs.where(~held), labels), keep=("doc_id",)).where(held).join(labels, "doc_id")
    assert got.agg(F.avg(((F.col("score") >= 0.7).cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.93


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (9, 0), (None, 1), (13, None), (77, 1)], "doc_id long, quality int")
    model = quality.fit(odd_docs, labels)
    rows = quality.score(odd_docs, model, keep=("doc_id", "score")).toDF("doc_id", "old", "p").collect()
    blank = {r.p for r in rows if r.doc_id in (1, 2, 3)}
    assert len(rows) == odd_docs.count() and len(blank) == 1 and all(0 <= r.p <= 1 for r in rows)
    assert quality.score(no_docs, model).count() == 0
    untrained = quality.fit(odd_docs, labels.limit(0))
    assert {r.score for r in quality.score(odd_docs, untrained).collect()} == {0.5}


# decontamination

def brute_hits(text, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        if not v:
            continue
        k = min(width, len(v))
        wins = {tuple(v[p:p + k]) for p in range(len(v) - k + 1)}
        for p in range(len(w) - k + 1):
            if tuple(w[p:p + k]) in wins:
                hit |= set(range(p, p + k))
                names.add(None if name is None else str(name))
    return len(w), len(hit), sorted(names, key=lambda v: (v is None, v))


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_hits_of_windows_against_brute_force(spark, odd_docs, block_bytes):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdé" for b in "xyz1"]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate([0, 1, 4, 9, 10, 11, 30])]
    items += [(7, None), (None, "alpha beta"), (6, items[6][1]), (8, "gamma3, ALPHA4! beta4 gamma4"), (9, "--- ...")]
    rows = []
    for k in range(60):
        t = [rng.choice(words) for _ in range(rng.choice([0, 5, 60]))]
        for _ in range(rng.choice([0, 1, 2])):
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(own) + 1)
            t[len(t) // 2:len(t) // 2] = own[at:]
        rows.append((100 + k, rng.choice([" ", "  ", "\n", "; "]).join(t).title()))
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted([(r.doc_id, (r.n_words, r.n_hit, r["items"])) for r in decontaminate.scan(df, bench, block_bytes=block_bytes).collect()], key=str)
    want = sorted([(r.doc_id, brute_hits(r.text, items)) for r in df.collect()], key=str)
    assert got == want
    if block_bytes > 60:
        left = decontaminate.without_documents(df, bench).collect()
        assert sorted(str(r.doc_id) for r in left) == sorted(str(i) for i, w in want if w[1] == 0)
        cut = decontaminate.without_spans(df, bench)
        assert cut.columns == df.columns and cut.count() == df.count()
        clean = {str(i) for i, w in want if w[1] == 0 and i is not None}
        before = sorted((str(r.doc_id), str(r.text)) for r in df.collect() if str(r.doc_id) in clean)
        assert sorted((str(r.doc_id), str(r.text)) for r in cut.collect() if str(r.doc_id) in clean) == before


def test_items_without_an_id_equal_the_sql(spark):
    """A passage of an item without an id is a hit, counts as one item and adds nothing to the joined ids."""
    import duckdb
    import pandas as pd

    documents = pd.DataFrame({"doc_id": [1, 2, 3], "text": [f"before {' '.join(f'w{k}' for k in range(12))} after", "nothing here", "alpha beta gamma"]})
    benchmark = pd.DataFrame({"item_id": [None, None, "b", "a"], "text": [" ".join(f"w{k}" for k in range(10)), "w3 w4", "alpha beta", "Beta, gamma"]})
    con = duckdb.connect()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    want = sorted(con.execute(decontaminate.SQL).fetchall())
    found = decontaminate.scan(spark.createDataFrame(documents), spark.createDataFrame(benchmark.values.tolist(), "item_id string, text string"))
    got = found.selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as long)", "sha2(cast(array_join(items, ',') as binary), 256)", "n_hit > 0")
    assert sorted(map(tuple, got.collect())) == want and want[0][2:4] == (10, 1)


def test_no_items_and_no_documents(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.without_documents(odd_docs, bench).count() == odd_docs.count()
    assert decontaminate.without_documents(odd_docs, bench).columns == odd_docs.columns
    assert decontaminate.scan(no_docs, bench).count() == 0


# lines

def test_lines_of_odd_documents(odd_docs, no_docs):
    got = line_dedup.deduplicate(odd_docs)
    assert got.count() == odd_docs.count() and set(got.columns) == {*odd_docs.columns, "n_removed"}
    by = {r.doc_id: r for r in got.collect() if r.doc_id}
    assert by[1].text is None and by[1].n_lines == 0 and by[2].text == "" and by[2].n_lines == 1
    assert by[7].text == "" and by[7].n_removed == 1 and by[6].n_removed == 0  # 180 words in one line
    assert line_dedup.deduplicate(no_docs).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_repeated_chunks_go_and_the_first_stays(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    rng = random.Random(2)
    run = [" ".join(f"r{rng.randrange(900)}" for _ in range(8)) for _ in range(40)]
    long = " ".join(f"p{k}" for k in range(60))
    rows = []
    for i in range(30):
        own = [" ".join(f"d{i}x{rng.randrange(900)}" for _ in range(8)) for _ in range(6)]
        rows.append((i, "\n".join(own[:i % 4] + run[i % 3:] + own[i % 4:] + [long] + ["end."])))
    rows.append((99, "only\nclean\nlines"))
    got = {r.doc_id: r for r in line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got[0].text == rows[0][1] and got[99].text == rows[-1][1]
    for i, text in rows[1:-1]:
        assert long not in got[i].text and "end." in got[i].text
        assert all(x in got[i].text for x in text.split("\n") if x.startswith("d"))
        assert got[i].n_lines == text.count("\n") + 1 and got[i].n_removed == got[i].n_lines - (got[i].text.count("\n") + 1)
        assert got[i].n_removed > 25  # boundaries are found again behind a shift


def test_line_dedup_plan_is_native(odd_docs):
    plan = line_dedup.deduplicate(odd_docs)._jdf.queryExecution().toString() if hasattr(odd_docs, "_jdf") else ""
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_repeated_passages_of_any_layout_go_whole(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shapes = [[30, 30], [20] * 3, [15] * 4, [10] * 6, [20] * 6, [20] * 8, [5] * 12, [60, 5, 5], [5, 5, 60], [1] * 51, [40, 0, 0, 11], [60, 0, 60], [0, 70, 0, 3, 0, 60]]
    rows, passages = [], []
    for k, shape in enumerate(shapes):
        passages.append([text(n) for n in shape])
        for i in (2 * k, 2 * k + 1):
            rows.append((i, [text(rng.choice([3, 12])) for _ in range(4)], passages[-1], [text(rng.choice([3, 12])) for _ in range(4)]))
    few = [text(50)]  # one line of no more than 50 words stays
    rows += [(100, [text(60)], few, [text(60)]), (101, [text(60)], few, [text(60)])]
    again = text(10)
    whole = {i: "\n".join(a + b + c) for i, a, b, c in rows} | {200: "\n".join([again] * 20), 201: None, 202: ""}
    df = spark.createDataFrame(list(whole.items()) + [(0, whole[0])], "doc_id long, text string").repartition(3)
    done = line_dedup.deduplicate_passages(df)
    got = {r.doc_id: r for r in done.collect()}
    assert done.count() == len(whole) + 1 and "Python" not in done._jdf.queryExecution().toString()
    for k, passage in enumerate(passages):
        _, before, _, behind = rows[2 * k + 1]
        inner = range(min(i for i, x in enumerate(passage) if x), max(i for i, x in enumerate(passage) if x) + 1)
        want = before + [x for i, x in enumerate(passage) if i not in inner] + behind
        # blank lines at an edge of a passage may go with it
        assert got[2 * k].text == whole[2 * k] and [x for x in got[2 * k + 1].text.split("\n") if x] == [x for x in want if x], shapes[k]
        assert got[2 * k + 1].n_removed >= len(inner) and got[2 * k + 1].n_lines == whole[2 * k + 1].count("\n") + 1
    assert all(got[i].text == whole[i] for i in (100, 101, 201, 202))
    assert got[200].text == "\n".join([again] * 6) and got[200].n_removed == 14  # the first window stays whole


# BPE

@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(BYTE_BPE))


def test_codes_are_the_public_library_s(encoder):
    rng = random.Random(1)
    library = Tokenizer.from_file(BYTE_BPE)
    alphabet = list(" \n\t'aaabbeinrsth1.,!é　\xa0ß世\x85\x1c\x01") + ["<|endoftext|>", "the", "ing", "'ll", "  "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(4000)]
    texts += ["a" * k for k in range(100)] + ["ab" * k for k in range(50)] + ["", " ", "\n", "<|endoftext|>"]
    got = [np.frombuffer(x, np.uint32).tolist() for x in bpe._encoded(encoder, pa.array(texts))]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    packed = [np.array(x, np.uint32).tobytes() for x in want]
    assert bpe._decoded(encoder, packed) == library.decode_batch(want, skip_special_tokens=False)


def test_pair_test_agrees_with_merging(encoder):
    """Compatible pairs are those whose joint text merges to the pair."""
    rng = np.random.default_rng(3)
    special = set(encoder.v.added.values())
    ids = np.array([i for i, t in enumerate(encoder.v.tokens) if i not in special and len(t) < 9])
    x, y = rng.choice(ids, 4000), rng.choice(ids, 4000)
    words = [encoder.v.tokens[a] + encoder.v.tokens[b] for a, b in zip(x.tolist(), y.tolist())]
    data, stops = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    owner, token = encoder.merged(data, np.concatenate([[0], stops[:-1]]), stops)
    merged = np.split(token, np.flatnonzero(np.diff(owner)) + 1)
    same = np.array([m.tolist() == [a, b] for m, a, b in zip(merged, x.tolist(), y.tolist())])
    assert (encoder.compatible(x, y) == same).all()


def test_forgetting_does_not_change_codes(encoder, monkeypatch):
    texts = [f"some words {k} and {k * k} more" for k in range(200)]
    want = bpe._encoded(encoder, pa.array(texts))
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [bpe._encoded(encoder, pa.array([t]))[0] for t in texts] == want


def test_bpe_of_odd_documents(odd_docs, no_docs):
    vocabulary = bpe.Vocabulary(BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    rows = bpe.round_trip(odd_docs, vocabulary, keep=("doc_id", "text", "id")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, np.uint32).tolist() == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    encoded = bpe.encode(odd_docs, vocabulary, keep=("doc_id", "text"))
    again = bpe.decode(encoded.withColumnRenamed("text", "old"), vocabulary, keep=("old",)).collect()
    assert all(r.text == (r.old or "") for r in again)
    assert bpe.round_trip(no_docs, vocabulary).count() == 0


# token store

def test_codes_give_random_access():
    rng = random.Random(0)
    for n in (0, 1, 511, 512, 513, 3000):
        ids = np.array([rng.choice([rng.randrange(200), rng.randrange(50_000), rng.randrange(1 << 32)]) for _ in range(n)], np.uint32)
        codes = token_store.Codes(token_store.pack(ids))
        assert len(codes) == n and (codes.all() == ids).all() and [codes[i] for i in range(n)] == ids.tolist()
        with pytest.raises(IndexError):
            codes[n]


def test_store_of_odd_documents(spark, odd_docs, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT", 50)
    library = Tokenizer.from_file(WORD_BPE)
    token_store.write(odd_docs, str(tmp_path / "a"), WORD_BPE)
    got = token_store.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd_docs.collect()]
    assert [g.doc_id for g in got] == sorted([i for i, _ in want], key=lambda i: (i is not None, i))
    checks = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want)
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == checks
    assert [g.start for g in got] == np.cumsum([0] + [g.n_tokens for g in got[:-1]]).tolist()
    one = next(g for g in got if g.doc_id == 14)
    ids = dict((i, x) for i, x in want if i == 14)[14]
    assert [token_store.token(spark, str(tmp_path / "a"), one.start + k) for k in (0, len(ids) - 1)] == [ids[0], 2]
    token_store.write(no_docs, str(tmp_path / "b"), WORD_BPE)
    assert token_store.read(spark, str(tmp_path / "b")).count() == 0


# PPM

def brute_ppm(training):
    grams = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for t in training:
        b = bytes([ppm.START] * ppm.ORDER) + (t or "").translate(LOWER).encode() + bytes([ppm.STOP])
        for p in range(ppm.ORDER, len(b)):
            for k in range(ppm.ORDER + 1):
                grams[k][b[p - k:p]][b[p]] += 1

    def score(text):
        b, out = bytes([ppm.START] * ppm.ORDER) + (text or "").translate(LOWER).encode() + bytes([ppm.STOP]), 0.0
        for p in range(ppm.ORDER, len(b)):
            gone: set[int] = set()
            for k in range(ppm.ORDER, -1, -1):
                left = {s: n for s, n in grams[k].get(b[p - k:p], {}).items() if s not in gone}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if b[p] in left:
                    out += math.log10(left[b[p]] / whole)
                    break
                out += math.log10(len(left) / whole)
                gone |= set(left)
            else:
                out += math.log10(1 / (ppm.SYMBOLS - len(gone)))
        return out

    return score


@pytest.mark.parametrize("block_bytes", [96 << 20, 3000])
def test_scores_against_brute_force(odd_docs, block_bytes):
    """With one block and with many: escapes, exclusion, unseen bytes, contexts at the start."""
    docs = odd_docs.where("doc_id is null or doc_id not in (9, 11)")
    training = docs.where("doc_id is null or doc_id % 2 = 0")
    counts = ppm.count(training)
    blocks = ppm.blocks_of(counts, block_bytes)
    assert (len(blocks) > 3) == (block_bytes == 3000)
    want = brute_ppm([r.text for r in training.collect()])
    rows = ppm.score(docs, blocks, keep=("doc_id", "v")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.score == pytest.approx(want(r.text), rel=1e-3, abs=2e-3)


def test_blocks_are_fetched_by_bounds(odd_docs, monkeypatch):
    """Together the blocks have every gram once and score every pair once; the driver's plans don't grow with the pairs."""
    counts, plans = ppm.count(odd_docs), []
    blocks, fetch = ppm.blocks_of(counts, 3000), type(counts).toArrow
    monkeypatch.setattr(type(counts), "toArrow", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), fetch(df))[1])
    parts = [blocks.fetch(k) for k in range(len(blocks))]
    assert len(parts) > 3 and max(map(len, plans)) < 2000
    got = np.concatenate([g.codes for g in parts])
    assert sorted(got.tolist()) == sorted(r.code for r in counts.where(F.col("kind") == ppm.GRAM).collect())
    assert (sum(g.mine.astype(int) for g in parts) == 1).all()
    assert all(g.mine[g.codes >> 8 * (ppm.ORDER - 1)].all() for g in parts)


@pytest.mark.parametrize("hot", [200_000, 2])
def test_word_scores_against_brute_force(odd_docs, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT", hot)
    training = odd_docs.where("doc_id is null or doc_id % 2 = 0")
    words = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c = Counter(w for r in training.collect() for w in words(r.text))
    n, v = sum(c.values()), len(c)
    rows = ppm.unigram(odd_docs, ppm.count(training), keep=("text", "row", "k0")).collect()
    assert len(rows) == odd_docs.count() and rows[0].row == "r"
    for r in rows:
        w = words(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)


def test_scores_without_training(odd_docs, no_docs):
    counts = ppm.count(no_docs)
    rows = ppm.score(odd_docs, ppm.blocks_of(counts)).collect()
    for r in rows:
        assert r.score == pytest.approx(-(len((r.text or "").encode()) + 1) * math.log10(ppm.SYMBOLS), rel=1e-3)
    assert ppm.unigram(odd_docs, counts).agg(F.min("base_score"), F.max("base_score")).first() == (0.0, 0.0)
    assert ppm.score(no_docs, ppm.blocks_of(counts)).count() == 0
