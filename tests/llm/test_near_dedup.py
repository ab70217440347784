"""Near-duplicates and components against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tiersmith.llm import minhash
from tiersmith.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in at[g]:
                shared[j] += 1
            at[g].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}


def edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random():.6f}"
    return " ".join(out)


def test_groups_of_copies_and_chains(spark):
    rng = random.Random(3)
    rows = []
    for g in range(25):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 200]))]
        for _ in range(rng.choice([1, 2, 5])):
            rows.append((len(rows), edited(words, rng.choice([0, 1, 2, len(words) // 40]), rng)))
        text = " ".join(words)
        for _ in range(3):  # a chain whose ends are far apart
            text = edited(text.split(), max(1, len(words) // 50), rng)
            rows.append((len(rows), text))
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("edits", [2, 3, 4])
def test_a_hot_group_around_the_threshold_is_compared_completely(spark, monkeypatch, edits):
    """Hundreds of distinct texts share most words; few pairs or all reach the similarity. Small blocks, many of them."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "SET_BLOCK", 8)
    rng = random.Random(edits)
    words = [f"w{k}" for k in range(100)]
    rows = [(i, edited(words, edits, rng)) for i in range(120)]
    assert found(spark, rows) == brute(rows)


def test_odd_documents(odd_docs):
    got = minhash.near_duplicates(odd_docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert len(rows) == odd_docs.count()
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[1][1:] == (0, 1, True) and by[2][1:] == (0, 2, True) and by[3][1:] == (0, 3, True)
    assert by[5][1:] == (1, 4, False) and by[4][3]
    assert {by[i][2] for i in (6, 7, 8, 13)} == {6} and sum(r[0] == 8 for r in rows) == 2
    assert all(r[2] is None and r[3] for r in rows if r[0] is None)


def test_no_documents(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_components_of_long_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, 7)]
    edges += [(b, a) for a, b in edges[:50]] + [(None, 3)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(40):
            base = rng.integers(0, 1 << 63, 1000, np.uint64)
            other = np.concatenate([base[:int(1000 * share)], rng.integers(0, 1 << 63, 1000 - int(1000 * share), np.uint64)])
            a, b = (np.frombuffer(minhash.signature(np.sort(x)), np.uint8) for x in (base, other))
            errors.append((a == b).mean() - share / (2 - share))
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.035


def test_kept_is_the_smallest_of_each_component(spark, odd_docs):
    got = minhash.near_duplicates(odd_docs.where("doc_id is not null"))
    assert got.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0


def test_rows_of_a_hot_group_grow_with_its_documents(spark, monkeypatch):
    """Distinct texts with three edits each, all in the same buckets: twice the documents give about twice the rows, not four times."""
    monkeypatch.setattr(minhash, "BLOCK", 100)
    rows = {}
    dealt = minhash._dealt
    for n in (150, 300, 600):
        made = []

        def counted(posted, weight, *more):
            out = dealt(posted, weight, *more)
            made.append((posted.count(), out.count()))
            return out

        monkeypatch.setattr(minhash, "_dealt", counted)
        rng = random.Random(7)
        words = [f"w{k}" for k in range(100)]
        found(spark, [(i, edited(words, 3, rng)) for i in range(n)])
        rows[n] = made[0]
    assert rows[600][0] <= 600 * 64
    assert all(rows[2 * n][0] <= 2.5 * rows[n][0] for n in (150, 300))
    monkeypatch.setattr(minhash, "BLOCK", 4096)


def test_components_joined_by_shuffle(spark, monkeypatch):
    import sys

    monkeypatch.setattr(sys.modules["tiersmith.llm.components"], "BROADCAST_NODES", 0)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(60, 150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 60 for k in range(60)} | {60: 60}
