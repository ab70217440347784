import math

import numpy as np
import pytest

from tiersmith.llm import queries, whitening as w


def brute(rows, count=4):
    """Rows by component from numpy's symmetric solver and whole Python numbers."""
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(k, tuple(math.floor(256 * float(c)) for c in v)) for k, v in kept]
    distinct = np.array(sorted({x for _, x in whole}), float)
    n, sums = len(distinct), [sum(c) for c in zip(*{x for _, x in whole})]
    centred = distinct - distinct.mean(0)
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:count], v[:, ::-1][:, :count]
    return {(k, x, j + 1): (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - centred_mean) @ v[:, j] / math.sqrt(e[j]),
                            e[j] / np.trace(cov)) for centred_mean in [distinct.mean(0)] for k, x in whole for j in range(count) if e[j] > 1e-9}


@pytest.mark.parametrize("kind", ["plain", "low", "graded", "equal", "alike"])
def test_leading_equals_symmetric_solver(kind):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((300, 24))
    x = {"plain": x, "low": x[:, :2] @ draw.standard_normal((2, 24)), "graded": x * np.logspace(0, -7, 24)}.get(kind, x)
    a = np.cov(x.T, bias=True)
    if kind in ("equal", "alike"):
        q = np.linalg.qr(draw.standard_normal((24, 24)))[0]
        a = 3 * np.eye(24) if kind == "alike" else q @ np.diag(np.repeat([4.0, 2.0, 2.0, 0.0], 6)) @ q.T
    values, vectors = w.leading((a + a.T) / 2, 24)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * values[0])
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-13
    few = w.leading((a + a.T) / 2, 3)
    assert np.allclose(few[0], values[:3], atol=1e-13 * values[0])


def compare(got, rows):
    want = brute(rows)
    seen = {}
    assert len(got) == sum(1 for k, v in rows for j in range(4) if v and all(c is not None and math.isfinite(c) for c in v)
                           and (k, tuple(math.floor(256 * float(c)) for c in v), j + 1) in want)
    by_key = {}
    for (k, x, j), value in want.items():
        by_key.setdefault((k, j), []).append(value)
    sign = {}
    for r in got:
        best = min(by_key[r.vec_id, r.component], key=lambda e: abs(abs(e[2]) - abs(r.whitened)) + abs(e[1] - r.deviation))
        assert (r.n, r.deviation) == best[:2]
        assert abs(r.explained - best[3]) < 1e-12
        if abs(best[2]) > 1e-6:
            s = sign.setdefault(r.component, np.sign(r.whitened * best[2]))
            assert abs(s * r.whitened - best[2]) < 1e-8
        assert r.identity_error < 1e-10
        seen[r.component] = True
    return seen


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert len(compare(queries.QUERIES["op11_embedding_whitening"](spark, sf).collect(), rows)) == 4


def test_odd_rows(spark):
    draw = np.random.default_rng(5)
    rows = [(i, draw.standard_normal(6).tolist()) for i in range(40)]
    rows += [(i, rows[3][1]) for i in range(3, 30)]  # copies count once
    rows += [(50, None), (51, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (52, [float("nan")] * 6), (53, [float("inf")] + [0.0] * 5), (None, rows[4][1])]
    odd = [(54, []), (55, [1.0, 2.0])]  # other lengths than most take no part
    df = spark.createDataFrame([(k, v, k, "x") for k, v in rows + odd], "vec_id long, embedding array<double>, id long, x string")
    assert len(compare(w.whiten(df.repartition(5)).collect(), rows)) == 4


def test_without_spread_there_are_no_components(spark):
    kind = "vec_id long, embedding array<float>"
    assert w.whiten(spark.createDataFrame([], kind)).collect() == []
    assert w.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    one = w.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 3.0])], kind)).orderBy("vec_id").collect()
    assert [r.component for r in one] == [1, 1] and [abs(r.whitened) for r in one] == [1.0, 1.0] and one[0].explained == 1.0


def test_large_entries(spark):
    big = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3e12, 5.0])]
    got = w.whiten(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect()
    whole = [[math.floor(256 * c) for c in v] for _, v in big]
    sums = [sum(c) for c in zip(*whole)]
    exact = {k: sum((3 * a - s) ** 2 for a, s in zip(x, sums)) for (k, _), x in zip(big, whole)}
    assert {r.vec_id: r.deviation for r in got} == {k: v if v < 1 << 63 else None for k, v in exact.items()}
