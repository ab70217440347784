import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tiersmith.operators import gp as K, search as H
from tiersmith.operators.methods import Scenario, run_grid, single
from tiersmith.operators.relational import stack
from tiersmith.schemas import PARAMS, RUNS

NOISE = K.NOISE


def kern(a, b, v, l):
    return v * np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) / (2 * l * l))


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 3, (n, 2))
    p = np.sin(x[:, 0]) + 0.5 * x[:, 1]
    return x, p, 0.9 * p + 0.2 * np.cos(x[:, 1]), 0.8 * p + 0.3 * x[:, 0]


def dense_multi(xs, ys, par, xt):
    """Reference solution by direct block assembly; par = [(v, l, rho)] per task."""
    v0, l0, _ = par[0]
    m = [y.mean() for y in ys]
    rows = [(i, x) for i, xs_i in enumerate(xs) for x in xs_i]
    t = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    rho = np.array([par[i][2] for i in t])
    cov = rho[:, None] * rho[None, :] * kern(x, x, v0, l0)
    for i in range(1, len(par)):
        same = (t[:, None] == i) & (t[None, :] == i)
        cov += np.where(same, kern(x, x, par[i][0], par[i][1]), 0)
    cov += NOISE * np.eye(len(t))
    r = np.concatenate([y - m_i for y, m_i in zip(ys, m)])
    ks = rho[:, None] * kern(x, xt, v0, l0)
    sol = np.linalg.solve(cov, np.column_stack([r, ks]))
    return m[0] + ks.T @ sol[:, 0], np.sqrt(v0 - (ks * sol[:, 1:]).sum(0))


def frame(spark, cell, xs, ys, par):
    rows = [(cell, i, list(map(float, x)), float(y), par[i][2], par[i][0], par[i][1])
            for i in range(len(xs)) for x, y in zip(xs[i], ys[i])]
    return spark.createDataFrame(rows, "cell_id string, task_no int, x array<double>, y double, rho double, variance double, lengthscale double")


PAR = [(1.0, 1.0, 1.0), (0.1, 0.7, 0.9), (0.2, 1.3, 0.8)]


@pytest.mark.parametrize("chunk", [8192, 7])
def test_multi_task_fit_equals_dense(spark, monkeypatch, chunk):
    monkeypatch.setattr(K, "CHUNK_ROWS", chunk)
    x, p, s1, s2 = data(60)
    xs, ys = [x[:8], x[:20], x[4:24]], [p[:8], s1[:20], s2[4:24]]
    train = frame(spark, "c", xs, ys, PAR)
    test = spark.createDataFrame([("c", i, list(map(float, x[i]))) for i in range(30, 60)], "cell_id string, id int, x array<double>")
    mu, sigma = dense_multi(xs, ys, PAR, x[30:])
    for got in (K.fit_and_predict(train, test, "id", test_rows=30), K.score_rows(test.drop("cell_id"), K.fit_models(train))):
        rows = sorted(got.collect(), key=lambda r: r["id"])
        assert len(rows) == 30
        np.testing.assert_allclose([r["mu"] for r in rows], mu, atol=1e-8)
        np.testing.assert_allclose([r["sigma"] for r in rows], sigma, atol=1e-8)


def test_zero_rho_is_the_single_task(spark):
    x, p, s1, _ = data(40)
    par = [PAR[0], (0.1, 0.7, 0.0)]
    both = K.score_rows(spark.createDataFrame([(0, list(map(float, x[30])))], "id int, x array<double>"),
                        K.fit_models(stack([frame(spark, "one", [x[:9]], [p[:9]], par),
                                            frame(spark, "two", [x[:9], x[:20]], [p[:9], s1[:20]], par)]))).collect()
    assert both[0]["mu"] == pytest.approx(both[1]["mu"]) and both[0]["sigma"] == pytest.approx(both[1]["sigma"])


def test_target_border_equals_refit_with_fixed_means(spark):
    x, p, s1, _ = data(40)
    par = PAR[:2]
    xs, ys = [x[:8], x[:20]], [p[:8], s1[:20]]
    fits = K.fit_models(frame(spark, "c", xs, ys, par))
    test = spark.createDataFrame([(i, list(map(float, x[i])), float(s1[i])) for i in range(25, 40)], "id int, x array<double>, low double")
    rows = sorted(K.score_rows(test, fits, low="low").collect(), key=lambda r: r["id"])
    means = [y.mean() for y in ys]
    for r in rows:
        i = r["id"]
        rho = np.array([1.0] * 8 + [0.9] * 21)
        xx = np.vstack([x[:8], x[:20], x[i:i + 1]])
        t = np.array([0] * 8 + [1] * 21)
        cov = rho[:, None] * rho[None, :] * kern(xx, xx, 1.0, 1.0)
        cov += np.where((t[:, None] == 1) & (t[None, :] == 1), kern(xx, xx, 0.1, 0.7), 0) + NOISE * np.eye(29)
        res = np.concatenate([ys[0] - means[0], ys[1] - means[1], [s1[i] - means[1]]])
        ks = rho * kern(xx, x[i:i + 1], 1.0, 1.0)[:, 0]
        assert r["mu"] == pytest.approx(means[0] + ks @ np.linalg.solve(cov, res), abs=1e-9)
        assert r["sigma"] == pytest.approx(np.sqrt(1.0 - ks @ np.linalg.solve(cov, ks)), abs=1e-9)


def test_a_cell_above_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_BYTES", 10)
    x, p, _, _ = data(10)
    with pytest.raises(ValueError, match="fit_and_predict"):
        K.fit_models(frame(spark, "c", [x], [p], PAR))


@pytest.mark.parametrize("fan_in", [32, 2])
def test_inducing_fit_with_all_rows_as_landmarks_is_exact(spark, monkeypatch, fan_in):
    monkeypatch.setattr(K, "FAN_IN", fan_in)
    x, p, _, _ = data(60)
    x = x * 4
    train = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x[:40], p[:40])], "x array<double>, y double").repartition(6)
    test = spark.createDataFrame([(i, list(map(float, x[i]))) for i in range(40, 60)], "id int, x array<double>")
    rows = sorted(K.inducing_score(test, K.inducing_fit(train, x[:40], 1.0, 1.0)).collect(), key=lambda r: r["id"])
    mu, sigma = dense_multi([x[:40]], [p[:40]], PAR[:1], x[40:])
    np.testing.assert_allclose([r["mu"] for r in rows], mu, atol=1e-5)
    np.testing.assert_allclose([r["sigma"] for r in rows], sigma, atol=1e-4)


def test_likelihood_and_moments_against_dense():
    x, p, _, _ = data(25)
    psi = kern(x, x, 1.0, 0.8) + NOISE * np.eye(25)
    one = np.ones(25)
    mu = one @ np.linalg.solve(psi, p) / (one @ np.linalg.solve(psi, one))
    var = (p - mu) @ np.linalg.solve(psi, p - mu) / 25
    pdf = pd.DataFrame({"x": list(x), "y": p})
    score, m, v = H.nlml_score(pdf, 0.8, NOISE)
    assert (m, v) == (pytest.approx(mu), pytest.approx(var))
    assert score == pytest.approx(0.5 * 25 * np.log(var) + 0.5 * np.linalg.slogdet(psi)[1])


def long_rows(spark, n, tasks):
    x, p, s1, s2 = data(n)
    rows = [(f"k{i}", list(map(float, x[i])), float(p[i]), float(s1[i]), float(s2[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, x array<double>, P double, S1 double, S2 double")


def test_grid_search_finds_the_likelihood_minimum(spark):
    df = long_rows(spark, 30, None).select(F.lit("P").alias("task"), F.lit(1).alias("seed"), F.col("id").alias("key"), "x", F.col("P").alias("y"))
    got = H.grid_search(df, H.nlml_score, 0.05, 50.0, candidates=16, rounds=4).first()
    x, p, _, _ = data(30)
    pdf = pd.DataFrame({"x": list(x), "y": p})
    best = min(H.nlml_score(pdf, t, NOISE)[0] for t in np.geomspace(0.05, 50, 800))
    assert got["score"] <= best + 1e-3 and got["converged"]


def test_campaign_logs_every_derived_task(spark):
    log = H.campaign(long_rows(spark, 40, None), "id", "P", ["S1", "S2"], [1, 2], candidates=8, rounds=2).collect()
    assert {r["task"] for r in log} == {"P", "S1", "S2", "P_S1", "P_S2", "P_S1_S2", "P_S2_S1", "S1_S2", "S2_S1", "S1_S2_P", "S2_S1_P"}
    assert len(log) == 22
    by = {(r["task"], r["seed"]): r for r in log}
    assert by["S1_S2", 1]["lengthscale"] == by["S2_S1", 1]["lengthscale"] == by["S1_S2_P", 1]["lengthscale"]
    x, p, s1, s2 = data(40)
    assert by["S1_S2_P", 2]["rho"] == pytest.approx(np.corrcoef(s1 - s2, p - s2)[0, 1])
    assert all((r["reason"] is None) == r["converged"] for r in log)


def test_grid_rows_follow_the_run_schema_and_improve_with_size(spark):
    df = long_rows(spark, 160, None)
    params = spark.createDataFrame([("P", 1.0, 1.0, 1.0), ("S1", 0.05, 1.0, 0.9), ("S2", 0.05, 1.0, 0.8), ("P_S1", 0.1, 1.0, 1.0), ("S1_S2", 0.1, 1.0, 1.0)], PARAMS)
    rows = run_grid(df, "id", ["P", "S1", "S2"], params, [
        single("one", "P", (5, 20)), Scenario("two", "multitask", "P", ("S1",), (5,), (1.0,), (0.0, 2.0)),
        Scenario("two target", "multitask_with_target", "P", ("S1",), (5,), (1.0,), (2.0,)),
        Scenario("chain", "delta", "P", ("S1", "S2"), (5,), (1.0,), (1.0,))], [1, 2], 60)
    names = [c.strip().split(" ")[0] for c in RUNS.split(",")]
    assert sorted(rows.columns) == sorted(names)
    got = rows.collect()
    assert len(got) == 2 * (2 + 2 + 1 + 1)
    key = {(r["method"], r["datasets"], r["high_level"], r["seed"]): r for r in got}
    assert key["P", "P", 20, 1]["mae_error"] < key["P", "P", 5, 1]["mae_error"]
    assert key["Multitask", "CA", 5, 1]["low_level"] == 15 and key["Multitask", "CAT", 5, 1]["low_level"] == 16
    delta = key["Delta", "CAT", 5, 2]
    assert (delta["levels"], delta["lowest"], delta["low_level"]) == (3, "S2", 5 + 10 + 1)
    assert all(r["train_time"] > 0 and r["kendall_error"] is not None for r in got)


def test_holdout_error_against_dense():
    x, p, _, _ = data(30)
    part = np.array(["train"] * 20 + ["test"] * 10)
    pdf = pd.DataFrame({"x": list(x), "y": p, "part": part, "lengthscale": 0.8})
    k = kern(x[:20], x[:20], 2.5, 0.8) + NOISE * np.eye(20)
    star = p[:20].mean() + kern(x[20:], x[:20], 2.5, 0.8) @ np.linalg.solve(k, p[:20] - p[:20].mean())
    assert H.holdout_score(pdf, 2.5, NOISE)[0] == pytest.approx(np.abs(star - p[20:]).mean())


def test_a_cell_without_test_rows_is_skipped(spark):
    x, p, _, _ = data(5)
    train = stack([frame(spark, c, [x], [p], PAR) for c in ("c", "d")])
    test = spark.createDataFrame([("c", 1, [0.0, 0.0])], "cell_id string, id int, x array<double>")
    assert [r["cell_id"] for r in K.fit_and_predict(train, test, "id", test_rows=1).collect()] == ["c"]


def test_a_cell_without_training_rows_is_an_error(spark):
    x, p, _, _ = data(5)
    train = frame(spark, "c", [x], [p], PAR)
    test = spark.createDataFrame([("other", 1, [0.0, 0.0])], "cell_id string, id int, x array<double>")
    with pytest.raises(Exception, match="no training rows"):
        K.fit_and_predict(train, test, "id", test_rows=1).collect()


def test_a_scenario_with_unknown_parameters_is_an_error(spark):
    params = spark.createDataFrame([("S1", 1.0, 1.0, 1.0)], PARAMS)
    with pytest.raises(Exception, match="no parameters for task P"):
        run_grid(long_rows(spark, 60, None), "id", ["P"], params, [single("one", "P", (5,))], [1], 20).collect()
