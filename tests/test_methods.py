"""Methods, kernels and prior means that are given from outside."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tests.test_fits import NOISE, data, frame, long_rows
from tiersmith.operators import gp as K, methods as M
from tiersmith.operators.analysis import mean_over_runs
from tiersmith.schemas import PARAMS

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this file
PARAMETERS = [("P", 1.0, 1.0, 1.0), ("S1", 0.05, 1.0, 0.9), ("S2", 0.05, 1.0, 0.8)]


def matern(d, lengthscale):
    r = np.sqrt(3 * d) / lengthscale
    return (1 + r) * np.exp(-r)


def nearest_fit(rows, noise):
    first = rows[rows.task_no == 0]
    return np.stack(first["x"].to_numpy()), first["y"].to_numpy(float)


def nearest_score(fit, x, low):
    d = K.sq_distances(x, fit[0])
    return fit[1][d.argmin(1)], np.sqrt(d.min(1)) + 1e-9


@pytest.fixture
def nearest():
    yield M.register(M.Method("nearest", "Nearest", fit=nearest_fit, score=nearest_score))
    del M.METHODS["nearest"]


def test_a_registered_method_runs_beside_the_others(spark, nearest):
    df = long_rows(spark, 120, None)
    params = spark.createDataFrame(PARAMETERS, PARAMS)
    scenarios = [M.single("one", "P", (10,)), M.Scenario("near|est", "nearest", "P", ("S1",), (10, 40), (1.0,), (0.0,))]
    rows = M.run_grid(df, "id", ["P", "S1", "S2"], params, scenarios, [1, 2], 40).collect()
    got = {(r.method, r.high_level, r.seed): r for r in rows}
    assert len(got) == 6 and {k[0] for k in got} == {"P", "Nearest"}
    assert got["Nearest", 40, 1].datasets == "C" and got["Nearest", 40, 1].low_level == 40
    pred = M.predict_cells(df, "id", ["P", "S1", "S2"], params, scenarios, [1], 40).where("kind = 'nearest' and core = 40").collect()
    x, p, _, _ = data(120)
    used = {r.id for r in pred}
    assert len(pred) == 40
    for r in pred:  # the nearest training row's value is one of the table's, of a row that isn't a target
        i = int(r.id[1:])
        near = [j for j in range(120) if abs(p[j] - r.mu) < 1e-12]
        assert near and f"k{near[0]}" not in used and abs(np.linalg.norm(x[near[0]] - x[i]) - r.sigma) < 1e-6
    assert "nearest" not in M.method_traits() or M.method_traits()["nearest"] == ("Nearest", False)
    assert mean_over_runs(spark.createDataFrame([(r.method, 1.0) for r in rows], "method string, mae_error double").selectExpr(
        "method", "method as lowest", "method as datasets", "1 as levels", "1L as high_level", "1L as low_level", "1.0D as task_fractions",
        "1 as target", "1 as seed", "mae_error"), ["mae_error"]).count() == 2


@pytest.mark.parametrize("mean", [np.mean, np.median])
@pytest.mark.parametrize("kernel", [K.squared_exponential, matern])
def test_kernel_and_prior_mean_against_dense(spark, kernel, mean):
    x, p, s1, _ = data(60)
    par = [(1.3, 0.8, 1.0), (0.2, 1.1, 0.9)]
    xs, ys = [x[:12], x[:30]], [p[:12], s1[:30]]
    fits = K.fit_models(frame(spark, "c", xs, ys, par), kernel=kernel, mean=mean)
    test = spark.createDataFrame([(i, list(map(float, x[i]))) for i in range(40, 60)], "id int, x array<double>")
    rows = sorted(K.score_rows(test, fits).collect(), key=lambda r: r["id"])
    t, xx, rho = np.repeat([0, 1], [12, 30]), np.vstack(xs), np.repeat([1.0, 0.9], [12, 30])

    def k(a, b, v, l):
        return v * kernel(((a[:, None] - b[None]) ** 2).sum(-1), l)

    cov = rho[:, None] * rho * k(xx, xx, 1.3, 0.8) + np.where((t[:, None] == 1) & (t == 1), k(xx, xx, 0.2, 1.1), 0) + NOISE * np.eye(42)
    r = np.concatenate([y - mean(y) for y in ys])
    star = rho[:, None] * k(xx, x[40:], 1.3, 0.8)
    np.testing.assert_allclose([q["mu"] for q in rows], mean(p[:12]) + star.T @ np.linalg.solve(cov, r), atol=1e-8)
    np.testing.assert_allclose([q["sigma"] for q in rows], np.sqrt(1.3 - (star * np.linalg.solve(cov, star)).sum(0)), atol=1e-8)


def test_a_grid_takes_the_kernel_and_the_mean(spark):
    df = long_rows(spark, 100, None)
    params = spark.createDataFrame(PARAMETERS, PARAMS)
    one = [M.single("one", "P", (20,))]
    plain, other = (M.run_grid(df, "id", ["P"], params, one, [1], 40, **how).first() for how in ({}, {"kernel": matern, "mean": np.median}))
    assert plain.mae_error != other.mae_error and other.mae_error > 0


def test_unknown_methods_are_named(spark):
    with pytest.raises(ValueError, match="unknown method 'furthest'; known are single"):
        M.Scenario("x", "furthest", "P")


def test_the_sample_is_not_shuffled_to_its_cells(spark, monkeypatch):
    """Cells meet a sample of measured size by broadcast; a larger one is joined by exchange with the same result."""
    df = long_rows(spark, 100, None)
    params = spark.createDataFrame(PARAMETERS, PARAMS)
    two = [M.Scenario("two", "multitask", "P", ("S1",), (10,), (1.0,), (0.0, 1.0))]
    rows, plans = {}, {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for size in (M.POOL_BYTES, 0):
            monkeypatch.setattr(M, "POOL_BYTES", size)
            pred = M.predict_cells(df, "id", ["P", "S1"], params, two, [1, 2], 30)
            plans[size] = pred._jdf.queryExecution().optimizedPlan().toString()
            rows[size] = sorted((r.cell_id, r.id, round(r.mu, 9)) for r in pred.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    big, none = sorted(plans, reverse=True)
    assert rows[big] == rows[none] and len(rows[big]) == 120
    assert plans[big].count("strategy=broadcast") > plans[none].count("strategy=broadcast")


@pytest.mark.parametrize("pieces", [16 << 20, 500])
def test_many_rows_to_score_take_one_fit_of_each_cell(spark, monkeypatch, pieces):
    """Two cells with 50,000 rows between them: each is factored once, and the numbers are those of the plain fit."""
    monkeypatch.setattr(K, "PIECE_BYTES", pieces)
    x, p, s1, _ = data(60)
    par = [(1.0, 1.0, 1.0), (0.1, 0.7, 0.9)]
    train = frame(spark, "a", [x[:20], x[:30]], [p[:20], s1[:30]], par).union(frame(spark, "b", [x[30:50]], [p[30:50]], par))
    fitted = spark.sparkContext.accumulator(0)

    def counted(rows, noise):
        fitted.add(1)
        return K.fit_rows(rows, noise)

    rng = np.random.default_rng(1)
    points = [(c, i, rng.uniform(0, 3, 2).tolist()) for c in "ab" for i in range(25_000)]
    test = spark.createDataFrame(points, "cell_id string, id int, x array<double>")
    got = K.fit_and_predict(train, test, "id", test_rows=25_000, solver=lambda cell: (counted, K.predict_rows)).collect()
    assert fitted.value == 2 and len(got) == 50_000 and {r.n_secondary_rows for r in got if r.cell_id == "a"} == {30}
    fits = K.fit_models(train)
    at = {(c, i): q for c, i, q in points}
    for c in "ab":
        mine = [r for r in got if r.cell_id == c]
        mu, sigma = K.predict_rows(fits[c], np.array([at[c, r.id] for r in mine]))
        np.testing.assert_allclose([r.mu for r in mine], mu, atol=1e-10)
        np.testing.assert_allclose([r.sigma for r in mine], sigma, atol=1e-8)
