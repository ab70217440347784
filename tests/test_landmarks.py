import numpy as np
import pytest
from pyspark.errors import PySparkException

from tests.test_fits import NOISE, PAR, data, dense_multi
from tiersmith.operators import landmarks as L
from tiersmith.operators.relational import lookup_parameters

THETA = tuple(np.array(p) for p in zip(*PAR))
SCHEMA = "id int, x array<double>, P double, S1 double, S2 double"


def wide(spark, x, p, s1, s2, have):
    rows = [(i, list(map(float, x[i])), *(float(y[i]) if i in h else None for y, h in zip((p, s1, s2), have))) for i in range(len(x))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("fan_in", [32, 2])
def test_all_rows_as_landmarks_are_the_exact_multi_task_fit(spark, monkeypatch, fan_in):
    monkeypatch.setattr(L, "FAN_IN", fan_in)
    x, p, s1, s2 = data(60, 3)
    x = x * 4
    have = [range(14), range(26), range(8, 34)]
    marks = L.Landmarks(np.vstack([x[list(h)] for h in have]), np.repeat([0, 1, 2], [len(h) for h in have]), THETA)
    fitted = L.fit(wide(spark, x, p, s1, s2, have).repartition(7), ["P", "S1", "S2"], marks)
    rows = sorted(L.score(wide(spark, x, p, s1, s2, have).where("id >= 40").select("id", "x"), fitted).collect(), key=lambda r: r.id)
    mu, sigma = dense_multi([x[list(h)] for h in have], [y[list(h)] for y, h in zip((p, s1, s2), have)], PAR, x[40:])
    np.testing.assert_allclose([r.mu for r in rows], mu, atol=1e-5)
    np.testing.assert_allclose([r.sigma for r in rows], sigma, atol=1e-4)


def test_few_landmarks_equal_the_dense_normal_equations(spark):
    """Deterministic training conditional by plain matrices, for the primary and for a secondary task."""
    x, p, s1, s2 = data(80, 5)
    have = [range(40), range(60), range(20, 70)]
    marks = L.Landmarks(x[:9] * 1.1, np.array([0, 0, 0, 1, 1, 1, 2, 2, 2]), THETA)
    fitted = L.fit(wide(spark, x, p, s1, s2, have), ["P", "S1", "S2"], marks)
    v, _, rho = THETA
    k = np.hstack([marks.to_rows(x[list(h)], i) for i, h in enumerate(have)])
    ys = [y[list(h)] for y, h in zip((p, s1, s2), have)]
    r = np.concatenate([y - y.mean() for y in ys])
    kzz = L.covariance(marks.x, marks.task, marks.x, marks.task, THETA) + L.JITTER * np.eye(9)
    a = NOISE * kzz + k @ k.T
    for task in range(3):
        mu, sigma = fitted.predict(x[70:], task)
        star = marks.to_rows(x[70:], task)
        np.testing.assert_allclose(mu, ys[task].mean() + star.T @ np.linalg.solve(a, k @ r), atol=1e-7)
        own = rho[task] ** 2 * v[0] + (v[task] if task else 0)
        var = own - (star * np.linalg.solve(kzz, star)).sum(0) + NOISE * (star * np.linalg.solve(a, star)).sum(0)
        np.testing.assert_allclose(sigma, np.sqrt(var), atol=1e-7)


def test_tasks_without_rows_and_wrong_landmarks(spark):
    x, p, s1, s2 = data(20)
    marks = L.Landmarks(x[:4], np.array([0, 0, 1, 2]), THETA)
    one = L.fit(wide(spark, x, p, s1, s2, [range(12), range(0), range(0)]), ["P", "S1", "S2"], marks)
    assert np.isnan(one.means[1:]).all() and np.isfinite(one.predict(x)[0]).all()
    with pytest.raises(ValueError, match="primary"):
        L.fit(wide(spark, x, p, s1, s2, [range(0), range(3), range(0)]), ["P", "S1", "S2"], marks)
    with pytest.raises(ValueError, match="number of a task"):
        L.Landmarks(x[:2], np.array([0, 3]), THETA)
    with pytest.raises(ValueError, match="too many"):
        L.Landmarks(np.zeros((4000, 2)), np.zeros(4000, int), THETA)


def test_very_many_repeated_parameter_rows_are_found(spark):
    """A log with 3000 repeated tasks: each wanted one is an error, whatever its place, and tasks nobody asks for are none."""
    log = spark.range(6000).selectExpr("concat('t', id % 3000) as task", "1.0D as rho").union(
        spark.createDataFrame([("good", 2.0)], "task string, rho double"))
    for name in ("t0", "t17", "t1203", "t2999"):
        with pytest.raises(PySparkException, match=f"several parameter rows for task {name}"):
            lookup_parameters(spark.createDataFrame([(0, name)], "ord int, task string"), log).collect()
    fine = lookup_parameters(spark.createDataFrame([(0, "good"), (1, "good")], "ord int, task string"), log).collect()
    assert [(r.ord, r.task, r.rho) for r in sorted(fine)] == [(0, "good", 2.0), (1, "good", 2.0)]
    with pytest.raises(PySparkException, match="no parameters for task none"):
        lookup_parameters(spark.createDataFrame([(0, "none")], "ord int, task string"), log).collect()
