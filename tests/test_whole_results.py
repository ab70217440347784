"""One definition on both sides of every switch of plan, and groups of any size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tiersmith.operators import features, gp, relational, rows, sampling
from tiersmith.operators.methods import Scenario
from tiersmith.sources import tables

LOCAL = "mol_id long, species string, f array<double>"


@pytest.fixture(params=[512, 0])
def either_plan(request, monkeypatch):
    monkeypatch.setattr(features, "WIDE_LIMIT", request.param)


def test_null_vectors_take_no_part(spark, either_plan):
    df = spark.createDataFrame([(1, "H", [1.0, 3.0]), (1, "H", None), (1, "C", [3.0, None]), (2, "H", None), (3, "C", [5.0, 7.0])], LOCAL)
    got = {r.mol_id: list(r.x) for r in features.mean_pool(df, ["mol_id"]).collect()}
    assert got == {1: [2.0, 1.5], 2: [None, None], 3: [5.0, 7.0]}
    got = {r.mol_id: list(r.x) for r in features.species_pool(df, ["H", "C"]).collect()}
    assert got == {1: [1.0, 3.0, 3.0, None], 2: [None] * 4, 3: [None, None, 5.0, 7.0]}


def test_vectors_of_another_length_are_an_error(spark, either_plan):
    df = spark.createDataFrame([(1, "H", [1.0]), (2, "H", [2.0, 9.0])], LOCAL)
    for pooled in (features.mean_pool(df, ["mol_id"]), features.species_pool(df, ["H"])):
        with pytest.raises(PySparkException, match="not of length 2"):
            pooled.collect()


@pytest.mark.parametrize("limit", [10**9, 10])
def test_null_keys_are_sampled_alike(spark, monkeypatch, limit):
    monkeypatch.setattr(sampling, "PREFILTER_ROWS", limit)
    df = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("key"))
    got = sampling.ranked_sample(df, "key", 300, [1, 2]).groupBy("seed").agg(F.count("*").alias("n"), F.count_if(F.col("key").isNull()).alias("none"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 300, got.where("seed = 1").first().none), (2, 300, got.where("seed = 2").first().none)]
    monkeypatch.setattr(sampling, "PREFILTER_ROWS", 10**9)
    other = sampling.ranked_sample(df, "key", 300, [1, 2])
    assert got.orderBy("seed").collect() == other.groupBy("seed").agg(F.count("*").alias("n"), F.count_if(F.col("key").isNull()).alias("none")).orderBy("seed").collect()


def test_repeated_parameters_are_an_error(spark):
    wanted = spark.createDataFrame([(0, "a"), (1, "b")], "ord int, task string")
    good = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "task string, rho double")
    assert relational.lookup_parameters(wanted, good).count() == 2
    with pytest.raises(PySparkException, match="several parameter rows for task b"):
        relational.lookup_parameters(wanted, good.union(good.where("task = 'b'"))).collect()


def test_unknown_methods_and_long_lists_are_errors(spark, monkeypatch):
    with pytest.raises(ValueError, match="mutlitask"):
        Scenario("two", "mutlitask", "P", ("S1",))
    monkeypatch.setattr(relational, "MAX_LIST", 5)
    with pytest.raises(ValueError, match="more than 5"):
        relational.combinations2(spark.range(6), "id")
    assert relational.combinations2(spark.range(5), "id").count() == 10


def test_sums_over_more_buckets_than_constant_boundaries(spark, monkeypatch):
    """A hot group and few rows per bucket: the stored range shuffle gives the same index."""
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 4).alias("g"),
                                  F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"), "id")
    want = sorted(map(tuple, rows.running_sum(df, ["k", "id"], "id", group=["g"], total="t").collect()), key=str)
    monkeypatch.setattr(rows, "ROWS_PER_BUCKET", 100)
    monkeypatch.setattr(rows, "MAX_BUCKETS", 8)
    got = sorted(map(tuple, rows.running_sum(df, ["k", "id"], "id", group=["g"], total="t").collect()), key=str)
    assert got == want


def test_writers_follow_the_size_of_a_partition(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "ROWS_PER_WRITER", 100)
    schema = "target int, seed int, v long"
    df = spark.range(2000).select(F.lit(1).alias("target"), F.when(F.col("id") < 1900, 1).otherwise(2).alias("seed"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart here
    tables.write_runs(df, str(tmp_path / "runs"), schema)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tables.read_runs(spark, str(tmp_path / "runs"), schema).count() == 2000
    assert len(list((tmp_path / "runs/target=1/seed=1").glob("*.parquet"))) > len(list((tmp_path / "runs/target=1/seed=2").glob("*.parquet")))


def _cell(n, tasks, seed=0):
    rng = np.random.default_rng(seed)
    task = np.sort(rng.integers(0, tasks, n))
    task[:tasks] = np.arange(tasks)
    x = rng.normal(size=(n, 3))
    frame = pd.DataFrame({"x": list(x), "task_no": task, "y": np.sin(x[:, 0]) + 0.1 * task})
    for name, values in (("variance", (1.0, 0.3, 0.2, 0.2, 0.2)), ("lengthscale", (1.0, 0.8, 1.2, 1.0, 0.9)), ("rho", (1.0, 0.9, 0.8, 0.7, 0.6))):
        frame[name] = np.array(values)[task]
    return frame


@pytest.mark.parametrize("n, tasks, block", [(5, 2, 512), (700, 3, 64), (4800, 3, 512)])
def test_cells_of_any_size_equal_dense_algebra(monkeypatch, n, tasks, block):
    monkeypatch.setattr(gp, "BLOCK", block)
    cell, at = _cell(n, tasks), np.random.default_rng(9).normal(size=(40, 3))
    fit = gp.fit_rows(cell, 0.015)
    low = np.linspace(-1, 1, 40)
    mu, sigma = gp.predict_rows(fit, at)
    mu_low, _ = gp.predict_rows(fit, at, low)
    k = gp.covariance(fit["x"], fit["task"], fit["x"], fit["task"], fit["theta"]) + 0.015 * np.eye(n)
    cross = gp.covariance(fit["x"], fit["task"], at, np.zeros(40, int), fit["theta"])
    solved = np.linalg.solve(k, np.column_stack([cell.y - fit["means"][fit["task"]], cross]))
    assert np.allclose(mu, fit["means"][0] + cross.T @ solved[:, 0], atol=1e-7)
    assert np.allclose(sigma**2, 1.0 - (cross * solved[:, 1:]).sum(0), atol=1e-7)
    assert np.isfinite(mu_low).all()


def test_the_stock_grids_largest_cell_is_fitted():
    """Four secondary tasks, 9,280 rows: no size raises; the fit interpolates its own points within the noise."""
    cell = _cell(9280, 5)
    fit = gp.fit_rows(cell, 0.015)
    mine = np.flatnonzero(cell.task_no == 0)[:50]
    mu, _ = gp.predict_rows(fit, fit["x"][mine])
    assert np.abs(mu - cell.y.to_numpy()[mine]).max() < 0.2


@pytest.mark.parametrize("totals", [False, True])
def test_statistics_of_bounded_groups_equal_the_index_form(spark, totals):
    """Ties, nulls, constant sides, zero truths, a group of one row and one without a usable row."""
    from tiersmith.operators import stats

    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 60), ("b", 41), ("one", 1), ("none", 2), ("flat", 7)):
        for i in range(n):
            mu, truth = (float(x) for x in np.round(rng.normal(size=2), 1))
            rows.append((g, f"{g}{i}", 2.0 if g == "flat" else mu, None if g == "none" or i == 5 else 0.3 if g == "flat" else abs(mu), 0.0 if i == 3 else truth))
    df = spark.createDataFrame(rows, "cell_id string, id string, mu double, sigma double, truth double")
    if totals:
        df = df.withColumn("mu_total", F.col("mu") + 1).withColumn("truth_total", F.col("truth") + F.col("mu"))
    want = stats.result_rows(df, ["cell_id"], "id")
    got = stats.bounded_result_rows(df, ["cell_id"])
    assert got.columns == want.columns
    pairs = list(zip(sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))))
    assert len(pairs) == 4
    for a, b in pairs:
        assert a[0] == b[0]
        for x, y in zip(a[1:], b[1:]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)), (a[0], a, b)
