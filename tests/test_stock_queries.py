"""Studies at full size are registered beside the small ones; a search study goes on until enough are accepted."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tiersmith.operators import search as H
from tiersmith.plans import queries_fits


def test_full_sizes_are_registered_without_sql():
    small = {"search_campaign", "search_study", "extended_curve", "method_grid", "recorded_runs", "multitask_grid", "gls_moments", "nlml_grid"}
    full = {f"{name}_stock" for name in small}
    assert small | full <= set(entry_module.queries()) and full.isdisjoint(entry_module.oracle_sql())
    assert [max(s.cores) for s in queries_fits.STOCK] == [2560] + [320] * (len(queries_fits.COMPARED) - 1)


def test_search_study_goes_on_until_enough_are_accepted(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(t, f"k{i}", [rng.random(), rng.random()], rng.random()) for t in ("P", "Q") for i in range(30)]
    df = spark.createDataFrame(rows, "task string, key string, x array<double>, y double")

    def accepts_every_third_of_one_task(sets, **_):
        return sets.groupBy("task", "seed").agg(F.lit(2.0).alias("variance"), F.lit(3.0).alias("variance_mle"), F.lit(1.0).alias("lengthscale"),
                                                F.lit(0.0).alias("objective_mle"), F.lit(0.0).alias("objective_mae")).select(
            "*", ((F.col("seed") % 3 == 0) & F.col("task").startswith("P")).alias("converged"))

    monkeypatch.setattr(H, "search", accepts_every_third_of_one_task)
    got = H.search_study(df, [5, 8], 2, 2, df, most=10).collect()
    assert sorted((r.task, r.n, r.seed) for r in got if r.missing is None) == [("P", 5, 3), ("P", 5, 6), ("P", 8, 3), ("P", 8, 6)]
    assert sorted((r.task, r.n, r.seed, r.missing) for r in got if r.missing) == [("Q", 5, None, 2), ("Q", 8, None, 2)]
