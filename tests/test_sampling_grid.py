from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from tiersmith.operators import grid as E, sampling as X
from tiersmith.operators.relational import lookup_parameters, parameter_product, tuple_filter, tuple_split


def keys(spark, n, parts=5):
    return spark.range(n).select(F.concat(F.lit("k"), "id").alias("id")).repartition(parts)


@pytest.mark.parametrize("limit", [10, 1_000_000])
def test_sample_is_exact_and_independent_of_partitions(spark, monkeypatch, limit):
    monkeypatch.setattr(X, "PREFILTER_ROWS", limit)
    got = [sorted(map(tuple, X.ranked_sample(keys(spark, 3000, p), "id", 70, [1, 2]).collect())) for p in (1, 6)]
    assert got[0] == got[1] and len(got[0]) == 140
    assert {r[2] for r in got[0]} == set(range(1, 71))


def test_sample_widens_its_threshold_for_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(X, "PREFILTER_ROWS", 10)
    df = spark.range(2000).select(F.when(F.col("id") < 1990, "same").otherwise(F.col("id").cast("string")).alias("id"))
    assert X.ranked_sample(df, "id", 100, [3]).count() == 100


def test_large_samples_use_the_index(spark, monkeypatch):
    small = {r["id"]: r["rank"] for r in X.ranked_sample(keys(spark, 500), "id", 200, [9]).collect()}
    monkeypatch.setattr(X, "RANK_BY_SORT", 10)
    assert {r["id"]: r["rank"] for r in X.ranked_sample(keys(spark, 500), "id", 200, [9]).collect()} == small


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        X.ranked_sample(keys(spark, 5), "id", 6)


def test_nested_split_is_disjoint(spark):
    rows = X.nested_split(keys(spark, 400), "id", 50, 20, 60, [1]).collect()
    parts = {p: sorted(r["pos"] for r in rows if r["part"] == p) for p in "TCA"}
    assert parts == {"T": list(range(1, 51)), "C": list(range(1, 21)), "A": list(range(1, 61))}
    assert len({r["id"] for r in rows}) == 130


def test_replacement_draws(spark):
    idx = spark.range(50).select((F.col("id") + 1).alias("row_idx"), "id")
    rows = X.draw_with_replacement(idx, 50, 500, 1).collect()
    assert len(rows) == 500 and 40 < len({r["row_idx"] for r in rows}) <= 50


def expected(n, k, shared):
    common = list(range(1, ceil(shared * n) + 1))
    out = [list(common) for _ in range(k)]
    if shared < 1:
        start, unit = len(common) + 1, round((n - len(common)) / k)
        for i in range(k - 1):
            out[i] += [v for v in range(start, start + unit) if v <= floor(n)]
            start += unit
        out[k - 1] += list(range(start, floor(n) + 1))
    return out


def test_split_positions_against_a_loop(spark):
    cases = [(n / 2, k, s) for n in range(1, 26) for k in (1, 2, 3, 5) for s in (0.0, 0.25, 0.5, 1.0)]
    df = spark.createDataFrame(cases, "n double, k int, s double") \
              .withColumn("i", F.explode(F.sequence(F.lit(1), "k")))
    got = df.select("n", "k", "s", "i", E.split_positions(F.col("n"), F.col("k"), F.col("i"), F.col("s")).alias("p")).collect()
    for r in got:
        assert r["p"] == expected(r["n"], r["k"], r["s"])[r["i"] - 1], r


def test_cases_drop_the_empty_one_unless_alone(spark):
    base = spark.createDataFrame([(5, 2), (5, 1)], "core int, n_secondary int")
    full = E.expand_cases(base, [0.0, 1.0], [0.0, 2.0], [0.5, 1.0]).collect()
    assert len(full) == 3 * 2 + 3
    assert {r["shared"] for r in full if r["n_secondary"] == 1} == {1.0}
    assert E.expand_cases(base, [0.0], [0.0]).count() == 2


def test_counts_equal_the_formula(spark):
    base = spark.createDataFrame([("s", 1, c, k) for c in (5, 10) for k in (1, 2)], "scenario string, seed int, core int, n_secondary int")
    cells = E.expand_cases(base, [0.0, 1.0], [0.0, 1.0, 2.0], [0.5, 1.0])
    pos = E.cell_positions(cells)
    counts = E.cell_counts(pos, [*E.CELL, "n_secondary"])
    label = F.concat(F.when(F.col("c_ratio") > 0, "C").otherwise(""), F.when(F.col("a_ratio") > 0, "A").otherwise(""))
    want = E.expected_low_level(F.col("core"), label, F.col("n_secondary"), F.col("shared"), F.col("a_ratio"))
    assert counts.where(F.col("n_secondary_rows") != want).count() == 0
    assert counts.where(F.col("n_primary") != F.col("core")).count() == 0


def test_tuple_filters(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 1), ("a", 2)], "s string, n int")
    assert tuple_filter(df, ["s", "n"], [("a", 1), ("b", 2)]).count() == 2
    many = [("a", 1), ("b", 2)] + [("z", i) for i in range(100)]
    assert tuple_filter(df, ["s", "n"], many).count() == 2
    hit, rest = tuple_split(df, ["s", "n"], [("a", 1)])
    assert (hit.count(), rest.count()) == (1, 3)


def test_unknown_parameters_are_an_error(spark):
    params = spark.createDataFrame([("a", 1.0, 1.0, 1.0)], "task string, variance double, lengthscale double, rho double")
    wanted = spark.createDataFrame([(1, "b")], "ord int, task string")
    with pytest.raises(Exception, match="no parameters for task b"):
        lookup_parameters(wanted, params).collect()


def test_parameter_product(spark):
    a = spark.createDataFrame([(1,), (2,)], "v int")
    b = spark.createDataFrame([("x",), ("y",), ("z",)], "v string")
    assert parameter_product(a=a, b=b).count() == 6
