import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tiersmith.operators import rows as R, stats as G
from tiersmith.operators.relational import mean_costs, wide_to_long_costs


def tau_b(x, y):
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (sx * sy).sum() / np.sqrt(np.abs(sx).sum() * np.abs(sy).sum())


def test_inversions():
    rng = np.random.default_rng(0)
    for m in (1, 2, 3, 17, 200):
        p = rng.permutation(m)
        assert G.inversions(p) == sum(p[i] > p[j] for i in range(m) for j in range(i + 1, m))


@pytest.mark.parametrize("block,blocks,local", [(1 << 15, 1024, 1 << 20), (16, 1024, 1 << 20), (16, 6, 32)])
def test_rank_correlations_with_ties_and_blocks(spark, monkeypatch, block, blocks, local):
    monkeypatch.setattr(G, "BLOCK_ROWS", block)
    monkeypatch.setattr(G, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(G, "MAX_LOCAL", local)
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 40)
    rng = np.random.default_rng(1)
    frames = []
    for g, n in (("hot", 260), ("b", 60), ("c", 31)):
        x = rng.integers(0, 12, n).astype(float)
        x[: n // 3] = 5.0
        frames.append(pd.DataFrame({"g": g, "x": x, "y": np.round(x + rng.normal(0, 4, n))}))
    pdf = pd.concat(frames, ignore_index=True).assign(key=lambda d: np.arange(len(d)))
    got = {r["g"]: r for r in G.rank_correlations(spark.createDataFrame(pdf), ["g"], "key").collect()}
    for g, d in pdf.groupby("g"):
        x, y = d.x.to_numpy(), d.y.to_numpy()
        assert got[g]["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
        assert got[g]["spearman"] == pytest.approx(np.corrcoef(d.x.rank(), d.y.rank())[0, 1], abs=1e-9)
        assert got[g]["kendall"] == pytest.approx(tau_b(x, y), abs=1e-9)


def test_constant_input_has_no_correlation(spark):
    df = spark.createDataFrame([("a", i, 1.0, float(i)) for i in range(5)], "g string, key int, x double, y double")
    r = G.rank_correlations(df, ["g"], "key").first()
    assert (r["pearson"], r["spearman"], r["kendall"]) == (None, None, None)


def test_one_row_has_statistics_but_no_correlations(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.5, 3.0)], "g string, key int, mu double, sigma double, truth double")
    r = G.result_rows(df, ["g"], "key").first()
    assert r["mae_error"] == 2.0 and r["median_ae_relative"] == pytest.approx(2 / 3) and r["kendall_error"] is None


def test_result_rows_keep_zero_truth(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.5, 0.0), ("a", 2, 2.0, 0.5, 4.0)],
                               "g string, key int, mu double, sigma double, truth double")
    r = G.result_rows(df, ["g"], "key").first()
    assert r["mae_error"] == 1.5 and r["mae_relative"] == 0.5


@pytest.mark.parametrize("n", [1, 2, 9, 10])
def test_medians(spark, monkeypatch, n):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 3)
    df = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") * 7 % 5).cast("double").alias("v"), "id")
    want = float(np.median([i * 7 % 5 for i in range(n)]))
    assert G.medians(df, ["g"], "v", ["id"]).first()["median"] == want


# Variance and lengthscale of one task in a published search log, and their published medians.
LOG = [(3.4739362116595673, 1.5629639446822172), (6.488149752014101, 1.5629639446822263),
       (0.6036355203343625, 1.5629639446822239), (15.647555714992214, 1.5629639446822008),
       (20.88859474182506, 1.562963944682213), (12.254802407760476, 1.5629639446822008),
       (9.399157117692925, 1.5629639446821961), (6.651735966522183, 1.5629639446822328),
       (6.875981171270628, 1.562963944682251), (12.287822581092247, 1.5629639446822334),
       (2.793773801531007, 1.5629639446822932), (74.66271869742873, 1.5629639446822288),
       (12.128071323458233, 1.5629639446822259), (25.368941447961063, 1.5629639446822625),
       (1.7993655941782738, 1.5629639446822503), (3.8056941856000392, 1.5629639446822146)]


def test_published_medians(spark):
    df = spark.createDataFrame([("CCSDT", v, l, 1.0, i) for i, (v, l) in enumerate(LOG)],
                               "task string, variance double, lengthscale double, rho double, seed int")
    r = G.task_medians(df).first()
    assert r["variance"] == pytest.approx(8.13756914448178, rel=1e-12)
    assert r["lengthscale"] == pytest.approx(1.56296394468223, rel=1e-12)


# Seconds of ten published calculations and the constants derived from them.
SECONDS = [(32128.7012, 100.1899), (11383.1004, 49.2132), (7842.6503, 36.9514), (15749.739, 78.7407), (10358.2994, 44.9601),
           (7022.8931, 38.7706), (9272.0144, 34.1249), (18480.1779, 71.2994), (12010.3716, 51.4853), (8635.2359, 38.9894)]


def test_published_costs(spark):
    wide = spark.createDataFrame(SECONDS, "`CCSDT-36` double, `PBE-36` double")
    got = {(r["method"], r["suffix"]): r["seconds"] for r in mean_costs(wide_to_long_costs(wide, ["CCSDT-36", "PBE-36"])).collect()}
    assert round(got["CCSDT", 36], 1) == 13288.3 and round(got["PBE", 36], 1) == 54.5


def test_conformal_scale_and_coverage(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": "a", "key": np.arange(600), "mu": rng.normal(size=600), "sigma": 0.1})
    pdf["truth"] = pdf.mu + rng.normal(0, 0.3, 600)
    df = spark.createDataFrame(pdf)
    cal, tgt = df.where("key < 300"), df.where("key >= 300")
    scales = G.conformal_scales(cal, ["g"], "key", 0.1)
    score = np.sort(np.abs(pdf.mu - pdf.truth)[:300] / 0.1)
    assert scales.first()["scale"] == pytest.approx(score[int(np.ceil(301 * 0.9)) - 1])
    cover = G.coverage(G.apply_scales(tgt, scales, ["g"]), ["g"]).first()
    assert cover["before"] < 0.5 and 0.84 < cover["after"] < 0.96


def test_conformal_scale_is_infinite_for_few_rows(spark):
    df = spark.createDataFrame([("a", i, 0.0, 1.0, 1.0) for i in range(5)], "g string, key int, mu double, sigma double, truth double")
    assert G.conformal_scales(df, ["g"], "key").first()["scale"] == float("inf")


def test_a_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1, 1.0, 0.5, 3.0), (None, 2, 2.0, 0.5, 3.0), ("a", 3, 1.0, 0.5, 2.0)],
                               "g string, key int, mu double, sigma double, truth double")
    rows = {r["g"]: r for r in G.result_rows(df, ["g"], "key").collect()}
    assert rows[None]["median_ae_error"] == 1.5 and rows[None]["kendall_error"] is None and rows["a"]["mae_error"] == 1.0
    assert {r["g"] for r in G.conformal_scales(df, ["g"], "key").collect()} == {None, "a"}
