import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersmith.operators import features as V, kernels as K
from tiersmith.operators.relational import interaction_energy
from tiersmith.schemas import RUNS
from tiersmith.sources import calclog, tables, xyz

SPECIES = ["C", "N", "O"]


def molecules(n=9, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for m in range(n):
        for a in range(2 + m % 4):
            rows.append((m, a, "HCNO"[(m + a) % 4 if a else 1 + m % 3], [float(v) for v in np.abs(rng.normal(size=dim))]))
    return rows


def local(spark, rows):
    return spark.createDataFrame(rows, "mol_id bigint, atom_idx int, species string, f array<double>")


def isolated(spark):
    return spark.createDataFrame([(s, [float(i + 1)] * 4) for i, s in enumerate(SPECIES)], "species string, x array<double>")


def brute(rows):
    heavy = {}
    for m, _, s, f in rows:
        if s != "H":
            heavy.setdefault(m, []).append((s, np.array(f)))
    iso = {s: np.full(4, i + 1.0) for i, s in enumerate(SPECIES)}
    avg = {m: np.mean([f for _, f in a], axis=0) for m, a in heavy.items()}
    spe = {m: np.concatenate([np.mean([f for t, f in a if t == s], axis=0) if any(t == s for t, _ in a) else iso[s]
                              for s in SPECIES]) for m, a in heavy.items()}
    mats = {m: np.stack([f for _, f in a]) / np.linalg.norm(np.stack([f for _, f in a])) for m, a in heavy.items()}

    def cos(p, q):
        return p @ q / np.sqrt((p @ p) * (q @ q))

    def match(p, q):
        return K.soft_match(p @ q.T, 0.5, 1e-6)

    def dist(s):
        return np.sqrt(max(2 - 2 * s**2, 0))

    return {(i, j): (dist(cos(avg[i], avg[j])), dist(cos(spe[i], spe[j])),
                     dist(match(mats[i], mats[j]) / np.sqrt(match(mats[i], mats[i]) * match(mats[j], mats[j]))))
            for i in heavy for j in heavy if i < j}


@pytest.mark.parametrize("block", [4096, 6])
def test_distances_in_blocks_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK_ATOMS", block)
    rows = molecules()
    want = brute(rows)
    got = K.distance_summary(local(spark, rows), SPECIES, isolated(spark)).collect()
    assert len(got) == 27
    for r in got:
        k = K.DISTANCES.index(r["kind"])
        d = [v[k] for p, v in want.items() if r["mol_id"] in p]
        assert r["partners"] == 8
        assert r["mean"] == pytest.approx(np.mean(d), abs=1e-6)
        assert r["smallest"] == pytest.approx(min(d), abs=1e-6) and r["largest"] == pytest.approx(max(d), abs=1e-6)
    cors = K.distance_correlations(local(spark, rows), SPECIES, isolated(spark)).collect()
    table = np.array(list(want.values()))
    for r in cors:
        i, j = K.DISTANCES.index(r["kind_a"]), K.DISTANCES.index(r["kind_b"])
        assert r["pairs"] == 36
        assert r["correlation"] == pytest.approx(np.corrcoef(table[:, i], table[:, j])[0, 1], abs=1e-5)


def test_soft_match_of_single_vectors_is_their_product():
    assert K.soft_match(np.array([[0.3]]), 0.5, 1e-6) == pytest.approx(0.3)


def test_soft_match_has_uniform_margins():
    rng = np.random.default_rng(0)
    c = rng.uniform(0, 1, (3, 5))
    sharp = K.soft_match(c, 1e-2, 1e-12)
    flat = K.soft_match(c, 1e6, 1e-12)
    assert flat == pytest.approx(c.mean(), abs=1e-5) and sharp > flat


def test_long_vectors_are_pooled_in_component_form(spark, monkeypatch):
    rows = molecules()
    wide = {r["mol_id"]: r["x"] for r in V.mean_pool(local(spark, rows), ["mol_id"]).collect()}
    monkeypatch.setattr(V, "WIDE_LIMIT", 2)
    for r in V.mean_pool(local(spark, rows), ["mol_id"]).collect():
        np.testing.assert_allclose(r["x"], wide[r["mol_id"]])


def test_absent_species_are_null_without_a_fallback(spark):
    df = local(spark, [(1, 0, "C", [1.0, 2.0])])
    assert V.species_pool(df, ["C", "N"]).first()["x"] == [1.0, 2.0, None, None]


def test_geometry_text(spark):
    df = spark.createDataFrame([("f", 0, [("O", 0.0, 0.5, 1.0), ("H", 1.0, 2.0, 3.0)])],
                               "file string, frame int, atoms array<struct<symbol:string,x:double,y:double,z:double>>")
    assert V.geometry_text(df).first()["geometry"] == "O 0.0 0.5 1.0\nH 1.0 2.0 3.0"
    assert V.geometry_text(df, [[1], [0]]).first()["geometry"] == "H 1.0 2.0 3.0\n--\nO 0.0 0.5 1.0"


def write_frames(path, n, comment=lambda i: f"-{i}.5 id={i}"):
    with open(path, "w") as f:
        for i in range(n):
            k = 1 + i % 5
            f.write(f"{k}\n{comment(i)}\n" + "".join(f"C {i}.0 {j} -1.5\n" for j in range(k)))


@pytest.mark.parametrize("split", [1 << 26, 100, 37])
@pytest.mark.parametrize("comment", [lambda i: f"-{i}.5 id={i}", lambda i: str(i % 7)])
def test_xyz_ranges_find_every_frame_once(spark, tmp_path, monkeypatch, split, comment):
    monkeypatch.setattr(xyz, "LOOK_BACK", 64)
    write_frames(tmp_path / "a.xyz", 40, comment)
    write_frames(tmp_path / "b.xyz", 3, comment)
    with open(tmp_path / "a.xyz", "rb") as h:
        size = (tmp_path / "a.xyz").stat().st_size
        frames = [f for s in range(0, size, split) for f in xyz.frames_in_range(h, s, min(s + split, size))]
    assert [len(f[2]) for f in frames] == [1 + i % 5 for i in range(40)]
    got = xyz.with_frame_numbers(xyz.read_xyz(spark, str(tmp_path), split)).orderBy("file", "frame").collect()
    assert [r["frame"] for r in got] == [*range(40), *range(3)]
    assert all(r["atoms"][0]["x"] == float(r["frame"]) for r in got)


def test_xyz_single_atom_file_with_an_empty_comment(spark, tmp_path):
    (tmp_path / "o.xyz").write_text("1\n\nO 0. 0. 0. \n")
    r = xyz.read_xyz(spark, str(tmp_path / "o.xyz")).first()
    assert r["info"] == {} and tuple(r["atoms"][0]) == ("O", 0.0, 0.0, 0.0)


def test_xyz_info_and_malformed_frames(spark, tmp_path):
    write_frames(tmp_path / "a.xyz", 2)
    df = xyz.read_xyz(spark, str(tmp_path / "a.xyz"))
    assert sorted(r[0] for r in df.select(xyz.info_number()).collect()) == [-1.5, -0.5]
    (tmp_path / "bad.xyz").write_text("2\nx\nC 0 0 0\nnot an atom\n")
    with pytest.raises(Exception, match="malformed frame"):
        xyz.read_xyz(spark, str(tmp_path / "bad.xyz")).collect()


def test_log_lines(spark):
    lines = ["PBE0, -1.5, 3.0", "PBE033, -2.5, 4.0", "PBE0_DH7, -3.5, 1.0", "12, -4.5, 2.0", "SCAN5, 10.0, 3.0, 2.0, 1.0, 4.0, 9.0, 0.5",
             "Traceback", "PBE3, x, 1.0", "PBE4, 1.0"]
    good, bad = calclog.parse_lines(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert sorted((r["method"], r["mol_id"]) for r in good.collect()) == [("CCSDT", 12), ("PBE", 0), ("PBE0", 33), ("PBE0_DH", 7), ("SCAN", 5)]
    assert {r["line"] for r in bad.collect()} == {"Traceback", "PBE3, x, 1.0", "PBE4, 1.0"}
    e = interaction_energy(calclog.energies(good.where("mol_id = 5"))).first()
    assert (e["interaction"], e["seconds"]) == (4.0, 9.0)


def test_csv_with_awkward_names(spark, tmp_path):
    schema = "`MAE ip, mean` double, `CCSDT-18` double"
    path = str(tmp_path / "t")
    tables.make_table(spark, path, schema, "csv")
    tables.append_rows(spark.createDataFrame([(1.0, 2.0)], "`CCSDT-18` double, `MAE ip, mean` double"), path, schema, "csv")
    tables.append_rows(spark.createDataFrame([(5.0,)], "`CCSDT-18` double"), path, schema, "csv")
    rows = tables.read_csv(spark, path, schema).orderBy("CCSDT-18").collect()
    assert [tuple(r) for r in rows] == [(2.0, 1.0), (None, 5.0)]
    with pytest.raises(ValueError, match="not in the table"):
        tables.append_rows(spark.createDataFrame([(1.0,)], "other double"), path, schema, "csv")


def test_runs_of_one_seed_are_replaced_and_pruned(spark, tmp_path):
    path = str(tmp_path / "runs")
    def rows(seed, value, n=3):
        return spark.range(n).select(F.lit(seed).alias("seed"), F.lit(320).alias("target"), F.lit(value).alias("mae_error"))
    tables.write_runs(rows(1, 1.0).unionByName(rows(2, 2.0)), path, RUNS)
    tables.write_runs(rows(2, 5.0, 2), path, RUNS)
    back = tables.read_runs(spark, path, RUNS)
    assert sorted(r["mae_error"] for r in back.collect()) == [1.0, 1.0, 1.0, 5.0, 5.0]
    pruned = tables.read_runs(spark, path, RUNS, seeds=[2])
    assert pruned.count() == 2
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", pruned._jdf.queryExecution().executedPlan().toString())
    assert "seed" in filters[1]


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_matches_in_stacks_equal_those_one_by_one(monkeypatch, cells):
    monkeypatch.setattr(K, "MATCH_CELLS", cells)
    rng = np.random.default_rng(4)
    p, q = ([rng.standard_normal((int(rng.integers(1, 6)), 3)) / 2 for _ in range(9)] for _ in range(2))
    i, j = (x.ravel() for x in np.indices((9, 9)))
    got = K.soft_matches(p, q, i, j, 0.5, 1e-9)
    np.testing.assert_allclose(got, [K.soft_match(p[a] @ q[b].T, 0.5, 1e-9) for a, b in zip(i, j)], rtol=1e-9)


def test_a_study_of_too_many_structures_needs_a_sample(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_PAIRS", 10)
    rows = molecules()
    with pytest.raises(ValueError, match="name a sample"):
        K.distance_summary(local(spark, rows), SPECIES, isolated(spark))
    got = K.distance_summary(local(spark, rows), SPECIES, isolated(spark), sample=4, seed=2).collect()
    assert len(got) == 12 and {r["partners"] for r in got} == {3}
    again = K.distance_summary(local(spark, rows), SPECIES, isolated(spark), sample=4, seed=2).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("panel", [1 << 25, 3000])
def test_gram_sums_copy_no_row_for_each_pair_of_blocks(spark, monkeypatch, panel):
    """In one pass and in many: keys that repeat or are null, blocks of five rows, never a row for each pair of blocks."""
    monkeypatch.setattr(K, "PANEL_BYTES", panel, raising=False)
    rng = np.random.default_rng(6)
    x, keys = rng.normal(size=(157, 3)), [None if i % 50 == 7 else i // 2 for i in range(157)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(keys, x)], "id bigint, x array<double>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    sums = K.gram_sums(df, "id", 2.0, 1.5, noise=0.25, block_rows=5)
    assert "Generate" not in sums._jdf.queryExecution().optimizedPlan().toString()
    assert before == {k: spark.conf.get(k) for k in before}
    row = (2.0 * np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 4.5)).sum(1) + 0.25
    got = {r["id"]: r["k_sum"] for r in sums.collect()}
    assert got.keys() == set(keys)
    for k, s in got.items():
        assert s == pytest.approx(sum(r for i, r in zip(keys, row) if i == k), abs=1e-9)
    assert K.gram_sums(df.where("false"), "id").collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_every_pair_of_blocks_meets_once(n):
    numbers = [k << 32 | 3 for k in range(n)]
    met = [(min(a, b), max(a, b)) for a in range(n) for b in K._partners(numbers[a], numbers)]
    assert sorted(met) == [(a, b) for a in range(n) for b in range(a, n)]
    assert K._partners(n << 32, numbers) == list(range(n))


@pytest.mark.parametrize("panel", [1 << 25, 2500])
def test_a_study_of_any_number_of_structures_is_whole(spark, monkeypatch, panel):
    """No bound unless one is set; in one pass and in many, from blocks that are not in the order of the keys."""
    monkeypatch.setattr(K, "PANEL_BYTES", panel, raising=False)
    monkeypatch.setattr(K, "BLOCK_ATOMS", 12)
    assert K.MAX_PAIRS is None
    rows = molecules(31)
    want = brute(rows)
    summary = K.distance_summary(local(spark, rows), SPECIES, isolated(spark))
    assert "Generate" not in summary._jdf.queryExecution().optimizedPlan().toString()
    got = summary.collect()
    assert len(got) == 93
    for r in got:
        d = [v[K.DISTANCES.index(r["kind"])] for p, v in want.items() if r["mol_id"] in p]
        assert r["partners"] == 30
        assert (r["mean"], r["smallest"], r["largest"]) == pytest.approx((np.mean(d), min(d), max(d)), abs=1e-7)
    table = np.array(list(want.values()))
    for r in K.distance_correlations(local(spark, rows), SPECIES, isolated(spark)).collect():
        i, j = K.DISTANCES.index(r["kind_a"]), K.DISTANCES.index(r["kind_b"])
        assert r["pairs"] == 465
        assert r["correlation"] == pytest.approx(np.corrcoef(table[:, i], table[:, j])[0, 1], abs=1e-6)


@pytest.mark.parametrize("cells", [1 << 16, 200, 1])
def test_a_table_of_matches_equals_those_one_by_one(monkeypatch, cells):
    """Sets of several sizes, small or too large to share a stack, each pair from its own first side."""
    monkeypatch.setattr(K, "LANE_CELLS", cells, raising=False)
    rng = np.random.default_rng(8)
    p, q = ([rng.standard_normal((int(rng.integers(1, 6)), 3)) / s for s in (2, 0.7, 4, 1, 2, 2, 1)] for _ in range(2))
    first, mask = rng.random((7, 7)) < 0.5, rng.random((7, 7)) < 0.8
    got = K.match_table(p, q, first, mask, 0.5, 1e-9)
    for i in range(7):
        for j in range(7):
            c = p[i] @ q[j].T
            want = K.soft_match(c if first[i, j] else c.T, 0.5, 1e-9) if mask[i, j] else 0.0
            assert got[i, j] == pytest.approx(want, rel=1e-9)
    np.testing.assert_allclose(K.own_matches(p, 0.5, 1e-9), [K.soft_match(x @ x.T, 0.5, 1e-9) for x in p], rtol=1e-9)
    np.testing.assert_allclose(K._match_lanes(np.stack([v[:1] @ v[:1].T for v in p], 2), 0.5, 1e-9, rounds=1),
                               [K.soft_match(v[:1] @ v[:1].T, 0.5, 1e-9, 1) for v in p])
