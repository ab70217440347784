"""Regression, search and calibration on line items as measurements.

The SQL twins solve the same systems exactly: a recursive CTE performs one
Gauss-Jordan step per iteration on the matrix held as a list of rows.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from tiersmith import schemas
from tiersmith.operators import gp as K, landmarks as L, search as H, stats as G
from tiersmith.operators.analysis import mean_over_runs, with_cost
from tiersmith.operators.methods import DEFAULT_A, Scenario, run_grid, single
from tiersmith.operators.relational import stack
from tiersmith.operators.rows import row_index
from tiersmith.operators.sampling import augmented_draw, nested_split, ranked_sample
from tiersmith.plans.adapters import MF_SQL, measurements, r6
from tiersmith.plans.registry import query
from tiersmith.session import cut_lineage, shared_dir
from tiersmith.sources import tables

TASKS = ["P", "S1", "S2"]
# Parameters of the example tasks and differences: task, variance, lengthscale, rho.
PARAMS = [("P", 1.0, 1.0, 1.0), ("S1", 0.05, 1.0, 0.95), ("S2", 0.05, 1.5, 0.9), ("P_S1", 0.2, 1.0, 1.0),
          ("P_S2", 0.2, 1.0, 1.0), ("S1_S2", 0.3, 1.0, 1.0), ("S2_S1", 0.3, 1.0, 1.0), ("S2_S1_P", 0.3, 1.0, -0.3)]


def params(spark):
    return spark.createDataFrame(PARAMS, schemas.PARAMS)


def dist(a: str, b: str) -> str:
    return f"power(list_distance({a}.x, {b}.x), 2)"


def single_kernel(v: float, l: str = "1.0") -> str:
    return f"{v}::double * exp(-{dist('{a}', '{b}')} / (2 * {l} * {l}))"


MULTI = f"({{a}}.rho * {{b}}.rho * exp(-{dist('{a}', '{b}')} / 2) + case when {{a}}.t = {{b}}.t and {{a}}.t > 0 then {{a}}.v * exp(-{dist('{a}', '{b}')} / (2 * {{a}}.l * {{a}}.l)) else 0 end)"


def solve_sql(kernel: str, rhs: str, noise: str = "0.015", inverse: bool = True, p: str = "") -> str:
    """CTEs from ``tr(c, i, x, ...)``: ``sol(c, n, m, logdet)`` with m = [rhs | inverse] per row."""
    unit = f"list_transform(range(1, sz.n + 1), lambda j: case when j = a.i then 1.0::double else 0.0 end)" if inverse else "[]::double[]"
    k = kernel.format(a="a", b="b")
    return f"""sz{p} as (select c, count(*) as n from tr{p} group by c),
mat{p} as (select a.c, a.i, list({k} + case when a.i = b.i then {noise} else 0 end order by b.i) as krow from tr{p} a join tr{p} b using (c) group by a.c, a.i),
aug{p} as (select a.c, any_value(sz.n) as n, list(list_concat(krow, list_concat({rhs}, {unit})) order by a.i) as m from tr{p} a join mat{p} using (c, i) join sz{p} sz on sz.c = a.c group by a.c),
gj{p} as (select c, n, 0 as k, m, 0.0::double as logdet from aug{p} union all
 select c, n, k + 1, list_transform(m, lambda r, idx: case when idx = k + 1 then prow else list_transform(r, lambda v, j: v - r[k + 1] * prow[j]) end), logdet + ln(piv)
 from (select c, n, k, m, logdet, m[k + 1][k + 1] as piv, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) as prow from gj{p} where k < n)),
sol{p} as materialized (select c, n, logdet, list_transform(m, lambda r: r[n + 1:]) as m from gj{p} where k = n)"""


def score_sql(kernel: str, prior: str, var: str, p: str = "") -> str:
    """CTE ``sc(c, id, mu, var)`` from ``te(c, id, x, ...)``."""
    k = kernel.format(a="tr", b="te")
    return f"""kv{p} as (select te.c, te.id, list({k} order by tr.i) as kv from te{p} te join tr{p} tr using (c) group by te.c, te.id),
sc{p} as (select kv.c, kv.id, {prior} + list_dot_product(kv, list_transform(sol.m, lambda r: r[1])) as mu,
 {var} - list_dot_product(kv, list_transform(sol.m, lambda r: list_dot_product(r[2:], kv))) as var
 from kv{p} kv join sol{p} sol using (c) join pm{p} pm using (c))"""


RANKED = f"""{MF_SQL}, rk as materialized (select *, row_number() over (order by md5(concat(id, '-1')), id) as rank from mf)"""

SINGLE = f"""with recursive {RANKED}, base as (select 1 as c, rank as i, x, P as y from rk where rank <= 40),
pm as (select c, avg(y) as m from base group by c), tr as materialized (select base.*, y - m as r from base join pm using (c)),
te as (select 1 as c, id, x from rk where rank > 40), {solve_sql(single_kernel(1.0), '[a.r]')}, {score_sql(single_kernel(1.0), 'pm.m', '1')}"""


def _ranked(spark, sf, n):
    """The first n rows of the seed-1 order, written once."""
    return cut_lineage(ranked_sample(measurements(spark, sf), "id", n, [1]).drop("seed"))


def _train(spark, rows, tasks, counts, cell="all"):
    """Training rows: the first ``counts[i]`` ranked rows under task i."""
    table = {t: (v, l, rho) for t, v, l, rho in PARAMS}
    blocks = [rows.where(F.col("rank") <= n).select(
        F.lit(cell).alias("cell_id"), F.lit(i).alias("task_no"), "x", F.col(t).alias("y"),
        F.lit(table[t][2]).alias("rho"), F.lit(table[t][0]).alias("variance"), F.lit(table[t][1]).alias("lengthscale"))
        for i, (t, n) in enumerate(zip(tasks, counts))]
    return stack(blocks)


def _rest(spark, sf, rows, n, keep=("id", "x")):
    used = rows.where(F.col("rank") <= n).select("id")  # at most n rows, so the hint is bounded
    return measurements(spark, sf).join(F.broadcast(used), "id", "left_anti").select(*keep)


def _rounded(df, digits=5):
    return df.select("id", *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in ("mu", "sigma")])


OUT = "select id, round(mu, 5) + 0.0 as mu, round(sqrt(greatest(var, 0)), 5) + 0.0 as sigma from "


@query("gp_single", f"{SINGLE} {OUT} sc")
def gp_single(spark, sf):
    rows = _ranked(spark, sf, 40)
    fits = K.fit_models(_train(spark, rows, ["P"], [40]))
    return _rounded(K.score_rows(_rest(spark, sf, rows, 40), fits))


MULTI_TRAIN = """base as (select 1 as c, rank as i, x, P as y, 0 as t, 1.0::double as rho, 1.0::double as v, 1.0::double as l from rk where rank <= 20
 union all select 1, 20 + rank, x, S1, 1, 0.95::double, 0.05::double, 1.0::double from rk where rank <= 60),
pm0 as (select c, t, avg(y) as m from base group by c, t), pm as (select c, m from pm0 where t = 0),
tr as materialized (select base.*, y - m as r from base join pm0 using (c, t))"""
MULTI_SQL = f"""with recursive {RANKED}, {MULTI_TRAIN}, te as (select 1 as c, id, x, 0 as t, 1.0::double as rho, 1.0::double as v, 1.0::double as l, S1 as low from rk where rank > 60),
{solve_sql(MULTI, '[a.r]')}, {score_sql(MULTI, 'pm.m', '1')}"""


@query("gp_multi", f"{MULTI_SQL} {OUT} sc")
def gp_multi(spark, sf):
    rows = _ranked(spark, sf, 60)
    fits = K.fit_models(_train(spark, rows, ["P", "S1"], [20, 60]))
    return _rounded(K.score_rows(_rest(spark, sf, rows, 60), fits))


@query("gp_with_target", f"""{MULTI_SQL},
kb as (select te.id, list({MULTI.replace('{b}.rho', '0.95::double').replace('{a}.t = {b}.t and ', '{a}.t = 1 and ').format(a='tr', b='te')} order by tr.i) as kb from te join tr using (c) group by te.id),
b as (select kv.id, kv.kv, kb.kb, list_transform(sol.m, lambda r: list_dot_product(r[2:], kb)) as w, list_transform(sol.m, lambda r: r[1]) as al from kv join kb using (id) join sol using (c)),
q as (select id, 0.95::double - list_dot_product(kv, w) as q, 0.95::double * 0.95::double + 0.05 + 0.015 - list_dot_product(kb, w) as s, list_dot_product(kb, al) as pb from b),
tt as (select te.id, sc.mu + q / s * (te.low - p1.m - pb) as mu, sc.var - q * q / s as var from te join sc using (id) join q using (id), (select m from pm0 where t = 1) p1)
{OUT} tt""")
def gp_with_target(spark, sf):
    rows = _ranked(spark, sf, 60)
    fits = K.fit_models(_train(spark, rows, ["P", "S1"], [20, 60]))
    test = _rest(spark, sf, rows, 60, ("id", "x", F.col("S1").alias("low")))
    return _rounded(K.score_rows(test, fits, low="low"))


def _delta_level(p: str, value: str, v: float, n: int) -> str:
    return f"""base{p} as (select 1 as c, rank as i, x, {value} as y from rk where rank <= {n}), pm{p} as (select c, avg(y) as m from base{p} group by c),
tr{p} as materialized (select b.*, y - m as r from base{p} b join pm{p} using (c)), te{p} as (select 1 as c, id, x from rk where rank > 40),
{solve_sql(single_kernel(v), '[a.r]', p=p)}, {score_sql(single_kernel(v), 'pm.m', str(v) + '::double', p=p)}"""


DELTA_SQL = f"with recursive {RANKED}, {_delta_level('_1', 'P - S1', 0.2, 20)}, {_delta_level('_2', 'S1 - S2', 0.3, 40)}"


def _delta(spark, sf, score=K.score_rows):
    rows = _ranked(spark, sf, 40)
    diff = rows.withColumn("P_S1", F.col("P") - F.col("S1")).withColumn("S1_S2", F.col("S1") - F.col("S2"))
    train = stack([_train(spark, diff, ["P_S1"], [20], "all#1"), _train(spark, diff, ["S1_S2"], [40], "all#2")])
    return score(_rest(spark, sf, rows, 40, ("id", "x", "P", "S2")), K.fit_models(train))


@query("delta_sum", f"""{DELTA_SQL} select id, round(a.mu + b.mu, 5) + 0.0 as mu, round(sqrt(greatest(a.var, 0) + greatest(b.var, 0)), 5) + 0.0 as sigma from sc_1 a join sc_2 b using (id)""")
def delta_sum(spark, sf):
    return _rounded(K.sum_levels(_delta(spark, sf), ["id"]))


@query("gp_delta", f"""{DELTA_SQL} select id, round(a.mu + b.mu + S2, 5) + 0.0 as mu, round(sqrt(greatest(a.var, 0) + greatest(b.var, 0)), 5) + 0.0 as sigma,
 round(P, 5) as truth from sc_1 a join sc_2 b using (id) join mf using (id)""")
def gp_delta(spark, sf):
    total = _delta(spark, sf, K.score_levels)
    return total.select("id", *[(F.round(c, 5) + F.lit(0.0)).alias(n) for c, n in ((F.col("mu") + F.col("S2"), "mu"), ("sigma", "sigma"))],
                        F.round("P", 5).alias("truth"))


@query("prior_means", f"""with {RANKED}, g as (select * from (values ('n50', 50), ('n500', 500), ('all', (select count(*) from rk))) t(cell_id, n)),
m as (select cell_id, avg(P) as p, avg(S1) as s1, avg(S2) as s2 from rk join g on rank <= n group by cell_id)
select cell_id, unnest([0, 1, 2]) as task_no, round(unnest([p, s1 - 0.95::double * p, s2 - 0.9::double * p]), 6) as prior_mean from m""")
def prior_means(spark, sf):
    n = measurements(spark, sf).count()
    rows = _ranked(spark, sf, n)
    train = stack([_train(spark, rows, TASKS, [k] * 3, name) for name, k in (("n50", 50), ("n500", 500), ("all", n))])
    return K.prior_means(train).select("cell_id", "task_no", r6("prior_mean", "prior_mean"))


LENGTHS = [0.3, 0.6, 1.0, 1.6]
CAND_SQL = f"""with recursive {RANKED}, cand as (select unnest({[f'{v}' for v in LENGTHS]})::double as l),
tr as materialized (select cast(l as varchar) || t as c, l, t, rank as i, x, y from (select rank, x, unnest(['P', 'S1']) as t, unnest([P, S1]) as y from rk where rank <= 30), cand),
{solve_sql(single_kernel(1.0, '{a}.l'), '[a.y, 1.0::double]', inverse=False)},
gls as (select c, n, logdet, list_sum(list_transform(m, lambda r: r[1])) / list_sum(list_transform(m, lambda r: r[2])) as mu, m from sol),
res as (select gls.c, any_value(l) as theta, any_value(t) as task, any_value(n) as n, any_value(logdet) as logdet, any_value(mu) as mu, sum((y - mu) * (m[i][1] - mu * m[i][2])) / any_value(n) as var from gls join tr using (c) group by gls.c)"""


def _candidates(spark, sf, n=30):
    rows = _ranked(spark, sf, n)
    long = rows.select(F.lit(1).alias("seed"), F.col("id").alias("key"), "x", F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(t).alias("y")) for t in ("P", "S1")])).alias("e")).select("seed", "key", "x", "e.*")
    cands = long.select("task", "seed").distinct().withColumn("theta", F.explode(F.array(*[F.lit(v) for v in LENGTHS])))
    return H.evaluate(long, cands, H.nlml_score)


@query("gls_moments", f"{CAND_SQL} select task, theta, round(mu, 6) + 0.0 as mu, round(var, 6) as var from res")
def gls_moments(spark, sf):
    return _candidates(spark, sf).select("task", "theta", r6("mu", "mu"), r6("var", "var"))


@query("nlml_grid", f"{CAND_SQL} select task, theta, round(0.5 * n * ln(var) + 0.5 * logdet, 6) + 0.0 as score from res")
def nlml_grid(spark, sf):
    return _candidates(spark, sf).select("task", "theta", r6("score", "score"))


SCAN_SQL = CAND_SQL.replace(f"unnest({[f'{v}' for v in LENGTHS]})::double as l", "unnest([exp(-1.2 + k * 0.03) for k in range(101)])::double as l")


@query("likelihood_minimum", f"""{SCAN_SQL},
sc as (select task, ln(theta) as t, 0.5 * n * ln(var) + 0.5 * logdet as s from res),
nb as (select *, lag(s) over w as a, lead(s) over w as b, row_number() over (partition by task order by s) as place from sc window w as (partition by task order by t))
select task, round(exp(t + 0.015 * (a - b) / (a - 2 * s + b)), 2) as lengthscale, round(s - (a - b) * (a - b) / (8 * (a - 2 * s + b)), 3) + 0.0 as score,
 true as converged, false as at_bound from nb where place = 1""")
def likelihood_minimum(spark, sf):
    """The lengthscale of greatest likelihood, found by its slope; the twin scans a fine grid and puts a parabola through its best point."""
    rows = _ranked(spark, sf, 30)
    long = rows.select(F.lit(1).alias("seed"), F.col("id").alias("key"), "x", F.explode(F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(t).alias("y")) for t in ("P", "S1")])).alias("e")).select("seed", "key", "x", "e.*")
    best = H.minimise(long, H.likelihood, 1e-2, 100.0)
    return best.select("task", F.round("theta", 2).alias("lengthscale"), (F.round("score", 3) + F.lit(0.0)).alias("score"), "converged", "at_bound")


#: Rows that studies reserve for the search of hyperparameters.
SEARCH_ROWS = 150


@query("gls_moments_stock")
def gls_moments_stock(spark, sf):
    """The moments on all rows of a search."""
    return _candidates(spark, sf, SEARCH_ROWS).select("task", "theta", r6("mu", "mu"), r6("var", "var"))


@query("nlml_grid_stock")
def nlml_grid_stock(spark, sf):
    """The likelihoods on all rows of a search."""
    return _candidates(spark, sf, SEARCH_ROWS).select("task", "theta", r6("score", "score"))


CURVE_CORES, CURVE_SEEDS, CURVE_TARGET = (5, 10, 20, 40), [1, 2], 320
CURVE_SQL = f"""with recursive {MF_SQL}, seeds as (select unnest({CURVE_SEEDS}) as seed),
rk as materialized (select id, x, P, seed, row_number() over (partition by seed order by md5(concat(id, '-', seed)), id) as rank from mf, seeds qualify rank <= {CURVE_TARGET + 40}),
cores as (select unnest({list(CURVE_CORES)}) as core),
base as (select seed * 1000 + core as c, rank - {CURVE_TARGET} as i, x, P as y from rk, cores where rank > {CURVE_TARGET} and rank <= {CURVE_TARGET} + core),
pm as (select c, avg(y) as m from base group by c), tr as materialized (select base.*, y - m as r from base join pm using (c)),
te as (select seed * 1000 + core as c, id, x, P as truth from rk, cores where rank <= {CURVE_TARGET}),
{solve_sql(single_kernel(1.0), '[a.r]')}, {score_sql(single_kernel(1.0), 'pm.m', '1')},
pr as (select sc.c, mu, sqrt(greatest(var, 0)) as sigma, truth from sc join te using (c, id)),
rr as (select *, rank() over (partition by c order by mu) as ra, rank() over (partition by c order by truth) + (count(*) over (partition by c, truth) - 1) / 2.0 as rb from pr)
select cast(c // 1000 as integer) as seed, cast(c % 1000 as bigint) as high_level, round(avg(abs(mu - truth)), 6) as mae_error, round(median(abs(mu - truth)), 6) as median_ae_error,
 round(avg(sigma), 6) as mae_std, round(corr(mu, truth), 6) as pearson_error, round(corr(ra, rb), 6) as spearman_error,
 round((c % 1000) * 24550.3::double, 4) as cost from rr group by c"""


@query("learning_curve", CURVE_SQL)
def learning_curve(spark, sf):
    """Exact samples, a grid of training sets, grouped fits, statistics and cost."""
    grid = run_grid(measurements(spark, sf), "id", ["P"], params(spark),
                    [single("curve", "P", CURVE_CORES)], CURVE_SEEDS, CURVE_TARGET)
    cols = ["mae_error", "median_ae_error", "mae_std", "pearson_error", "spearman_error"]
    return with_cost(grid).select("seed", "high_level", *[r6(c, c) for c in cols], F.round("cost", 4).alias("cost"))


@query("learning_curve_stock")
def learning_curve_stock(spark, sf):
    """The curve at the size that studies run it: six seeds, core sets up to 320 and single-task sets up to 2560."""
    grid = run_grid(measurements(spark, sf), "id", ["P"], params(spark),
                    [single("curve", "P", (5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560))], list(range(6)), CURVE_TARGET)
    cols = ["mae_error", "median_ae_error", "mae_std", "pearson_error", "spearman_error"]
    return with_cost(grid).select("seed", "high_level", *[r6(c, c) for c in cols], F.round("cost", 4).alias("cost"))


COMPARED = [
    single("single", "P", (10, 20)),
    Scenario("two", "multitask", "P", ("S1",), (10, 20), (0.0, 1.0), (0.0, 1.0, 2.0)),
    Scenario("two target", "multitask_with_target", "P", ("S1",), (10, 20), (0.0, 1.0), (0.0, 1.0, 2.0)),
    Scenario("three", "multitask", "P", ("S1", "S2"), (10, 20), (0.0, 1.0), (0.0, 1.0, 2.0), (0.5, 1.0)),
    Scenario("delta", "delta", "P", ("S2",), (10, 20), (1.0,), (0.0,)),
    Scenario("chain", "delta", "P", ("S1", "S2"), (10, 20), (1.0,), (0.0, 1.0)),
    Scenario("differences", "multitask_with_target", "P_S1", ("S2_S1",), (10, 20), (1.0,), (1.0,),
             parameters=("P_S1", "S2_S1_P"))]


STOCK_CORES, STOCK_SEEDS = (5, 10, 20, 40, 80, 160, 320), list(range(6))
#: The scenarios at the core sets of studies; multi-task sets and chains with all their additional sets.
STOCK = [replace(s, cores=STOCK_CORES, a_ratios=s.a_ratios if s.method == "delta" and len(s.secondaries) == 1 else DEFAULT_A)
         if s.secondaries else replace(s, cores=(*STOCK_CORES, 640, 1280, 2560)) for s in COMPARED]


@query("method_grid")
def method_grid(spark, sf):
    """All methods over one grid: the run-result table."""
    return _method_grid(spark, sf, COMPARED, [1, 2], 160)


@query("method_grid_stock")
def method_grid_stock(spark, sf):
    """The grid at the size that studies run it."""
    return _method_grid(spark, sf, STOCK, STOCK_SEEDS, CURVE_TARGET)


def _method_grid(spark, sf, scenarios, seeds, target):
    grid = run_grid(measurements(spark, sf), "id", TASKS, params(spark), scenarios, seeds, target)
    numbers = [f.name for f in grid.schema if f.dataType.simpleString() == "double"
               and f.name not in ("train_time", "test_time", "task_fractions")]
    return grid.select("levels", "lowest", "method", "datasets", "task_fractions", "high_level", "low_level", "target", "seed",
                       *[r6(c, c) for c in numbers])


def _landmarks(spark, sf, m):
    """Features of a bounded sample, in rank order."""
    rows = ranked_sample(measurements(spark, sf), "id", m, [1]).orderBy("rank").select("x").collect()
    return np.array([r["x"] for r in rows])


@query("gp_inducing", f"""with recursive {RANKED}, z as materialized (select rank as i, x from rk where rank <= 20),
kn as (select mf.id, P, list(exp(-{dist('z', 'mf')} / 2) order by z.i) as k from mf join z on true group by mf.id, P),
pm as (select avg(P) as m from mf),
ks as (select i, j, sum(k[i] * k[j]) as s from kn, (select unnest(range(1, 21)) as i), (select unnest(range(1, 21)) as j) group by i, j),
kb as (select i, sum(k[i] * (P - m)) as b from kn, pm, (select unnest(range(1, 21)) as i) group by i),
tr as materialized (select 1 as c, z.i, x, b from z join kb using (i)),
sz as (select 1 as c, 20 as n),
aug as (select 1 as c, 20 as n, list(list_concat(row, [b]) order by i) as m from (select ks.i, list(s + 0.015 * exp(-{dist('a', 'b')} / 2) order by ks.j) as row
 from ks join z a on a.i = ks.i join z b on b.i = ks.j group by ks.i) join kb using (i)),
gj as (select c, n, 0 as k, m from aug union all select c, n, k + 1, list_transform(m, lambda r, idx: case when idx = k + 1 then prow else list_transform(r, lambda v, j: v - r[k + 1] * prow[j]) end)
 from (select c, n, k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) as prow from gj where k < n)),
w as (select list_transform(m, lambda r: r[21]) as w from gj where k = 20)
select count(*) as n, round(avg(abs(m + list_dot_product(k, w) - P)), 4) as mae, round(max(abs(m + list_dot_product(k, w) - P)), 3) as worst from kn, w, pm""")
def gp_inducing(spark, sf):
    mf = measurements(spark, sf).select("id", "x", F.col("P").alias("y"))
    fit = K.inducing_fit(mf, _landmarks(spark, sf, 20), 1.0, 1.0)
    err = F.abs(F.col("mu") - F.col("y"))
    return K.inducing_score(mf, fit).agg(F.count("*").alias("n"), F.round(F.avg(err), 4).alias("mae"),
                                         F.round(F.max(err), 3).alias("worst"))


def derived_sql() -> str:
    return f"""{MF_SQL}, r as (select corr(P, S1) as r1, corr(P, S2) as r2 from mf), d as (select id, 'P' as task, P as y from mf
 union all select id, 'S1', S1 - r1 * P from mf, r union all select id, 'S2', S2 - r2 * P from mf, r
 union all select id, 'P_S1', P - S1 from mf union all select id, 'P_S2', P - S2 from mf union all select id, 'S1_S2', S1 - S2 from mf)"""


@query("derived_tasks", f"with {derived_sql()} select task, count(*) as n, round(avg(y), 6) as mean, round(stddev_pop(y), 6) as spread from d group by task")
def derived_tasks(spark, sf):
    d = H.derived_tasks(measurements(spark, sf), "P", ["S1", "S2"], ["id"])
    return d.groupBy("task").agg(F.count("*").alias("n"), r6(F.avg("y"), "mean"), r6(F.stddev_pop("y"), "spread"))


@query("task_correlations", f"""with {MF_SQL}, r(task, source_task, rho) as (
 select 'P', 'P', 1.0 from mf union select 'S1', 'S1', corr(P, S1) from mf union select 'S2', 'S2', corr(P, S2) from mf
 union select 'P_S1', 'P_S1', 1.0 from mf union select 'P_S2', 'P_S2', 1.0 from mf
 union select 'P_S1_S2', 'P_S1', corr(P - S1, P - S2) from mf union select 'P_S2_S1', 'P_S2', corr(P - S2, P - S1) from mf
 union select 'S1_S2', 'S1_S2', 1.0 from mf union select 'S2_S1', 'S1_S2', 1.0 from mf
 union select 'S1_S2_P', 'S1_S2', corr(S1 - S2, P - S2) from mf union select 'S2_S1_P', 'S1_S2', corr(S2 - S1, P - S1) from mf)
select task, source_task, round(rho::double, 6) + 0.0 as rho from r""")
def task_correlations(spark, sf):
    t = H.task_correlations(measurements(spark, sf), "P", ["S1", "S2"])
    return t.select("task", "source_task", r6("rho", "rho"))


@query("search_campaign")
def search_campaign(spark, sf):
    """Hyperparameters of every derived task and seed on a reserved sample."""
    return _campaign(spark, sf, 60, [1, 2, 3])


@query("search_campaign_stock")
def search_campaign_stock(spark, sf):
    """The campaign at the size that studies run it: 150 rows and 100 seeds."""
    return _campaign(spark, sf, SEARCH_ROWS, list(range(1, 101)))


def _campaign(spark, sf, n, seeds, **options):
    rows = cut_lineage(ranked_sample(measurements(spark, sf), "id", n, [1]).drop("seed", "rank"))
    log = H.campaign(rows, "id", "P", ["S1", "S2"], seeds, **options)
    return log.select("task", "seed", *[r6(c, c) for c in ("variance", "variance_mle", "lengthscale", "rho",
                                                           "objective_mle", "objective_mae")], "time_mle", "time_mae", "converged", "reason")


@query("search_study")
def search_study(spark, sf):
    """Which estimate of the variance predicts better, by size of the search set."""
    return _search_study(spark, sf, 80, 200, [12, 24], 6, 4)


@query("search_study_stock")
def search_study_stock(spark, sf):
    """The study at the size that it is run at: five sizes up to all rows of a search, 20 accepted searches of each."""
    return _search_study(spark, sf, SEARCH_ROWS, 2 * SEARCH_ROWS, [10, 45, 80, 115, 150], 40, 20)


def _search_study(spark, sf, n, total, sizes, attempts, limit, **options):
    rows = cut_lineage(ranked_sample(measurements(spark, sf), "id", total, [1]).drop("seed"))
    long = rows.select("rank", F.lit("P").alias("task"), F.col("id").alias("key"), "x", F.col("P").alias("y"))
    study = H.search_study(long.where(F.col("rank") <= n).drop("rank"), sizes, attempts, limit, long.where(F.col("rank") > n).drop("rank"), **options)
    return study.select("task", "n", "seed", *[r6(c, c) for c in ("variance", "variance_mle", "lengthscale", "mle_mae", "mae_mae")],
                        "time_mle", "time_mae", "missing")


CALIB_SQL = f"""with recursive {MF_SQL}, rk as materialized (select *, row_number() over (order by md5(concat(id, '-1')), id) as r0 from mf qualify r0 <= 1560),
base as (select 1 as c, r0 - 1500 as i, x, P as y, 0 as t, 1.0::double as rho, 1.0::double as v, 1.0::double as l from rk where r0 > 1500 and r0 <= 1520
 union all select 2, r0 - 1500, x, P, 0, 1.0::double, 1.0::double, 1.0::double from rk where r0 > 1500 and r0 <= 1520
 union all select 2, 20 + r0 - 1500, x, S1, 1, 0.95::double, 0.05::double, 1.0::double from rk where r0 > 1500),
pm0 as (select c, t, avg(y) as m from base group by c, t), pm as (select c, m from pm0 where t = 0),
tr as materialized (select base.*, y - m as r from base join pm0 using (c, t)),
te as (select c, id, x, 0 as t, 1.0::double as rho, 1.0::double as v, 1.0::double as l from rk, (values (1), (2)) q(c) where r0 <= 1500),
{solve_sql(MULTI, '[a.r]')}, {score_sql(MULTI, 'pm.m', '1')},
cal as (select sc.id, sc.c as tasks, sc.mu, sqrt(greatest(var, 0)) as sigma, P as truth, S1 as truth_secondary from sc join rk using (id))"""


def _calibration_rows(spark, sf):
    """One- and two-task predictions of 1500 target rows with both truths."""
    pool = cut_lineage(nested_split(measurements(spark, sf), "id", 1500, 20, 40, [1]))
    rows = pool.where("part <> 'T'").withColumn("rank", F.when(F.col("part") == "C", F.col("pos")).otherwise(F.col("pos") + 20))
    train = cut_lineage(stack([_train(spark, rows, ["P"], [20], "1"), _train(spark, rows, ["P", "S1"], [20, 60], "2")]))
    test = pool.where("part = 'T'").select("id", "x", F.col("P").alias("truth"), F.col("S1").alias("truth_secondary"))
    return K.score_rows(test, K.fit_models(train)).withColumn("tasks", F.col("cell_id").cast("int")).drop("cell_id")


@query("calibration_rows", f"""{CALIB_SQL} select id, tasks, round(mu, 5) + 0.0 as mu, round(sigma, 5) as sigma, truth as truth_primary, truth_secondary from cal""")
def calibration_rows(spark, sf):
    return _calibration_rows(spark, sf).select("id", "tasks", (F.round("mu", 5) + F.lit(0.0)).alias("mu"), F.round("sigma", 5).alias("sigma"),
                                               F.col("truth").alias("truth_primary"), "truth_secondary")


@query("calibration_run", f"""{CALIB_SQL}, sc2 as (select tasks, abs(mu - truth) / sigma as score, row_number() over (partition by tasks order by abs(mu - truth) / sigma) as i,
 count(*) over (partition by tasks) as n from cal where md5(id) < '8'),
q as (select tasks, n, score as scale from sc2 where i = ceil((n + 1) * (1 - 0.05::double)))
select tasks, any_value(n) as n, round(any_value(scale), 5) as scale, round(avg(cast(truth > mu - sigma and truth < mu + sigma as double)), 6) as before,
 round(avg(cast(truth > mu - scale * sigma and truth < mu + scale * sigma as double)), 6) as after from cal join q using (tasks) where not md5(id) < '8' group by tasks""")
def calibration_run(spark, sf):
    """Conformal scales from one half of the target rows and coverage on the other."""
    pred = cut_lineage(_calibration_rows(spark, sf))
    half = F.md5("id") < "8"
    scales = G.conformal_scales(pred.where(half), ["tasks"], "id")
    cover = G.coverage(G.apply_scales(pred.where(~half), scales, ["tasks"]), ["tasks"])
    return cover.join(scales, "tasks").select("tasks", "n", F.round("scale", 5).alias("scale"), r6("before", "before"), r6("after", "after"))


@query("recorded_runs")
def recorded_runs(spark, sf):
    """Result rows written per (target, seed), read back by one pruned scan, averaged and priced."""
    return _recorded(spark, sf, (5, 10, 20), [1, 2, 3], 160)


@query("recorded_runs_stock")
def recorded_runs_stock(spark, sf):
    """The same with the core sets and seeds of studies."""
    return _recorded(spark, sf, STOCK_CORES, STOCK_SEEDS, CURVE_TARGET)


def _recorded(spark, sf, cores, seeds, target):
    path = f"{shared_dir(spark).rstrip('/')}/recorded-{uuid.uuid4().hex}"
    grid = run_grid(measurements(spark, sf), "id", ["P"], params(spark), [single("curve", "P", cores)], seeds, target)
    tables.write_runs(grid, path, schemas.RUNS)
    back = tables.read_runs(spark, path, schemas.RUNS, seeds=[1, 3], target=target)
    means = with_cost(mean_over_runs(back, ["mae_error", "spearman_error"]))
    return means.select("method", "high_level", "n_runs", r6("mae_error", "mae_error"), r6("spearman_error", "spearman_error"), "cost")


@query("extended_curve")
def extended_curve(spark, sf):
    """Single-task sets beyond the matched rows: part of the pool from each stratum."""
    return _extended(spark, sf, 600, 1200, (80, 160, 320, 640))


@query("extended_curve_stock")
def extended_curve_stock(spark, sf):
    """The same up to the 2560 rows of studies."""
    return _extended(spark, sf, 1440, 2880, (80, 160, 320, 640, 1280, 2560))


def _extended(spark, sf, n, m, cores):
    mf = measurements(spark, sf)
    total = mf.count()
    pool = cut_lineage(augmented_draw(row_index(mf, ["id"], n=total), "id", mf.where("P > 3").select("id"), total // 2, n, m, 1))
    grid = run_grid(pool.select("id", "x", "P"), "id", ["P"], params(spark), [single("curve", "P", cores)], [1], 320)
    return with_cost(grid).select("high_level", r6("mae_error", "mae_error"), r6("kendall_error", "kendall_error"), "cost")


MT_CELLS = """seeds as (select unnest([1, 2]) as seed), rk as materialized (select id, x, P, S1, S2, seed,
 row_number() over (partition by seed order by md5(concat(id, '-', seed)), id) as r0 from mf, seeds qualify r0 <= 200),
cells as (select *, row_number() over () as c from seeds, (select unnest([10, 20]) as core), (select unnest([0, 1]) as cr), (select unnest([0, 2]) as ar) where cr + ar > 0),
base0 as (select c, seed, r0 - 140 as i, x, 0 as t, P as y from cells join rk using (seed) where r0 > 140 and r0 <= 140 + core
 union all select c, seed, 1000 + r0, x, 1, S1 from cells join rk using (seed) where (cr = 1 and r0 > 140 and r0 <= 140 + core) or (r0 > 160 and r0 <= 160 + ar * core)
 union all select c, seed, 2000 + r0, x, 2, S2 from cells join rk using (seed) where (cr = 1 and r0 > 140 and r0 <= 140 + core) or (r0 > 160 and r0 <= 160 + ar * core)),
base as (select c, row_number() over (partition by c order by i) as i, x, t, y, [1.0::double, 0.95, 0.9][t + 1] as rho, [1.0::double, 0.05, 0.05][t + 1] as v, [1.0::double, 1.0, 1.5][t + 1] as l from base0),
pm0 as (select c, t, avg(y) as m from base group by c, t), pm as (select c, m from pm0 where t = 0),
tr as materialized (select base.*, y - m as r from base join pm0 using (c, t)),
te as (select c, id, x, 0 as t, 1.0::double as rho, 1.0::double as v, 1.0::double as l, P as truth from cells join rk using (seed) where r0 <= 140)"""


@query("multitask_grid", f"""with recursive {MF_SQL}, {MT_CELLS}, {solve_sql(MULTI, '[a.r]')}, {score_sql(MULTI, 'pm.m', '1')},
pr as (select sc.c, mu, sqrt(greatest(var, 0)) as sigma, truth from sc join te using (c, id)),
rr as (select *, rank() over (partition by c order by mu) as ra, rank() over (partition by c order by truth) + (count(*) over (partition by c, truth) - 1) / 2.0 as rb from pr),
st as (select c, avg(abs(mu - truth)) as mae, max(abs((mu - truth) / truth)) as worst, avg(sigma) as spread, corr(ra, rb) as sp from rr group by c)
select cast(seed as integer) as seed, cast(core as bigint) as high_level, cast(2 * core * (cr + ar) as bigint) as low_level,
 concat(case when cr > 0 then 'C' else '' end, case when ar > 0 then 'A' else '' end) as datasets,
 round(mae, 6) as mae_error, round(worst, 6) as maximum_ae_relative, round(spread, 6) as mae_std, round(sp, 6) as spearman_error from cells join st using (c)""")
def multitask_grid(spark, sf):
    """Three-task fits over a grid of core and additional sets."""
    return _three_tasks(spark, sf, (10, 20), (0.0, 2.0), [1, 2], 140)


@query("multitask_grid_stock")
def multitask_grid_stock(spark, sf):
    """The same with the core sets, additional sets and seeds of studies."""
    return _three_tasks(spark, sf, STOCK_CORES, DEFAULT_A, STOCK_SEEDS, CURVE_TARGET)


def _three_tasks(spark, sf, cores, a_ratios, seeds, target):
    grid = run_grid(measurements(spark, sf), "id", TASKS, params(spark),
                    [Scenario("three", "multitask", "P", ("S1", "S2"), cores, (0.0, 1.0), a_ratios)], seeds, target)
    return grid.select("seed", "high_level", "low_level", "datasets",
                       *[r6(c, c) for c in ("mae_error", "maximum_ae_relative", "mae_std", "spearman_error")])


LANDMARKS = {"P": 8, "S1": 6, "S2": 4}
LM_COV = f"""({{a}}.rho * {{b}}.rho * exp(-{dist('{a}', '{b}')} / 2) + case when {{a}}.t = {{b}}.t and {{a}}.t > 0 then {{a}}.v * exp(-{dist('{a}', '{b}')} / (2 * {{a}}.l * {{a}}.l)) else 0 end)"""


@query("gp_landmarks", f"""with recursive {RANKED},
z as materialized (select rank as i, x, case when rank <= 8 then 0 when rank <= 14 then 1 else 2 end as t from rk where rank <= 18),
th as (select unnest([0, 1, 2]) as t, unnest([1.0::double, 0.95, 0.9]) as rho, unnest([1.0::double, 0.05, 0.05]) as v, unnest([1.0::double, 1.0, 1.5]) as l),
zt as materialized (select * from z join th using (t)),
lg as (select id, x, unnest([0, 1, 2]) as t, unnest([P, S1, S2]) as y from mf), pm as (select t, avg(y) as m from lg group by t),
rw as (select lg.id, x, t, rho, v, l, y - m as r from lg join th using (t) join pm using (t)),
kn as materialized (select rw.id, rw.t, rw.r, list({LM_COV.format(a='zt', b='rw')} order by zt.i) as k from rw join zt on true group by rw.id, rw.t, rw.r),
ij as (select unnest(range(1, 19)) as i), ks as (select a.i, b.i as j, sum(k[a.i] * k[b.i]) as s from kn, ij a, ij b group by a.i, b.i),
kb as (select i, sum(k[i] * r) as b from kn, ij group by i),
kz as (select a.i, b.i as j, {LM_COV.format(a='a', b='b')} + case when a.i = b.i then 1e-10 else 0 end as kz from zt a, zt b),
aug as (select c, 18 as n, list(list_concat(row, unit) order by i) as m from (
  select 1 as c, i, list(s + 0.015 * kz order by j) as row from ks join kz using (i, j) group by i union all
  select 2, i, list(kz order by j) from kz group by i) join (select i, list_transform(range(1, 19), lambda j: case when j = a.i then 1.0::double else 0.0 end) as unit from ij a) using (i) group by c),
gj as (select c, n, 0 as k, m from aug union all select c, n, k + 1, list_transform(m, lambda r, idx: case when idx = k + 1 then prow else list_transform(r, lambda v, j: v - r[k + 1] * prow[j]) end)
 from (select c, n, k, m, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) as prow from gj where k < n)),
iv as materialized (select c, list_transform(m, lambda r: r[19:]) as inv from gj where k = 18),
w as (select list_transform(inv, lambda r: list_dot_product(r, bb)) as w from iv, (select list(b order by i) as bb from kb) where c = 1)
select id, round(m + list_dot_product(k, w), 4) + 0.0 as mu, round(sqrt(greatest(1 - list_dot_product(k, list_transform(z.inv, lambda r: list_dot_product(r, k)))
 + 0.015 * list_dot_product(k, list_transform(a.inv, lambda r: list_dot_product(r, k))), 0)), 4) + 0.0 as sigma
from kn, w, (select m from pm where t = 0), (select inv from iv where c = 1) a, (select inv from iv where c = 2) z where t = 0""")
def gp_landmarks(spark, sf):
    """Three tasks of the whole table on tagged landmarks, and every row scored."""
    mf = measurements(spark, sf)
    marks = L.sampled_landmarks(ranked_sample(mf, "id", sum(LANDMARKS.values()), [1]),
                                {t: (v, l, rho) for t, v, l, rho in PARAMS}, LANDMARKS)
    fitted = L.fit(mf.select("x", *TASKS), TASKS, marks)
    return _rounded(L.score(mf.select("id", "x"), fitted), 4)


@query("searched_grid")
def searched_grid(spark, sf):
    """From the search to the curves: searches on reserved rows, medians of the accepted ones, a grid over all other rows with these parameters."""
    mf = measurements(spark, sf)
    reserved = cut_lineage(ranked_sample(mf, "id", SEARCH_ROWS, [1]).drop("seed", "rank"))
    log = cut_lineage(H.campaign(reserved, "id", "P", ["S1", "S2"], list(range(1, 21))))
    rest = mf.join(F.broadcast(reserved.select("id")), "id", "left_anti")  # SEARCH_ROWS keys
    scenarios = [single("one", "P", CURVE_CORES), Scenario("two", "multitask", "P", ("S1",), CURVE_CORES, (1.0,), (0.0, 2.0)),
                 Scenario("chain", "delta", "P", ("S1", "S2"), CURVE_CORES, (1.0,), (0.0,))]
    grid = run_grid(rest, "id", TASKS, H.parameters(log), scenarios, CURVE_SEEDS, CURVE_TARGET)
    return with_cost(grid).select("method", "datasets", "high_level", "low_level", "seed", r6("mae_error", "mae_error"),
                                  r6("spearman_error", "spearman_error"), "cost")
