"""Cross-run analysis of result rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersmith.operators import analysis as A
from tiersmith.plans.adapters import RUNS_SQL, low_level_sql, r6, runs, table
from tiersmith.plans.registry import query

CELL = ", ".join(A.RUN_CELL)
MEANS = f"""{RUNS_SQL}, means as (select {CELL}, avg(mae_error) as mae_error, count(*) as n_runs, count(distinct seed) as n_seeds from runs group by {CELL})"""
COST = "round(high_level * 24550.3::double + low_level * 665.0::double, 4) as cost"
EXTRA = """low_level - case when datasets like 'C%' then high_level else 0 end - case when datasets like '%T' then 1 else 0 end"""


def _means(spark, sf):
    return A.mean_over_runs(runs(spark, sf))


@query("mean_over_runs", f"with {MEANS} select {CELL}, round(mae_error, 6) as mae_error, n_runs, n_seeds from means")
def mean_over_runs(spark, sf):
    return _means(spark, sf).select(*A.RUN_CELL, r6("mae_error", "mae_error"), "n_runs", "n_seeds")


@query("std_over_runs", f"with {RUNS_SQL} select {CELL}, round(stddev_samp(mae_error), 6) as mae_error from runs group by {CELL}")
def std_over_runs(spark, sf):
    return A.std_over_runs(runs(spark, sf)).select(*A.RUN_CELL, r6("mae_error", "mae_error"))


@query("cost_model", f"""with {MEANS}, c(method, per_high, per_low) as (values ('Multitask', 24550.3::double, 665.0::double), ('Delta', 13288.3, 54.5), ('P', 24550.3, 665.0))
select {CELL}, round(high_level * per_high + low_level * per_low, 4) as cost from means join c using (method)""")
def cost_model(spark, sf):
    models = spark.createDataFrame([("Multitask", *A.COST_MODELS["water"]), ("Delta", *A.COST_MODELS["organic"]),
                                    ("P", *A.COST_MODELS["water"])], "method string, per_high double, per_low double")
    return A.with_cost_table(_means(spark, sf), models, "method").select(*A.RUN_CELL, F.round("cost", 4).alias("cost"))


def _curve_sql(parts: list[tuple[str, str]]) -> str:
    return f"with {MEANS} " + " union all ".join(
        f"select '{name}' as series, {CELL}, {COST}, round(mae_error, 6) as mae from means where {cond}" for name, cond in parts)


def _curve(df):
    return df.select("series", *A.RUN_CELL, F.round("cost", 4).alias("cost"), r6("mae", "mae"))


def _is(label, levels, lowest):
    return f"method = 'Multitask' and datasets = '{label}' and levels = {levels} and lowest = '{lowest}'"


@query("two_task_curve", _curve_sql([("CA", _is("CA", 2, "S1")), ("CAT", _is("CAT", 2, "S1")), ("reference", "method = 'P'")]))
def two_task_curve(spark, sf):
    return _curve(A.two_task_curve(_means(spark, sf), "P", "CA", "S1"))


@query("three_task_curve", _curve_sql([(f"{n} levels ({w})", _is("CAT", n, w)) for n in (3, 2) for w in ("S1", "S2")]
                                      + [("reference", "method = 'P'")]))
def three_task_curve(spark, sf):
    return _curve(A.three_task_curve(_means(spark, sf), "P", "CAT", ["S1", "S2"]))


def _band_sql(levels: int, lowest: str, share: float) -> str:
    def edge(ratio):
        return f"low_level = {low_level_sql('high_level', 'datasets', str(levels - 1), str(share) + '::double', str(ratio) + '::double')}"
    cond = f"{_is('CA', levels, lowest)} and task_fractions = {share}"
    return f"""select {levels} as levels, '{lowest}' as lowest, l.high_level, l.cost, round(l.mae_error, 6) as mae_low, round(h.mae_error, 6) as mae_high
 from (select *, {COST} from means where {cond} and {edge(1.0)}) l join (select * from means where {cond} and {edge(6.0)}) h using (high_level)"""


@query("layer_band", f"with {MEANS} {_band_sql(3, 'S2', 0.5)} union all {_band_sql(2, 'S1', 1.0)}")
def layer_band(spark, sf):
    b = A.layer_band(_means(spark, sf), "CA", [(3, "S2", 0.5), (2, "S1", 1.0)])
    return b.select("levels", "lowest", "high_level", F.round("cost", 4).alias("cost"), r6("mae_low", "mae_low"), r6("mae_high", "mae_high"))


@query("layer_curves", _curve_sql([("3 levels (S2)", _is("CA", 3, "S2") + " and task_fractions = 0.5"), ("2 levels (S1)", _is("CA", 2, "S1") + " and task_fractions = 1"),
                                   ("reference", "method = 'P'")]))
def layer_curves(spark, sf):
    return _curve(A.layer_curves(_means(spark, sf), "CA", [(3, "S2", 0.5), (2, "S1", 1.0)], "P"))


@query("core_benefit_curves", _curve_sql([("AT", _is("AT", 2, "S2")), ("CAT", _is("CAT", 2, "S2")), ("reference", "method = 'P'")]))
def core_benefit_curves(spark, sf):
    return _curve(A.core_benefit_curves(_means(spark, sf), "CAT", "S2", "P"))


SIDES = f"""sides as (select *, {EXTRA} as extra from means where method = 'Multitask' and levels = 2)"""


@query("core_benefit", f"""with {MEANS}, {SIDES} select a.task_fractions, a.high_level, a.extra, round(a.mae_error, 6) as without_core, round(b.mae_error, 6) as with_core
 from sides a join sides b using (task_fractions, high_level, extra, lowest) where a.datasets = 'AT' and b.datasets = 'CAT' and lowest = 'S2'""")
def core_benefit(spark, sf):
    b = A.core_benefit(_means(spark, sf), "CAT", "S2")
    return b.select("task_fractions", "high_level", "extra", r6("without_core", "without_core"), r6("with_core", "with_core"))


PLACES = {"C": [(1, 1)], "CT": [(1, 1)], "A": [(1, 3), (2, 4), (3, 6)], "AT": [(1, 3), (2, 4), (3, 6)],
          "CA": [(1, 3), (2, 4), (3, 6)], "CAT": [(1, 3), (2, 4), (3, 6)]}


@query("percent_improvement", f"""with {MEANS}, pl as (select datasets, levels, high_level, low_level, mae_error,
 row_number() over (partition by datasets, levels, high_level order by low_level, task_fractions) as place from means
 where method = 'Multitask' and ((levels = 2 and lowest = 'S1') or (levels = 3 and lowest = case when datasets like '%T' then 'S1' else 'S2' end)))
select a.datasets, a.high_level, a.low_level, round(100 * (a.mae_error - b.mae_error) / nullif(a.mae_error, 0), 4) + 0.0 as percent
 from pl a join pl b using (datasets, high_level) where a.levels = 2 and b.levels = 3
 and case when datasets in ('C', 'CT') then (a.place, b.place) in ((1, 1)) else (a.place, b.place) in ((1, 3), (2, 4), (3, 6)) end""")
def percent_improvement(spark, sf):
    p = A.percent_improvement(_means(spark, sf), "S1", "S2", PLACES)
    return p.select("datasets", "high_level", "low_level", (F.round("percent", 4) + F.lit(0.0)).alias("percent"))


RATIO_PAIRS = {"C": [(0.0, 0.0, 1.0), (0.0, 0.0, 0.5)], "A": [(1.0, 0.5, 1.0), (2.0, 1.0, 1.0), (6.0, 3.0, 0.5)],
               "CAT": [(1.0, 0.5, 1.0), (2.0, 1.0, 0.5), (6.0, 3.0, 1.0)]}
_PAIRS = ", ".join(f"('{k}', {a}::double, {b}::double, {c}::double)" for k, v in RATIO_PAIRS.items() for a, b, c in v)


@query("improvement_by_ratio", f"""with {MEANS}, pr(datasets, ratio_two, ratio_three, shared) as (values {_PAIRS})
select datasets, high_level, ratio_two, ratio_three, shared, a.low_level as low_two, b.low_level as low_three,
 round(100 * (a.mae_error - b.mae_error) / nullif(a.mae_error, 0), 4) + 0.0 as percent
from pr join means a using (datasets) join means b using (datasets, high_level)
where a.method = 'Multitask' and a.levels = 2 and a.lowest = 'S1' and a.task_fractions = 1 and b.method = 'Multitask' and b.levels = 3
 and b.lowest = case when datasets like '%T' then 'S1' else 'S2' end and b.task_fractions = shared
 and a.low_level = {low_level_sql('high_level', 'datasets', '1', '1.0::double', 'ratio_two')}
 and b.low_level = {low_level_sql('high_level', 'datasets', '2', 'shared', 'ratio_three')}""")
def improvement_by_ratio(spark, sf):
    p = A.improvement_by_ratio(_means(spark, sf), "S1", "S2", RATIO_PAIRS)
    return p.withColumn("percent", F.round("percent", 4) + F.lit(0.0))


REPORT = f"""{MEANS}, {SIDES}, ref as (select high_level, mae_error as ref from means where method = 'P'),
rep as (select a.task_fractions, high_level, extra, ref - a.mae_error as ref_1, ref - b.mae_error as ref_2, a.mae_error - b.mae_error as m1_2
 from sides a join sides b using (task_fractions, high_level, extra, lowest) join ref using (high_level)
 where a.datasets = 'A' and b.datasets = 'CA' and lowest = 'S1')"""


def _report(spark, sf):
    return A.difference_report(_means(spark, sf), "P", "S1", ("A", "CA"))


@query("difference_report", f"""with {REPORT} select task_fractions, high_level, extra, round(ref_1, 6) + 0.0 as ref_1, round(ref_2, 6) + 0.0 as ref_2, round(m1_2, 6) + 0.0 as m1_2 from rep""")
def difference_report(spark, sf):
    return _report(spark, sf).select("task_fractions", "high_level", "extra", *[r6(c, c) for c in ("ref_1", "ref_2", "m1_2")])


@query("difference_summary", f"with {REPORT} " + " union all ".join(
    f"select '{c}' as name, round(min({c}), 6) + 0.0 as minimum, round(median({c}), 6) + 0.0 as median, round(max({c}), 6) + 0.0 as maximum from rep"
    for c in ("ref_1", "ref_2", "m1_2")))
def difference_summary(spark, sf):
    return A.difference_summary(_report(spark, sf)).select("name", *[r6(c, c) for c in ("minimum", "median", "maximum")])


@query("method_comparison", _curve_sql([
    ("multitask", _is("CAT", 3, "S2")), ("delta 3 levels", "method = 'Delta' and levels = 3 and datasets = 'CAT' and lowest = 'S2'"),
    ("delta 2 levels", "method = 'Delta' and levels = 2 and lowest = 'S2'"),
    ("multitask of differences", "method = 'Multitask' and datasets = 'CAT' and lowest = 'S1_S2'"), ("reference", "method = 'P'")]))
def method_comparison(spark, sf):
    return _curve(A.method_comparison(_means(spark, sf), "P", "S2", "S1_S2"))


@query("curve_pairing", f"""with {MEANS}, {SIDES} select a.high_level, a.extra, round(a.mae_error - b.mae_error, 6) + 0.0 as gain
 from sides a join sides b using (task_fractions, high_level, extra, datasets) where a.lowest = 'S1' and b.lowest = 'S2' and datasets = 'A'""")
def curve_pairing(spark, sf):
    def side(low, name):
        m = A.tuple_filter(_means(spark, sf), A.FULL, [("Multitask", "A", 2, low)])
        return m.select("task_fractions", "high_level", A.additional_rows(), F.col("mae_error").alias(name))
    both = side("S1", "a").join(side("S2", "b"), ["task_fractions", "high_level", "extra"])
    return both.select("high_level", "extra", r6(F.col("a") - F.col("b"), "gain"))


@query("search_study_view", """select event_type as task, cast(user_id // 30 as integer) as n, value as mle_mae, value / 2 as mae_mae from events
 where event_type in ('click', 'view') and user_id // 30 in (1, 3)""")
def search_study_view(spark, sf):
    study = table(spark, sf, "events").select(
        F.col("event_type").alias("task"), F.expr("cast(user_id div 30 as int)").alias("n"),
        F.col("value").alias("mle_mae"), (F.col("value") / 2).alias("mae_mae"))
    return A.search_study_view(study, ["click", "view"], [1, 3])
