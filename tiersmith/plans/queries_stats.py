"""Error statistics and calibration of predicted events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tiersmith.operators import stats as G
from tiersmith.operators.analysis import error_against_sigma
from tiersmith.plans.adapters import PRED_SQL, predictions, r6
from tiersmith.plans.registry import query


@query("abs_stats", f"""with {PRED_SQL} select grp, count(*) as n, round(avg(abs(mu - truth)), 6) as mean, round(median(abs(mu - truth)), 6) as median,
 round(min(abs(mu - truth)), 6) as minimum, round(max(abs(mu - truth)), 6) as maximum from pred group by grp""")
def abs_stats(spark, sf):
    s = G.abs_stats(predictions(spark, sf).withColumn("e", F.col("mu") - F.col("truth")), ["grp"], "e", ["key"])
    return s.select("grp", "n", *[r6(c, c) for c in ("mean", "median", "minimum", "maximum")])


def _avg_rank(v: str) -> str:
    return f"rank() over (partition by grp order by {v}) + (count(*) over (partition by grp, {v}) - 1) / 2.0"


def cors_sql(source: str, x: str, y: str) -> str:
    """Correlations of two columns of a CTE per grp, as the CTE parts lin/rk/kd."""
    return f"""xy as (select grp, key, {x} as a, {y} as b from {source}),
rk as (select grp, key, a, b, {_avg_rank('a')} as ra, {_avg_rank('b')} as rb from xy),
lin as (select grp, corr(a, b) as pearson, corr(ra, rb) as spearman from rk group by grp),
kd as (select p.grp, sum(sign(p.a - q.a) * sign(p.b - q.b)) / sqrt(sum(abs(sign(p.a - q.a)))::double * sum(abs(sign(p.b - q.b)))) as kendall
 from xy p join xy q on p.grp = q.grp and p.key < q.key group by p.grp)"""


@query("correlations", f"""with {PRED_SQL}, {cors_sql('pred', 'mu', 'truth')}
select grp, round(pearson, 6) + 0.0 as pearson, round(spearman, 6) + 0.0 as spearman, round(kendall, 6) + 0.0 as kendall from lin join kd using (grp)""")
def correlations(spark, sf):
    pairs = predictions(spark, sf).withColumnsRenamed({"mu": "x", "truth": "y"})
    c = G.rank_correlations(pairs, ["grp"], "key")
    return c.select("grp", *[r6(n, n) for n in ("pearson", "spearman", "kendall")])


@query("spearman", f"""with {PRED_SQL}, rk as (select grp, {_avg_rank('sigma')} as ra, {_avg_rank('truth')} as rb from pred)
select grp, round(corr(ra, rb), 6) + 0.0 as spearman from rk group by grp""")
def spearman(spark, sf):
    pairs = predictions(spark, sf).withColumnsRenamed({"sigma": "x", "truth": "y"})
    return G.rank_correlations(pairs, ["grp"], "key").select("grp", r6("spearman", "spearman"))


@query("kendall", f"""with {PRED_SQL}, p as (select 1 as one, key, sigma as a, truth as b from pred)
select round(sum(sign(p.a - q.a) * sign(p.b - q.b)) / sqrt(sum(abs(sign(p.a - q.a)))::double * sum(abs(sign(p.b - q.b)))), 6) + 0.0 as kendall
from p join p q on p.key < q.key""")
def kendall(spark, sf):
    pairs = predictions(spark, sf).withColumnsRenamed({"sigma": "x", "truth": "y"}).withColumn("one", F.lit(1))
    return G.rank_correlations(pairs, ["one"], "key").select(r6("kendall", "kendall"))


def _row_sql(err: str, rel: str, x: str, y: str) -> str:
    cors1, cors2 = cors_sql("q", x, y), cors_sql("q", "sigma", "abs(e)")
    for n in ("xy", "rk", "lin", "kd"):
        cors2 = cors2.replace(f"{n} as (", f"{n}2 as (").replace(f"from {n} ", f"from {n}2 ").replace(f"join {n} ", f"join {n}2 ") \
                     .replace(f"from {n})", f"from {n}2)")
    stats = ", ".join(f"round({f}(abs({v})), 6) as {p}_{m}" for m, v in (("error", "e"), ("relative", "r"), ("std", "sigma"))
                      for f, p in (("avg", "mae"), ("median", "median_ae"), ("min", "minimum_ae"), ("max", "maximum_ae")))
    return f"""q as (select *, {err} as e, {rel} as r from pred), {cors1}, {cors2}, st as (select grp, {stats} from q group by grp)
select st.*, {', '.join(f'round(a.{c}, 6) + 0.0 as {c}_error, round(b.{c}, 6) + 0.0 as {c}_std' for c in ('pearson', 'spearman', 'kendall'))}
from st join (select * from lin join kd using (grp)) a using (grp) join (select * from lin2 join kd2 using (grp)) b using (grp)"""


def _rounded(df):
    return df.select("grp", *[r6(c, c) for c in df.columns if c != "grp"])


@query("result_row", f"with {PRED_SQL}, {_row_sql('mu - truth', '(mu - truth) / nullif(truth, 0)', 'mu', 'truth')}")
def result_row(spark, sf):
    return _rounded(G.result_rows(predictions(spark, sf).drop("part"), ["grp"], "key"))


@query("result_row_delta", f"""with {PRED_SQL}, {_row_sql('mu - truth', '(mu - truth) / nullif(2 * (key % 10 + truth), 0)',
 '2 * (key % 10 + mu)', '2 * (key % 10 + truth)')}""")
def result_row_delta(spark, sf):
    from tiersmith.operators.relational import back_transform
    df = predictions(spark, sf).drop("part").withColumn("baseline", F.col("key") % 10).withColumn("factor", F.lit(2))
    return _rounded(G.result_rows(back_transform(df), ["grp"], "key"))


SCALE_SQL = f"""{PRED_SQL}, sc as (select grp, abs(mu - truth) / sigma as score, row_number() over (partition by grp order by abs(mu - truth) / sigma, key) as i,
 count(*) over (partition by grp) as n from pred where part = 'calibration'),
q as (select grp, n, score as scale from sc where i = ceil((n + 1) * (1 - 0.05::double))),
scaled as (select pred.grp, key, mu, sigma, truth, scale * sigma as conformal from pred join q using (grp) where part = 'target')"""


def _scaled(spark, sf):
    pred = predictions(spark, sf)
    scales = G.conformal_scales(pred.where("part = 'calibration'"), ["grp"], "key")
    return G.apply_scales(pred.where("part = 'target'"), scales, ["grp"])


@query("conformal_scale", f"with {SCALE_SQL} select grp, n, round(scale, 6) as scale from q")
def conformal_scale(spark, sf):
    s = G.conformal_scales(predictions(spark, sf).where("part = 'calibration'"), ["grp"], "key")
    return s.select("grp", "n", r6("scale", "scale"))


@query("coverage", f"""with {SCALE_SQL} select grp, round(avg(cast(truth > mu - sigma and truth < mu + sigma as double)), 6) as before,
 round(avg(cast(truth > mu - conformal and truth < mu + conformal as double)), 6) as after from scaled group by grp""")
def coverage(spark, sf):
    return G.coverage(_scaled(spark, sf), ["grp"]).select("grp", r6("before", "before"), r6("after", "after"))


@query("error_vs_sigma", f"with {SCALE_SQL} select key, round(abs(truth - mu), 6) as abs_error, sigma, round(conformal, 6) as conformal from scaled")
def error_vs_sigma(spark, sf):
    return error_against_sigma(_scaled(spark, sf)).select("key", r6("abs_error", "abs_error"), "sigma", r6("conformal", "conformal"))


@query("first_intervals", f"""with {SCALE_SQL}, n as (select *, row_number() over (partition by grp order by key) as place from scaled)
select grp, place, key, truth, mu - sigma as low, mu + sigma as high, round(mu - conformal, 6) as conformal_low,
 round(mu + conformal, 6) as conformal_high from n where place <= 20""")
def first_intervals(spark, sf):
    place = F.row_number().over(Window.partitionBy("grp").orderBy("key")).cast("bigint")  # kept to 20 before the shuffle
    ranked = _scaled(spark, sf).withColumn("place", place).where("place <= 20")
    mu, s, c = F.col("mu"), F.col("sigma"), F.col("conformal")
    return ranked.select("grp", "place", "key", "truth", (mu - s).alias("low"), (mu + s).alias("high"),
                         r6(mu - c, "conformal_low"), r6(mu + c, "conformal_high"))
