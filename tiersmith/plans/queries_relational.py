"""Filters, products, look-ups and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersmith.functions.columns import HARTREE_TO_EV, case_label
from tiersmith.operators import relational as J
from tiersmith.operators.analysis import parameter_matrix
from tiersmith.operators.stats import task_medians
from tiersmith.plans.adapters import LF_SQL, MF_SQL, PRED_SQL, local_features, measurements, predictions, r6, table
from tiersmith.plans.registry import query


@query("tuple_filter", """select o_orderkey, o_orderstatus, o_orderpriority from orders
where (o_orderstatus, o_orderpriority) in (('F', '5-LOW'), ('O', '1-URGENT'))""")
def tuple_filter(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return J.tuple_filter(df, ["o_orderstatus", "o_orderpriority"], [("F", "5-LOW"), ("O", "1-URGENT")])


@query("tuple_filter_leftover", """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
 exists (select 1 from supplier join part on true where s_suppkey = l_suppkey and p_partkey = l_partkey
         and s_acctbal > 0 and p_size > 25) as matched from lineitem""".replace("join part on true", ", part"))
def tuple_filter_leftover(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rich = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    large = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    pairs = li.join(rich, "l_suppkey", "left_semi").join(large, "l_partkey", "left_semi")
    hit, rest = J.tuple_split(li, ["l_suppkey", "l_partkey"], pairs)
    return hit.withColumn("matched", F.lit(True)).unionByName(rest.withColumn("matched", F.lit(False)))


@query("range_filter", """select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem
where l_quantity >= 10 and l_quantity < 20 and l_discount >= 0.02 and l_discount < 0.05""")
def range_filter(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return J.range_filter(df, ["l_quantity", "l_discount"], [10.0, 0.02], [20.0, 0.05])


@query("prune_columns", f"with {MF_SQL} select id, P, S2 from mf")
def prune_columns(spark, sf):
    return measurements(spark, sf).select("id", "P", "S2")


@query("heavy_atoms", f"with {LF_SQL} select mol_id, atom_idx, species from lf where species <> 'H'")
def heavy_atoms(spark, sf):
    from tiersmith.operators.features import heavy_atoms as keep
    return keep(local_features(spark, sf)).select("mol_id", "atom_idx", "species")


LOG_SQL = """log as (select event_type as task, value as variance, user_id / 10.0 as lengthscale,
 (event_id % 100) / 100.0 as rho, event_id as seed, value < 200 as converged from events)"""


def _log(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("task"), F.col("value").alias("variance"),
        (F.col("user_id") / 10.0).alias("lengthscale"), ((F.col("event_id") % 100) / 100.0).alias("rho"),
        F.col("event_id").alias("seed"), (F.col("value") < 200).alias("converged"))


@query("accept_filter", f"with {LOG_SQL} select task, seed, variance from log where converged and variance < 100")
def accept_filter(spark, sf):
    return J.accepted(_log(spark, sf), 100.0).select("task", "seed", "variance")


@query("median_by_task", f"""with {LOG_SQL} select task, round(median(variance), 6) as variance,
 round(median(lengthscale::double), 6) as lengthscale, round(median(rho::double), 6) as rho from log group by task""")
def median_by_task(spark, sf):
    med = task_medians(_log(spark, sf))
    return med.select("task", r6("variance", "variance"), r6("lengthscale", "lengthscale"), r6("rho", "rho"))


@query("list_ops", """select o_orderkey, array_to_string(list_filter(w, lambda v: v <> o_orderstatus), '|') as without,
 array_to_string([w[3], w[1]], '|') as picked, array_to_string(list_reverse(w), '|') as reversed,
 array_to_string(list_concat(w, [o_orderstatus]), '|') as longer
from (select o_orderkey, o_orderstatus, [o_orderpriority, o_orderstatus, cast(o_custkey as varchar)] as w from orders)""")
def list_ops(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.array("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("w"))
    take = F.transform(F.array(F.lit(3), F.lit(1)), lambda i: F.element_at("w", i))
    return df.select("o_orderkey", F.array_join(F.array_remove("w", F.col("o_orderstatus")), "|").alias("without"),
                     F.array_join(take, "|").alias("picked"), F.array_join(F.reverse("w"), "|").alias("reversed"),
                     F.array_join(F.concat("w", F.array("o_orderstatus")), "|").alias("longer"))


@query("diff_columns", f"""with {MF_SQL} select id, {', '.join(f'{a} - {b} as {a}_{b}'
 for a in ('P', 'S1', 'S2') for b in ('P', 'S1', 'S2') if a != b)} from mf""")
def diff_columns(spark, sf):
    tasks = ["P", "S1", "S2"]
    df = J.difference_columns(measurements(spark, sf), tasks)
    return df.select("id", *[f"{a}_{b}" for a in tasks for b in tasks if a != b])


@query("scaled_residual", f"""with {MF_SQL}, r as (select corr(P, S1) as rho from mf)
select id, round(S1 - rho * P, 6) + 0.0 as residual from mf, r""")
def scaled_residual(spark, sf):
    return J.scaled_residual(measurements(spark, sf), "P", "S1").select("id", r6("residual", "residual"))


@query("unit_conversion", """select o_orderkey, round(o_totalprice * 27.2114079527::double, 4) as ev from orders""")
def unit_conversion(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * HARTREE_TO_EV, 4).alias("ev"))


@query("back_transform", f"""with {PRED_SQL} select key, round(2 * (truth + mu), 6) as mu_total,
 round(2 * (truth + truth), 6) as truth_total from pred""")
def back_transform(spark, sf):
    df = predictions(spark, sf).withColumn("factor", F.lit(2.0)).withColumn("baseline", F.col("truth"))
    return J.back_transform(df).select("key", r6("mu_total", "mu_total"), r6("truth_total", "truth_total"))


@query("case_label", """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
 concat(case when l_discount > 0 then 'C' else '' end, case when l_tax > 0 then 'A' else '' end, 'T') as label from lineitem""")
def label(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.concat(case_label(F.col("l_discount"), F.col("l_tax")), F.lit("T")).alias("label"))


@query("map_parts", """select o_orderkey, concat_ws(',', 'status', 'priority') as names,
 concat_ws(',', o_orderstatus, o_orderpriority) as vals, o_orderstatus as status, o_orderpriority as priority from orders""")
def map_parts(spark, sf):
    m = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    df = table(spark, sf, "orders").select("o_orderkey", m.alias("m"))
    return df.select("o_orderkey", F.array_join(F.map_keys("m"), ",").alias("names"),
                     F.array_join(F.map_values("m"), ",").alias("vals"), F.col("m.status").alias("status"),
                     F.col("m.priority").alias("priority"))


COSTS = [("A-18", "A", 18), ("A-24", "A", 24), ("N-18", "N", 18), ("N-24", "N", 24), ("R-18", "R", 18), ("R-24", "R", 24)]


@query("unpivot_cost", """select l_returnflag as method, case when l_linestatus = 'O' then 18 else 24 end as suffix,
 round(avg(l_extendedprice), 4) as seconds from lineitem group by all""")
def unpivot_cost(spark, sf):
    li = table(spark, sf, "lineitem")
    wide = li.select(*[F.when((F.col("l_returnflag") == m)
                              & (F.col("l_linestatus") == ("O" if s == 18 else "F")), F.col("l_extendedprice")).alias(c)
                       for c, m, s in COSTS])
    long = J.wide_to_long_costs(wide, [c for c, _, _ in COSTS]).where(F.col("seconds").isNotNull())
    return J.mean_costs(long).select("method", "suffix", F.round("seconds", 4).alias("seconds"))


@query("pivot_grid", """with t as (select *, cast(round(l_tax * 100) as integer) as pct from lineitem)
select l_returnflag, l_linestatus, l_linenumber, round(avg(l_extendedprice) filter (where pct = 0), 4) as "0",
 round(avg(l_extendedprice) filter (where pct = 4), 4) as "4", round(avg(l_extendedprice) filter (where pct = 8), 4) as "8"
from t group by all""")
def pivot_grid(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("pct", F.round(F.col("l_tax") * 100).cast("int"))
    values = [0, 4, 8]
    m = parameter_matrix(li, ["l_returnflag", "l_linestatus", "l_linenumber"], "pct", values, "l_extendedprice")
    return m.select("l_returnflag", "l_linestatus", "l_linenumber", *[F.round(str(v), 4).alias(str(v)) for v in values])


@query("metric_range", """select l_returnflag, min(l_extendedprice) as low, max(l_extendedprice) as high
from lineitem group by l_returnflag""")
def metric_range(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("param_product", """select * from (select distinct l_returnflag as flag from lineitem),
 (select distinct o_orderpriority as priority from orders), (select distinct p_brand as brand from part)""")
def param_product(spark, sf):
    return J.parameter_product(
        flag=table(spark, sf, "lineitem").select("l_returnflag").distinct(),
        priority=table(spark, sf, "orders").select("o_orderpriority").distinct(),
        brand=table(spark, sf, "part").select("p_brand").distinct())


@query("permutations", """with t as (select distinct p_brand as b from part)
select x.b as left_item, y.b as right_item from t x, t y where x.b <> y.b""")
def permutations(spark, sf):
    return J.ordered_pairs(table(spark, sf, "part").select("p_brand"), "p_brand")


@query("combinations", """with t as (select distinct p_brand as b from part)
select x.b as left_item, y.b as right_item from t x, t y where x.b < y.b""")
def combinations(spark, sf):
    return J.combinations2(table(spark, sf, "part").select("p_brand"), "p_brand")


@query("index_difference", "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def index_difference(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return J.index_difference(table(spark, sf, "part").select("p_partkey"), used, ["p_partkey"])


@query("index_intersection", "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45)")
def index_intersection(spark, sf):
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return J.index_intersection(table(spark, sf, "part").select("p_partkey"), used, ["p_partkey"])


@query("vconcat", """select c_custkey as key, c_acctbal as bal from customer union all
 select s_suppkey, s_acctbal from supplier union all select s_suppkey, s_acctbal from supplier where s_suppkey < 0""")
def vconcat(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))
    return J.stack([c, s, s.where("key < 0")])


@query("stack_blocks", f"""with {MF_SQL} select proc, count(*) as n, round(sum(y), 3) as y, round(sum(x[1]), 3) as x1 from (
 select 'P' as proc, x, P as y from mf union all select 'S1', x, S1 from mf union all select 'S2', x, S2 from mf) group by proc""")
def stack_blocks(spark, sf):
    mf = measurements(spark, sf)
    blocks = J.stack_tagged({t: mf.select("x", F.col(t).alias("y")) for t in ("P", "S1", "S2")})
    return blocks.groupBy("proc").agg(F.count("*").alias("n"), F.round(F.sum("y"), 3).alias("y"),
                                      F.round(F.sum(F.col("x")[0]), 3).alias("x1"))


PARAMS_SQL = """params as (select p_brand as task, avg(p_retailprice) as variance, avg(p_size) as lengthscale,
 corr(p_retailprice, p_size) as rho from part group by p_brand)"""


def _params(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("task")).agg(
        F.avg("p_retailprice").alias("variance"), F.avg("p_size").alias("lengthscale"),
        F.corr("p_retailprice", "p_size").alias("rho"))


@query("param_lookup", f"""with {PARAMS_SQL} select l_orderkey, l_linenumber as ord, l_partkey, l_suppkey, task,
 round(variance, 6) as variance, round(lengthscale, 6) as lengthscale, round(rho, 6) + 0.0 as rho
from lineitem join part on l_partkey = p_partkey join params on p_brand = task""")
def param_lookup(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("task"))
    wanted = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey").join(brands, "l_partkey")
    hit = J.lookup_parameters(wanted, _params(spark, sf))
    return hit.select("l_orderkey", "ord", "l_partkey", "l_suppkey", "task", r6("variance", "variance"),
                      r6("lengthscale", "lengthscale"), r6("rho", "rho"))


@query("param_bundle", f"""with {PARAMS_SQL}, w as (select distinct l_suppkey, p_brand as task from lineitem join part on l_partkey = p_partkey)
select l_suppkey, round(list(variance order by task)[1], 6) as v_first, round(list(lengthscale order by task)[-1], 6) as l_last,
 round(list_sum(list(rho)), 6) + 0.0 as rho_sum, count(*) as tasks from w join params using (task) group by l_suppkey""")
def param_bundle(spark, sf):
    brands = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("task"))
    wanted = table(spark, sf, "lineitem").join(brands, "l_partkey").select("l_suppkey", "task").distinct()
    b = J.parameter_bundle(wanted.withColumn("ord", F.col("task")), _params(spark, sf), ["l_suppkey"])
    return b.select("l_suppkey", r6(F.col("v")[0], "v_first"), r6(F.element_at("l", -1), "l_last"),
                    r6(F.aggregate("rho", F.lit(0.0), lambda a, v: a + v), "rho_sum"),
                    F.size("rho").cast("bigint").alias("tasks"))
