"""Samples, splits and training-set grids over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersmith.operators import grid as E, sampling as X
from tiersmith.operators.methods import Scenario, cell_identifiers, scenario_cells
from tiersmith.operators.relational import difference_columns
from tiersmith.operators.rows import gather, row_index
from tiersmith.plans.adapters import MF_SQL, low_level_sql, measurements, r6, table
from tiersmith.plans.registry import query
from tiersmith.session import cut_lineage

ORDER = "md5(concat(id, '-', '{seed}')), id"


@query("sample_exact", f"""with {MF_SQL}, s as (select unnest([1, 2, 3]) as seed),
r as (select id, cast(seed as integer) as seed, row_number() over (partition by seed order by md5(concat(id, '-', seed)), id) as rank from mf, s)
select * from r where rank <= 500""")
def sample_exact(spark, sf):
    return X.ranked_sample(measurements(spark, sf).select("id"), "id", 500, [1, 2, 3]).select("id", "seed", "rank")


@query("shuffle", "select o_orderkey, row_number() over (order by md5(concat(o_orderkey, '-7')), o_orderkey) as row_idx from orders")
def shuffle(spark, sf):
    return X.shuffled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


@query("tca_split", f"""with {MF_SQL}, r as (select id, row_number() over (order by {ORDER.format(seed=5)}) as rank from mf)
select id, 5 as seed, case when rank <= 320 then 'T' when rank <= 400 then 'C' else 'A' end as part,
 rank - case when rank <= 320 then 0 when rank <= 400 then 320 else 400 end as pos from r where rank <= 880""")
def tca_split(spark, sf):
    return X.nested_split(measurements(spark, sf).select("id"), "id", 320, 80, 480, [5]).select("id", "seed", "part", "pos")


@query("holdout_split", f"""with {MF_SQL}, r as (select id, row_number() over (order by {ORDER.format(seed=2)}) as rank, count(*) over () as n from mf)
select id, rank, case when rank <= 2 * (n // 3) then 'train' else 'test' end as part from r""")
def holdout_split(spark, sf):
    return X.holdout_split(measurements(spark, sf).select("id"), "id", 2).select("id", "rank", "part")


@query("sample_excluding", f"""with {MF_SQL}, rest as (select id from mf where P <= 3),
r as (select id, row_number() over (order by {ORDER.format(seed=4)}) as rank from rest) select id, rank from r where rank <= 400""")
def sample_excluding(spark, sf):
    mf = measurements(spark, sf).select("id", "P")
    return X.sample_excluding(mf, "id", mf.where("P > 3"), 400, [4]).select("id", "rank")


@query("augmented_draw", """with i as (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) as row_idx, count(*) over () as n from orders),
near as (select o_orderkey, 'matched' as stratum, row_number() over (order by md5(concat(o_orderkey, '-3')), o_orderkey) as rank
 from i where row_idx <= n // 2 and not o_totalprice > 200000),
far as (select o_orderkey, 'extra' as stratum, row_number() over (order by md5(concat(o_orderkey, '-3')), o_orderkey) as rank from i where row_idx > n // 2)
select o_orderkey, stratum, rank from near where rank <= 200 union all select o_orderkey, stratum, rank + 200 from far where rank <= 150""")
def augmented_draw(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    n = orders.count()
    idx = row_index(orders, ["o_orderkey"], n=n)
    reserved = orders.where("o_totalprice > 200000")
    return X.augmented_draw(idx, "o_orderkey", reserved, n // 2, 200, 350, 3).select("o_orderkey", "stratum", "rank")


@query("sample_with_replacement", """with i as (select o_orderkey, row_number() over (order by o_orderkey) as row_idx, count(*) over () as n from orders),
d as (select ord, cast(concat('0x', substr(md5(concat(ord, '-11')), 1, 12)) as bigint) % (select max(n) from i) + 1 as row_idx
 from (select unnest(range(1, (select max(n) from i) + 1)) as ord))
select ord, row_idx, o_orderkey from d join i using (row_idx)""")
def sample_with_replacement(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    n = orders.count()
    return X.draw_with_replacement(row_index(orders, ["o_orderkey"], n=n), n, n, 11).select("ord", "row_idx", "o_orderkey")


@query("xy_with_differences", f"""with {MF_SQL}, i as (select *, row_number() over (order by id) as row_idx, count(*) over () as n from mf),
w as (select o_orderkey as ord, (o_orderkey * 7919) % (select max(n) from i) + 1 as row_idx from orders)
select ord, row_idx, id, round(P - S1, 6) + 0.0 as P_S1, round(S2 - P, 6) + 0.0 as S2_P, round(x[1], 6) as x1 from w join i using (row_idx)""")
def xy_with_differences(spark, sf):
    mf = measurements(spark, sf)
    n = mf.count()
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord"),
                                               (F.col("o_orderkey") * 7919 % n + 1).alias("row_idx"))
    got = difference_columns(gather(row_index(mf, ["id"], n=n), wanted), ["P", "S1", "S2"])
    return got.select("ord", "row_idx", "id", r6("P_S1", "P_S1"), r6("S2_P", "S2_P"), r6(F.col("x")[0], "x1"))


CASES_SQL = """cases as (select core, n_secondary, c_ratio, a_ratio, shared from
 (select distinct 5 * l_linenumber as core, cast(l_quantity as integer) % 3 as n_secondary from lineitem),
 (select unnest([0.0::double, 1.0]) as c_ratio), (select unnest([0.0::double, 0.5, 2.0]) as a_ratio),
 (select unnest([0.5::double, 1.0]) as s), lateral (select case when n_secondary > 1 then s else 1.0::double end as shared)
 where (c_ratio <> 0 or a_ratio <> 0) and (n_secondary > 1 or s = 1.0))"""


@query("case_grid", f"with {CASES_SQL} select * from cases")
def case_grid(spark, sf):
    base = table(spark, sf, "lineitem").select(
        (5 * F.col("l_linenumber")).alias("core"), (F.col("l_quantity").cast("int") % 3).alias("n_secondary")).distinct()
    return E.expand_cases(base, [0.0, 1.0], [0.0, 0.5, 2.0], [0.5, 1.0])


@query("split_indices", """with b as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_quantity * (1 + l_tax * 10) / 2 as n,
 l_linenumber as k, l_discount * 10 as shared, unnest(range(1, l_linenumber + 1)) as i from lineitem),
c as (select *, cast(ceil(shared * n) as bigint) as common, cast(floor(n) as bigint) as whole from b),
u as (select *, cast(round_even((n - common) / k, 0) as bigint) as unit from c),
v as (select *, common + 1 + (i - 1) * unit as lo, case when i < k then least(common + i * unit, whole) else whole end as hi from u)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, cast(i as integer) as task_no, common as common_hi,
 case when shared < 1 and hi >= lo then lo end as uniq_lo, case when shared < 1 and hi >= lo then hi end as uniq_hi from v""")
def split_indices(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                             "l_tax", "l_discount")
    b = li.withColumn("task_no", F.explode(F.sequence(F.lit(1), F.col("l_linenumber"))))
    iv = E.split_interval(F.col("l_quantity") * (1 + F.col("l_tax") * 10) / 2, F.col("l_linenumber"), F.col("task_no"),
                          F.col("l_discount") * 10)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "task_no",
                    *[c.alias(n) for n, c in iv.items()])


GRID = [Scenario("one", "multitask", "P", ("S1",), (5, 10), (0.0, 1.0), (0.0, 0.5, 2.0)),
        Scenario("two", "multitask_with_target", "P", ("S1", "S2"), (5, 10), (0.0, 1.0), (0.0, 0.5, 2.0), (0.5, 1.0)),
        Scenario("chain", "delta", "P", ("S1", "S2"), (10,), (1.0,), (0.0, 1.0))]

MEMBERS_SQL = f"""{MF_SQL}, seeds as (select unnest([1, 2]) as seed),
ranked as (select id, seed, row_number() over (partition by seed order by md5(concat(id, '-', seed)), id) as rank from mf, seeds),
pool as (select id, cast(seed as integer) as seed, case when rank <= 30 then 'T' when rank <= 40 then 'C' else 'A' end as part,
 rank - case when rank <= 30 then 0 when rank <= 40 then 30 else 40 end as pos from ranked where rank <= 60),
scen as (select * from (values ('one', 1, [5, 10], [0.0::double, 1.0], [0.0::double, 0.5, 2.0], [1.0::double]),
 ('two', 2, [5, 10], [0.0::double, 1.0], [0.0::double, 0.5, 2.0], [0.5::double, 1.0]),
 ('chain', 2, [10], [1.0::double], [0.0::double, 1.0], [1.0::double])) t(scenario, k, cores, cs, ras, ss)),
cells as (select scenario, cast(seed as integer) as seed, core, c_ratio, a_ratio, shared, k from scen, seeds,
 unnest(cores) as u1(core), unnest(cs) as u2(c_ratio), unnest(ras) as u3(a_ratio), unnest(ss) as u4(shared)
 where c_ratio <> 0 or a_ratio <> 0),
tasks as (select *, unnest(range(1, k + 1)) as i from cells),
sizes as (select t.*, p as part, case p when 'C' then c_ratio * core else a_ratio * core end as n from tasks t, (values ('C'), ('A')) q(p)),
iv as (select *, cast(ceil(shared * n) as bigint) as common, cast(floor(n) as bigint) as whole from sizes where n > 0),
iv2 as (select *, cast(round_even((n - common) / k, 0) as bigint) as unit from iv),
sec as (select scenario, seed, core, c_ratio, a_ratio, shared, cast(i as integer) as task_no, part,
 list_concat(range(1, common + 1), case when shared < 1 then range(common + 1 + (i - 1) * unit,
  (case when i < k then least(common + i * unit, whole) else whole end) + 1) else []::bigint[] end) as ps from iv2),
pos as (select scenario, seed, core, c_ratio, a_ratio, shared, 0 as task_no, 'C' as part, unnest(range(1, core + 1)) as pos from cells
 union all select scenario, seed, core, c_ratio, a_ratio, shared, task_no, part, unnest(ps) from sec),
members as (select pos.*, id from pos join pool using (seed, part, pos))"""


def _members(spark, sf):
    mf = measurements(spark, sf).select("id")
    pool = cut_lineage(X.nested_split(mf, "id", 30, 10, 20, [1, 2]))
    cells = scenario_cells(pool.select("seed").distinct(), GRID).drop("kind", "tasks")
    return E.membership(cells, pool, ["id"])


@query("cell_membership", f"""with {MEMBERS_SQL}
select scenario, seed, cast(core as integer) as core, c_ratio, a_ratio, shared, task_no, part, pos, id from members""")
def cell_membership(spark, sf):
    return _members(spark, sf).select(*E.CELL, "task_no", "part", "pos", "id")


@query("cell_identifier", f"""with {MEMBERS_SQL},
cnt as (select scenario, seed, core, c_ratio, a_ratio, shared, count(*) filter (where task_no = 0) as p, count(*) filter (where task_no > 0) as s
 from members where scenario <> 'chain' group by all),
lev as (select u.scenario, u.seed, u.core, u.c_ratio, u.a_ratio, u.shared, count(*) filter (where u.task_no = 0) as p, count(*) as s
 from members u join members l on u.scenario = 'chain' and l.scenario = 'chain' and u.seed = l.seed and u.core = l.core
 and u.c_ratio = l.c_ratio and u.a_ratio = l.a_ratio and u.shared = l.shared and u.id = l.id and l.task_no = u.task_no + 1 group by all)
select scenario, seed, cast(core as integer) as core, c_ratio, a_ratio, shared, case scenario when 'one' then 2 else 3 end as levels,
 case scenario when 'one' then 'S1' else 'S2' end as lowest, p as high_level, s + case scenario when 'one' then 0 else 1 end as low_level,
 case scenario when 'chain' then 'Delta' else 'Multitask' end as method,
 concat(case when c_ratio > 0 then 'C' else '' end, case when a_ratio > 0 then 'A' else '' end, case scenario when 'one' then '' else 'T' end) as datasets,
 shared as task_fractions from (select * from cnt union all select * from lev)""")
def cell_identifier(spark, sf):
    return cell_identifiers(_members(spark, sf), "id", GRID)


@query("scenarios", f"""with {MEMBERS_SQL.replace("unnest([1, 2]) as seed", "distinct l_linenumber as seed from lineitem")} select scenario, seed, cast(core as integer) as core, c_ratio, a_ratio, shared, k as n_secondary from cells""")
def scenarios(spark, sf):
    seeds = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("seed")).distinct()
    return scenario_cells(seeds, GRID).drop("kind", "tasks")


LABEL = "['C', 'A', 'CA', 'CT', 'AT', 'CAT'][l_partkey % 6 + 1]"


@query("low_level_size", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
 {low_level_sql('l_quantity', LABEL, 'l_linenumber', '(l_discount * 10)', '(1 + l_tax * 50)')} as low_level from lineitem""")
def low_level_size(spark, sf):
    labels = F.array(*[F.lit(v) for v in ("C", "A", "CA", "CT", "AT", "CAT")])
    label = F.element_at(labels, (F.col("l_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        E.expected_low_level(F.col("l_quantity"), label, F.col("l_linenumber"), F.col("l_discount") * 10,
                             1 + F.col("l_tax") * 50).alias("low_level"))
