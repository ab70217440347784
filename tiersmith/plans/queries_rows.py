"""Row positions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tiersmith.operators import rows as R
from tiersmith.operators.relational import side_by_side
from tiersmith.plans.adapters import MF_KEY, table
from tiersmith.plans.registry import query

IDX = "oi as (select *, row_number() over (order by o_orderkey) as row_idx, count(*) over () as n from orders)"


def _orders(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    n = df.count()
    return R.row_index(df, ["o_orderkey"], n=n), n


@query("row_index", f"""select {', '.join(MF_KEY)}, l_quantity,
 row_number() over (order by {', '.join(MF_KEY)}, l_quantity) as row_idx from lineitem""")
def row_index(spark, sf):
    keys = [*MF_KEY, "l_quantity"]
    return R.row_index(table(spark, sf, "lineitem").select(*keys), keys)


@query("gather_rows", """with ci as (select *, row_number() over (order by c_custkey) as row_idx, count(*) over () as n from customer)
select o_orderkey as ord, c.row_idx, c_custkey, c_acctbal from orders o
join ci c on c.row_idx = (o_orderkey * 7919) % c.n + 1""")
def gather_rows(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    n = cust.count()
    wanted = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") * 7919 % n + 1).alias("row_idx"))
    return R.gather(R.row_index(cust, ["c_custkey"], n=n), wanted)


@query("row_range", f"with {IDX} select row_idx, o_orderkey from oi where row_idx between 3 and n - 5")
def row_range(spark, sf):
    df, n = _orders(spark, sf)
    return R.row_range(df, 3, n - 5).select("row_idx", "o_orderkey")


@query("filter_inds", f"with {IDX} select row_idx from oi where o_orderstatus = 'F'")
def filter_inds(spark, sf):
    return R.filter_positions(_orders(spark, sf)[0], "o_orderstatus", "F")


@query("part", f"""with {IDX}, s as (select *, least((row_idx - 1) // (n // 7) + 1, 7) as sec from oi)
select row_idx, o_orderkey, row_idx - (sec - 1) * (n // 7) + case sec when 3 then 0 when 2 then n // 7 else 2 * (n // 7) end as ord
from s where sec in (2, 3, 7)""")
def part(spark, sf):
    df, n = _orders(spark, sf)
    return R.sections(df, n, 7, [3, 2, 7]).select("row_idx", "o_orderkey", "ord")


@query("first_part", f"with {IDX} select row_idx, o_orderkey from oi where row_idx <= n // 3")
def first_part(spark, sf):
    df, n = _orders(spark, sf)
    return R.first_part(df, n, 3).select("row_idx", "o_orderkey")


@query("last_part", f"with {IDX} select row_idx, o_orderkey from oi where row_idx > n // 3")
def last_part(spark, sf):
    df, n = _orders(spark, sf)
    return R.rest_part(df, n, 3).select("row_idx", "o_orderkey")


SWAP = """c as (select c_custkey as key, row_number() over (order by c_custkey) as row_idx, count(*) over () as n from customer),
s as (select p_partkey as key, row_number() over (order by p_partkey) as row_idx, count(*) over () as n from part),
k as (select (select max(n) from c) as nc, (select max(n) from s) as ns),
sw as (select c.row_idx, c.key from c, k where c.row_idx <= least(nc, ns - ns // 4)
 union all select s.row_idx + least(nc, ns - ns // 4), s.key from s, k
 where s.row_idx <= case when ns - ns // 4 > nc then ns - nc else ns // 4 end)"""


def _two(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    s = table(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    nc, ns = c.count(), s.count()
    return R.row_index(c, ["key"], n=nc), nc, R.row_index(s, ["key"], n=ns), ns


@query("swap_rows", f"with {SWAP} select row_idx, key from sw")
def swap_rows(spark, sf):
    c, nc, s, ns = _two(spark, sf)
    return R.exchange(c, nc, s, ns, 4).select("row_idx", "key")


@query("pop_row", f"with {IDX} select row_idx, case when row_idx = n then -1 else o_orderkey end as o_orderkey from oi")
def pop_row(spark, sf):
    df, n = _orders(spark, sf)
    return R.replace_last(df, n, "o_orderkey", -1).select("row_idx", "o_orderkey")


@query("popswap", f"with {SWAP} select row_idx, case when row_idx = (select max(row_idx) from sw) then -1 else key end as key from sw")
def popswap(spark, sf):
    c, nc, s, ns = _two(spark, sf)
    return R.exchange_replace_last(c, nc, s, ns, "key", -1, 4).select("row_idx", "key")


@query("positional_attach", f"""with {IDX}, ci as (select c_acctbal, row_number() over (order by c_custkey) as row_idx from customer)
select row_idx, o_orderkey, c_acctbal from oi join ci using (row_idx)""")
def positional_attach(spark, sf):
    cust = R.row_index(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"])
    return R.attach_by_position(_orders(spark, sf)[0], cust, ["c_acctbal"]).select("row_idx", "o_orderkey", "c_acctbal")


@query("shard", f"with {IDX} select row_idx, o_orderkey from oi where (row_idx - 1) % 6 = 2")
def shard(spark, sf):
    return R.shard(_orders(spark, sf)[0], 2, 6).select("row_idx", "o_orderkey")


@query("hconcat", f"""with {IDX}, b as (select o_custkey, row_number() over (order by o_totalprice, o_orderkey) as row_idx from orders)
select row_idx, o_orderkey, b.o_custkey as b_custkey from oi join b using (row_idx)""")
def hconcat(spark, sf):
    orders = table(spark, sf, "orders")
    left = R.row_index(orders.select("o_orderkey"), ["o_orderkey"])
    right = R.row_index(orders.select("o_totalprice", "o_orderkey", "o_custkey"), ["o_totalprice", "o_orderkey"])
    return side_by_side(left, right.select("row_idx", F.col("o_custkey").alias("b_custkey")))


@query("ranks", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
 row_number() over (partition by l_returnflag order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) as place
 from lineitem""")
def ranks(spark, sf):
    keys = [*MF_KEY, "l_quantity"]
    li = table(spark, sf, "lineitem").select(*keys, "l_returnflag", "l_extendedprice")
    return R.row_index(li, ["l_extendedprice", *keys], group=["l_returnflag"], out="place").drop("l_extendedprice")


@query("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 100")
def top_k(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice") \
        .orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
