"""Readers and writers: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tiersmith import schemas
from tiersmith.operators import relational as J
from tiersmith.plans.adapters import LF_SQL, RUNS_SQL, local_features, r6, runs, table
from tiersmith.plans.registry import query
from tiersmith.session import shared_dir
from tiersmith.sources import calclog, tables, xyz


def _path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


ORDERS = "`order,key` bigint, `cust-key` bigint, status string, price double"


@query("csv_round_trip", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def csv_round_trip(spark, sf):
    """Two appends by column name to a CSV table with awkward names, then a declared-schema scan."""
    path = _path(spark, "orders-csv")
    df = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderkey").alias("order,key"), F.col("o_custkey").alias("cust-key"))
    tables.make_table(spark, path, ORDERS, "csv")
    tables.append_rows(df.where("price >= 100000"), path, ORDERS, "csv")
    tables.append_rows(df.where("not price >= 100000"), path, ORDERS, "csv")
    return tables.read_csv(spark, path, ORDERS).select(
        F.col("`order,key`").alias("o_orderkey"), F.col("`cust-key`").alias("o_custkey"),
        F.col("status").alias("o_orderstatus"), F.col("price").alias("o_totalprice"))


@query("append_by_name", """select o_custkey, cast(sum(n) as bigint) as n, round(sum(price), 2) as price from (
 select o_custkey, 1 as n, o_totalprice as price from orders union all select c_custkey, 1, null from customer) group by o_custkey""")
def append_by_name(spark, sf):
    schema = "o_custkey bigint, n bigint, price double"
    path = _path(spark, "totals")
    tables.append_rows(table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), F.lit(1).alias("n"), "o_custkey"),
                       path, schema)
    tables.append_rows(table(spark, sf, "customer").select(F.lit(1).alias("n"), F.col("c_custkey").alias("o_custkey")), path, schema)
    return spark.read.schema(schema).parquet(path).groupBy("o_custkey").agg(
        F.sum("n").alias("n"), F.round(F.sum("price"), 2).alias("price"))


@query("empty_table", "select o_orderkey, o_totalprice from orders")
def empty_table(spark, sf):
    """A table made empty first, then filled: the declared columns survive both."""
    schema = "o_orderkey bigint, o_totalprice double"
    path = _path(spark, "made")
    tables.make_table(spark, path, schema)
    if spark.read.parquet(path).dtypes != [("o_orderkey", "bigint"), ("o_totalprice", "double")]:
        raise AssertionError("an empty table lost its columns")
    tables.append_rows(table(spark, sf, "orders").select("o_totalprice", "o_orderkey"), path, schema)
    return spark.read.schema(schema).parquet(path)


def _written(spark, sf):
    """Result rows of all seeds in one partitioned table; seed 3 is then replaced."""
    path = _path(spark, "runs")
    df = runs(spark, sf).drop("ratio").withColumn("target", F.lit(320))
    tables.write_runs(df, path, schemas.RUNS)
    tables.write_runs(df.where("seed = 3").withColumn("mae_error", F.col("mae_error") + 1000), path, schemas.RUNS)
    return path


@query("replace_partition", f"""with {RUNS_SQL} select seed, method, count(*) as n,
 round(sum(mae_error + case when seed = 3 then 1000 else 0 end), 4) as total from runs group by seed, method""")
def replace_partition(spark, sf):
    back = tables.read_runs(spark, _written(spark, sf), schemas.RUNS)
    return back.groupBy("seed", "method").agg(F.count("*").alias("n"), F.round(F.sum("mae_error"), 4).alias("total"))


@query("read_pruned_seeds", f"""with {RUNS_SQL} select seed, lowest, count(*) as n, round(sum(mae_error), 4) as total
 from runs where seed in (1, 4) group by seed, lowest""")
def read_pruned_seeds(spark, sf):
    back = tables.read_runs(spark, _written(spark, sf), schemas.RUNS, seeds=[1, 4], target=320)
    return back.groupBy("seed", "lowest").agg(F.count("*").alias("n"), F.round(F.sum("mae_error"), 4).alias("total"))


def _xyz(spark, sf):
    """Every structure of the local features as a frame of multi-frame XYZ text, read back by the source."""
    atoms = [F.round(F.col("f")[i], 4) for i in range(3)]
    line = F.concat_ws(" ", "species", *[a.cast("string") for a in atoms])
    frames = local_features(spark, sf).groupBy("mol_id").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("atom_idx", line.alias("line")))), lambda s: s["line"]), "\n").alias("body"))
    text = frames.select(F.concat_ws("\n", F.col("n").cast("string"),
                                     F.concat((-F.col("mol_id") - 0.25).cast("string"), F.lit(" mol="), F.col("mol_id"),
                                              F.lit(' note="a b"')), "body").alias("value"))
    path = _path(spark, "frames")
    text.repartition(3).write.text(path)
    return xyz.read_xyz(spark, path, split_bytes=4096, suffix=".txt")


@query("xyz_scan", f"""with {LF_SQL} select mol_id, atom_idx, species as symbol, round(f[1], 4) + 0.0 as x, round(f[2], 4) + 0.0 as y,
 round(f[3], 4) + 0.0 as z from lf""")
def xyz_scan(spark, sf):
    atoms = _xyz(spark, sf).select(F.col("info.mol").cast("bigint").alias("mol_id"), F.posexplode("atoms").alias("atom_idx", "a"))
    return atoms.select("mol_id", "atom_idx", "a.symbol", *[(F.col(f"a.{c}") + F.lit(0.0)).alias(c) for c in "xyz"])


@query("info_number", f"with {LF_SQL} select mol_id, any_value(-mol_id - 0.25::double) as energy, 'a b' as note, count(*) as atoms from lf group by mol_id")
def info_number(spark, sf):
    return _xyz(spark, sf).select(F.col("info.mol").cast("bigint").alias("mol_id"), xyz.info_number().alias("energy"),
                                  F.col("info.note").alias("note"), F.size("atoms").cast("bigint").alias("atoms"))


@query("frame_numbers", f"with {LF_SQL} select 'frames' as kind, count(distinct mol_id) as frames from lf")
def frame_numbers(spark, sf):
    numbered = xyz.with_frame_numbers(_xyz(spark, sf).select("file", "offset"))
    per_file = numbered.groupBy("file").agg(F.max("frame").alias("last"), F.countDistinct("frame").alias("n"))
    return per_file.where("n = last + 1").agg(F.sum("n").alias("frames")).select(F.lit("frames").alias("kind"), "frames")


def _lines(spark, sf):
    """Log lines of every order: single points and whole-and-pairs results, and some unreadable lines."""
    o = table(spark, sf, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    name = F.element_at(F.array(*[F.lit(v) for v in ("", "PBE", "PBE0", "SCAN")]), (key % 4 + 1).cast("int"))
    def val(c):
        return F.format_string("%.4f", c)
    pairs = F.concat_ws(", ", F.concat(name, key), val(price), val(price / 4), val(price / 5), val(price / 2),
                        val(price / 7), val(price / 100), F.lit("1.5000"))
    single = F.concat_ws(", ", F.concat(name, key), val(-price), val(price / 1000))
    bad = F.concat(F.lit("*** step failed "), key)
    return o.select(F.when(key % 10 == 9, bad).when(key % 3 == 0, single).otherwise(pairs).alias("value"))


@query("log_scan", """select o_orderkey as mol_id, ['CCSDT', 'PBE', 'PBE0', 'SCAN'][o_orderkey % 4 + 1] as method,
 case when o_orderkey % 3 = 0 then 2 else 7 end as fields from orders where o_orderkey % 10 <> 9""")
def log_scan(spark, sf):
    path = _path(spark, "log")
    _lines(spark, sf).write.text(path)
    good, _ = calclog.scan_log(spark, path)
    return good.select("mol_id", "method", F.size("values").alias("fields"))


@query("log_scan_values", """select o_orderkey as mol_id, ['CCSDT', 'PBE', 'PBE0', 'SCAN'][o_orderkey % 4 + 1] as method,
 cast(printf('%.4f', case when o_orderkey % 3 = 0 then -o_totalprice else o_totalprice end) as double) as first_value,
 case when o_orderkey % 3 = 0 then null else 1.5::double end as last_value,
 case when o_orderkey % 3 = 0 then null else cast(printf('%.4f', o_totalprice / 2) as double) end as fourth_value
 from orders where o_orderkey % 10 <> 9""")
def log_scan_values(spark, sf):
    """The numbers of every readable line."""
    path = _path(spark, "log")
    _lines(spark, sf).write.text(path)
    good, _ = calclog.scan_log(spark, path)
    v = F.col("values")
    return good.select("mol_id", "method", F.get(v, F.lit(0)).alias("first_value"), F.get(v, F.lit(6)).alias("last_value"),
                       F.get(v, F.lit(3)).alias("fourth_value"))


@query("log_rejects", "select concat('*** step failed ', o_orderkey) as line from orders where o_orderkey % 10 = 9")
def log_rejects(spark, sf):
    return calclog.parse_lines(_lines(spark, sf))[1]


@query("interaction_energy", """with p as (select o_orderkey as mol_id, ['CCSDT', 'PBE', 'PBE0', 'SCAN'][o_orderkey % 4 + 1] as method, o_totalprice as p
 from orders where o_orderkey % 10 <> 9 and o_orderkey % 3 <> 0)
select mol_id, method, round(cast(printf('%.4f', p) as double) - cast(printf('%.4f', p / 4) as double) - cast(printf('%.4f', p / 5) as double) - cast(printf('%.4f', p / 2) as double), 4) as interaction,
 round(cast(printf('%.4f', p / 100) as double), 4) as seconds from p""")
def interaction_energy(spark, sf):
    good, _ = calclog.parse_lines(_lines(spark, sf))
    e = J.interaction_energy(calclog.energies(good.where(F.size("values") == 7)))
    return e.select("mol_id", "method", F.round("interaction", 4).alias("interaction"), F.round("seconds", 4).alias("seconds"))


@query("filled_params", "select p_brand as task, round(avg(p_retailprice), 6) as variance from part group by p_brand")
def filled_params(spark, sf):
    """A parameter table through CSV with an inferred schema."""
    path = _path(spark, "params")
    df = table(spark, sf, "part").groupBy(F.col("p_brand").alias("task")).agg(F.avg("p_retailprice").alias("variance"))
    tables.append_rows(df, path, schemas.PARAMS, "csv")
    return tables.read_csv(spark, path).select("task", r6(F.col("variance").cast("double"), "variance"))
