"""The experiment tables expressed over the standard tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tiersmith.functions.columns import round_off
from tiersmith.operators.grid import expected_low_level


# Declared schemas: no job is needed to look into the files before a query.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id bigint, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf}/{name}.parquet")


MF_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    """MF: line items as objects measured by one expensive task P and two cheap ones S1, S2."""
    li = table(spark, sf, "lineitem")
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return li.select(
        F.concat_ws("-", *[F.col(k).cast("string") for k in MF_KEY], F.col("l_quantity").cast("bigint").cast("string")).alias("id"),
        F.array(price / 30000, disc * 10, tax * 10).alias("x"),
        (price * (1 - disc) * (1 + tax) / 30000).alias("P"),
        (price * (1 - disc) / 30000).alias("S1"),
        (price * (1 + tax) / 30000).alias("S2"))


MF_SQL = """mf as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint)) as id,
 [l_extendedprice/30000, l_discount*10, l_tax*10] as x,
 l_extendedprice*(1-l_discount)*(1+l_tax)/30000 as P, l_extendedprice*(1-l_discount)/30000 as S1,
 l_extendedprice*(1+l_tax)/30000 as S2 from lineitem)"""


def local_features(spark: SparkSession, sf: str, atoms: int = 10) -> DataFrame:
    """LF: embeddings as per-atom vectors of structures of ten (or fewer) atoms."""
    v = F.col("vec_id")
    species = F.element_at(F.array(*[F.lit(s) for s in "HCNO"]), (v % 4 + 1).cast("int"))
    return table(spark, sf, "embeddings").select(
        F.expr(f"vec_id div {atoms}").alias("mol_id"), (v % atoms).cast("int").alias("atom_idx"), species.alias("species"),
        F.col("embedding").cast("array<double>").alias("f"))


LF_SQL = """lf as (select vec_id // 10 as mol_id, cast(vec_id % 10 as integer) as atom_idx,
 ['H','C','N','O'][vec_id % 4 + 1] as species, embedding::double[] as f from embeddings)"""


def isolated_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in vectors for absent species: the mean over all atoms of the species."""
    from tiersmith.operators.features import mean_pool
    return mean_pool(local_features(spark, sf), ["species"], 64)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """PRED: events predicted from the calibration half of their (type, user bucket).

    Columns grp, key, part, mu, sigma, truth.
    """
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("grp"), F.col("event_id").alias("key"), (F.col("user_id") % 8).alias("bucket"),
        F.col("value").alias("truth"),
        F.when(F.md5(F.col("event_id").cast("string")) < "8", "calibration").otherwise("target").alias("part"))
    model = ev.where(F.col("part") == "calibration").groupBy("grp", "bucket").agg(
        F.round(F.avg("truth"), 6).alias("mu"), F.round(F.stddev_samp("truth"), 6).alias("sigma"))
    return ev.join(model, ["grp", "bucket"]).select("grp", "key", "part", "mu", "sigma", "truth")


PRED_SQL = """ev as (select event_type as grp, event_id as key, user_id % 8 as bucket, value as truth,
 case when md5(cast(event_id as varchar)) < '8' then 'calibration' else 'target' end as part from events),
model as (select grp, bucket, round(avg(truth), 6) as mu, round(stddev_samp(truth), 6) as sigma
 from ev where part = 'calibration' group by grp, bucket),
pred as (select grp, key, part, mu, sigma, truth from ev join model using (grp, bucket))"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """RUNS: events as result rows of runs over many seeds."""
    def pick(values: list, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    e = F.col("event_id")
    turn = F.expr("user_id div 7")
    kind = F.col("event_type")
    one = kind == "signup"
    base = table(spark, sf, "events").select(
        (e % 6).cast("int").alias("seed"),
        F.when(one, "P").when(kind == "purchase", "Delta").otherwise("Multitask").alias("method"),
        F.when(one, 1).otherwise((2 + F.expr("event_id div 6") % 2)).cast("int").alias("levels"),
        F.when(one, "P").otherwise(pick(["S1", "S2", "S1_S2", "S2_S1"], F.expr("event_id div 12") % 4)).alias("lowest"),
        F.when(one, "P").when(kind == "purchase", pick(["CT", "CAT"], turn % 2))
         .otherwise(pick(["C", "A", "CA", "CT", "AT", "CAT"], turn % 6)).alias("datasets"),
        (F.lit(5) * F.pow(F.lit(2.0), F.col("user_id") % 7)).cast("bigint").alias("high_level"),
        pick([0.5, 1.0, 2.0, 3.0, 6.0], F.expr("event_id div 48") % 5).alias("ratio"),
        pick([0.5, 1.0], F.expr("event_id div 240") % 2).alias("half"),
        (F.col("value") / 997).alias("mae_error"))
    share = F.when(F.col("levels") == 1, 0.0).when(F.col("levels") == 2, 1.0).otherwise(F.col("half"))
    low = F.when(F.col("levels") == 1, F.lit(0).cast("bigint")).otherwise(expected_low_level(
        F.col("high_level"), F.col("datasets"), F.col("levels") - 1, F.col("task_fractions"), F.col("ratio")))
    return base.withColumn("task_fractions", share).withColumn("low_level", low).drop("half")


def low_level_sql(core: str, label: str, tasks: str, shared: str, ratio: str) -> str:
    return f"""cast((case when {label} like '%T' then 1 else 0 end)
 + (case when {label} like 'C%' then ceil({core}*{shared})*{tasks} + {core} - ceil({core}*{shared}) else 0 end)
 + (case when substr({label},1,2) like '%A%' then ceil({core}*{shared}*{ratio})*{tasks} + ceil({core}*{ratio})
    - ceil({core}*{shared}*{ratio}) else 0 end) as bigint)"""


RUNS_SQL = f"""base as (select cast(event_id % 6 as integer) as seed,
 case event_type when 'signup' then 'P' when 'purchase' then 'Delta' else 'Multitask' end as method,
 cast(case when event_type = 'signup' then 1 else 2 + (event_id // 6) % 2 end as integer) as levels,
 case when event_type = 'signup' then 'P' else ['S1','S2','S1_S2','S2_S1'][(event_id // 12) % 4 + 1] end as lowest,
 case when event_type = 'signup' then 'P' when event_type = 'purchase' then ['CT','CAT'][(user_id // 7) % 2 + 1]
  else ['C','A','CA','CT','AT','CAT'][(user_id // 7) % 6 + 1] end as datasets,
 cast(5 * power(2, user_id % 7) as bigint) as high_level,
 [0.5::double, 1.0, 2.0, 3.0, 6.0][(event_id // 48) % 5 + 1] as ratio,
 [0.5::double, 1.0][(event_id // 240) % 2 + 1] as half, value / 997 as mae_error from events),
shared as (select *, case levels when 1 then 0.0::double when 2 then 1.0::double else half end as task_fractions from base),
runs as (select *, case when levels = 1 then 0 else
 {low_level_sql('high_level', 'datasets', '(levels - 1)', 'task_fractions', 'ratio')} end as low_level from shared)"""


def r6(column, name: str):
    return round_off(column if not isinstance(column, str) else F.col(column)).alias(name)
