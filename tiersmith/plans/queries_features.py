"""Pooling, kernels and distances over the embeddings as local features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tiersmith.functions.columns import round_off, se_kernel
from tiersmith.operators import features as V, kernels as K
from tiersmith.operators.sampling import ranked_sample
from tiersmith.plans.adapters import LF_SQL, MF_SQL, isolated_atoms, local_features, measurements, r6
from tiersmith.plans.registry import query

SPECIES = ["C", "N", "O"]

LONG = f"""{LF_SQL}, lv as (select mol_id, atom_idx, species, generate_subscripts(f, 1) as pos, unnest(f) as v from lf)"""
POOL = f"""{LONG}, pooled as (select mol_id, pos, avg(v) as v from lv group by mol_id, pos)"""
SPEC = f"""{LONG}, ps as (select mol_id, species, pos, avg(v) as v from lv where species <> 'H' group by all),
iso as (select species, pos, avg(v) as v from lv where species <> 'H' group by all),
slots as (select mol_id, species, s.ord, pos from (select distinct mol_id from lf), (values ('C', 0), ('N', 1), ('O', 2)) s(species, ord), (select unnest(range(1, 65)) as pos))"""


def _long(df, *keys):
    """Vectors as rounded (key, pos, v) rows for comparison."""
    return df.select(*keys, F.posexplode("x").alias("p", "v")).select(*keys, (F.col("p") + 1).cast("bigint").alias("pos"), r6("v", "v"))


@query("mean_pool", f"with {POOL} select mol_id, pos, round(v, 6) + 0.0 as v from pooled")
def mean_pool(spark, sf):
    return _long(V.mean_pool(local_features(spark, sf), ["mol_id"], 64), "mol_id")


@query("concat_pool", f"with {LONG} select mol_id, (row_number() over (partition by mol_id order by atom_idx, pos)) as pos, v as value from lv")
def concat_pool(spark, sf):
    return V.concat_pool(local_features(spark, sf), 64).select("mol_id", "pos", "value")


@query("species_pool", f"""with {SPEC} select mol_id, ord * 64 + pos as pos, round(v, 6) + 0.0 as v from slots left join ps using (mol_id, species, pos)""")
def species_pool(spark, sf):
    return _long(V.species_pool(V.heavy_atoms(local_features(spark, sf)), SPECIES, dim=64), "mol_id")


@query("species_pool_fallback", f"""with {SPEC.replace('vec_id // 10', 'vec_id // 3').replace('vec_id % 10', 'vec_id % 3')}, i2 as (select species, pos, v as iv from iso)
select mol_id, ord * 64 + pos as pos, round(coalesce(v, iv), 6) + 0.0 as v from slots join (select distinct mol_id from lf where species <> 'H') using (mol_id)
 left join ps using (mol_id, species, pos) left join i2 using (species, pos)""")
def species_pool_fallback(spark, sf):
    """Three-atom structures lack species, which the isolated atoms fill in."""
    local = V.pool(local_features(spark, sf, 3), "species", V.heavy_atoms, species=SPECIES, isolated=isolated_atoms(spark, sf), dim=64)
    return _long(local, "mol_id")


@query("pair_difference_feature", f"""with {POOL}, m as (select max(mol_id) + 1 as n from lf)
select a.mol_id as mol_a, b.mol_id as mol_b, a.pos, round(a.v - b.v, 6) + 0.0 as v from pooled a, m
join pooled b on b.mol_id = (a.mol_id * 7 + 3) % n and a.pos = b.pos""".replace("from pooled a, m\njoin pooled b on", "from pooled a join m on true join pooled b on"))
def pair_difference_feature(spark, sf):
    local = local_features(spark, sf)
    pooled = V.mean_pool(local, ["mol_id"], 64)
    n = local.agg((F.max("mol_id") + 1)).scalar()
    pairs = local.select("mol_id").distinct().select(
        F.col("mol_id").alias("mol_a"), F.pmod(F.col("mol_id") * 7 + 3, n).alias("mol_b"))
    return _long(V.pair_difference(pooled, pairs), "mol_a", "mol_b")


@query("frobenius_normalise", f"""with {LONG}, q as (select mol_id, sqrt(sum(v * v)) as norm from lv group by mol_id)
select mol_id, atom_idx, pos, round(v / norm, 6) + 0.0 as v from lv join q using (mol_id)""")
def frobenius_normalise(spark, sf):
    return _long(V.frobenius_normalise(local_features(spark, sf)).withColumnRenamed("f", "x"), "mol_id", "atom_idx")


def _atoms(spark, sf):
    return local_features(spark, sf).select(
        "mol_id", "atom_idx", F.col("species").alias("symbol"),
        *[F.round(F.col("f")[i], 4).alias(c) for i, c in enumerate("xyz")])


ATOMS_SQL = f"""{LF_SQL}, atoms as (select mol_id, atom_idx, species as symbol, round(f[1], 4) + 0.0 as x, round(f[2], 4) + 0.0 as y, round(f[3], 4) + 0.0 as z from lf)"""


@query("geometry_text", f"""with {ATOMS_SQL} select mol_id, atom_idx, concat_ws(' ', symbol, cast(cast(x * 10000 as bigint) as varchar),
 cast(cast(y * 10000 as bigint) as varchar), cast(cast(z * 10000 as bigint) as varchar)) as line from atoms""")
def geometry_text(spark, sf):
    scaled = [F.round(F.col(c) * 10000).cast("bigint") for c in "xyz"]
    return _atoms(spark, sf).select("mol_id", "atom_idx", V.geometry_line(F.col("symbol"), *scaled).alias("line"))




FRAGMENTS = {"A": [0, 1, 6], "B": [2, 3, 7], "C": [4, 5, 8]}


@query("geometry_fragments", f"""with {ATOMS_SQL}, l as (select mol_id, atom_idx, concat_ws(' ', symbol, cast(cast(x * 10000 as bigint) as varchar),
 cast(cast(y * 10000 as bigint) as varchar), cast(cast(z * 10000 as bigint) as varchar)) as line from atoms),
fr(atom_idx, f, o) as (values (0,'A',1),(1,'A',2),(6,'A',3),(2,'B',1),(3,'B',2),(7,'B',3),(4,'C',1),(5,'C',2),(8,'C',3)),
b as (select mol_id, f, string_agg(line, chr(10) order by o) as block, count(*) as n from l join fr using (atom_idx) group by mol_id, f)
select mol_id, string_agg(block, chr(10) || '--' || chr(10) order by f) as geometry from b group by mol_id having sum(n) = 9""")
def geometry_fragments(spark, sf):
    """Structures as text, fragment by fragment with a line of dashes between them."""
    scaled = [F.round(F.col(c) * 10000).cast("bigint").alias(c) for c in "xyz"]
    atoms = _atoms(spark, sf).select("mol_id", "atom_idx", F.struct("symbol", *scaled).alias("a"))
    sets = atoms.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("atom_idx", "a"))).alias("s")).where(F.size("s") >= 9)
    structures = sets.select(F.lit("atoms").alias("file"), F.col("mol_id").alias("frame"), F.transform("s", lambda v: v["a"]).alias("atoms"))
    return V.geometry_text(structures, list(FRAGMENTS.values())).select(F.col("frame").alias("mol_id"), "geometry")


@query("fragment_pairs", f"""with {ATOMS_SQL}, fr(atom_idx, f) as (values (0,'A'),(1,'A'),(6,'A'),(2,'B'),(3,'B'),(7,'B'),(4,'C'),(5,'C'),(8,'C')),
pr(fragment) as (values ('AB'), ('AC'), ('BC')) select mol_id, fragment, atom_idx, symbol, x from atoms join fr using (atom_idx) join pr on contains(fragment, f)""")
def fragment_pairs(spark, sf):
    return V.fragment_expansion(_atoms(spark, sf).withColumn("x", round_off(F.col("x"), 4)), FRAGMENTS, 2) \
        .select("mol_id", "fragment", "atom_idx", "symbol", "x")


MARKS = f"""{MF_SQL}, marks as materialized (select id, x, P, row_number() over (order by md5(concat(id, '-1')), id) as rank from mf order by rank limit 40)"""


@query("kernel_row", f"""with {MARKS} select mf.id, m.rank as landmark, round(exp(-power(list_distance(mf.x, m.x), 2) / (2 * 1.5 * 1.5::double)) * 2, 6) as k
 from mf, marks m where m.rank <= 4""")
def kernel_row(spark, sf):
    """Kernel values against four landmarks: in the JVM from an array literal of a few vectors."""
    few = ranked_sample(measurements(spark, sf), "id", 4, [1]).select("rank", "x").collect()
    df = measurements(spark, sf).select("id", "x")
    values = [F.struct(F.lit(r["rank"]).cast("bigint").alias("landmark"),
                       round_off(se_kernel(F.col("x"), F.array(*[F.lit(v) for v in r["x"]]), 2.0, 1.5)).alias("k")) for r in few]
    return df.select("id", F.explode(F.array(*values)).alias("e")).select("id", "e.*")


def _marks(spark, sf, n=40):
    return ranked_sample(measurements(spark, sf), "id", n, [1])


@query("se_kernel_rows", f"""with {MARKS}
select mf.id, round(sum(exp(-power(list_distance(mf.x, m.x), 2) / 2)), 6) as k_sum,
 round(max(exp(-power(list_distance(mf.x, m.x), 2) / 2)), 6) as k_max from mf, marks m group by mf.id""")
def se_kernel_rows(spark, sf):
    k = K.kernel_columns(measurements(spark, sf).select("id", "x"), _marks(spark, sf).select("id", "x"), "id",
                         summary={"k_sum": np.sum, "k_max": np.max})
    return k.select("id", r6("k_sum", "k_sum"), r6("k_max", "k_max"))


@query("gram_blocks", f"""with {LF_SQL}, a as (select mol_id * 10 + atom_idx as id, f from lf)
select a.id, round(sum(exp(-power(list_distance(a.f, b.f), 2) / 2)) + 0.015, 6) as k_sum from a, a b group by a.id""")
def gram_blocks(spark, sf):
    rows = local_features(spark, sf).select((F.col("mol_id") * 10 + F.col("atom_idx")).alias("id"), F.col("f").alias("x"))
    return K.gram_sums(rows, "id", noise=0.015, block_rows=256).select("id", r6("k_sum", "k_sum"))


TAGGED = f"""{MARKS}, tags as (select id, x, rank, ['P','S1','S2'][rank % 3 + 1] as proc, [1.0::double, 0.9, 0.8][rank % 3 + 1] as rho,
 [2.0::double, 0.5, 0.25][rank % 3 + 1] as v, [1.0::double, 2.0, 0.5][rank % 3 + 1] as l from marks)"""


@query("multi_covariance", f"""with {TAGGED}, rows as (select id, x, ['P','S1','S2'][l_linenumber % 3 + 1] as proc, [1.0::double, 0.9, 0.8][l_linenumber % 3 + 1] as rho
 from (select *, cast(split_part(id, '-', 2) as integer) as l_linenumber from mf))
select r.id, round(sum(r.rho * t.rho * 2.0 * exp(-power(list_distance(r.x, t.x), 2) / 2)
 + case when r.proc = t.proc and r.proc <> 'P' then t.v * exp(-power(list_distance(r.x, t.x), 2) / (2 * t.l * t.l)) else 0 end), 6) as k_sum
from rows r, tags t group by r.id""")
def multi_covariance(spark, sf):
    rows = measurements(spark, sf).select("id", "x", (F.split("id", "-")[1].cast("int") % 3).alias("task_no"))
    marks = _marks(spark, sf).select("id", "x", (F.col("rank") % 3).cast("int").alias("task_no"))
    k = K.task_covariance(rows, marks, "id", [(2.0, 1.0, 1.0), (0.5, 2.0, 0.9), (0.25, 0.5, 0.8)],
                          summary={"k_sum": np.sum})
    return k.select("id", r6("k_sum", "k_sum"))


DIST = f"""{SPEC}, heavy as (select mol_id, pos, avg(v) as v from lv where species <> 'H' group by all),
xa as (select mol_id, list(v order by pos) as x from heavy group by mol_id),
xs as (select mol_id, list(coalesce(ps.v, iso.v) order by ord, slots.pos) as xs from slots
 left join ps using (mol_id, species, pos) left join iso using (species, pos) group by mol_id),
both_x as (select * from xa join xs using (mol_id)),
pairs as (select a.mol_id as i, b.mol_id as j, sqrt(greatest(2 - 2 * power(list_cosine_similarity(a.x, b.x), 2), 0)) as d_avg,
 sqrt(greatest(2 - 2 * power(list_cosine_similarity(a.xs, b.xs), 2), 0)) as d_species from both_x a join both_x b on a.mol_id < b.mol_id)"""


@query("kernel_distances", f"""with {DIST}, e as (select i as mol_id, 'd_avg' as kind, d_avg as d from pairs union all select j, 'd_avg', d_avg from pairs
 union all select i, 'd_species', d_species from pairs union all select j, 'd_species', d_species from pairs)
select mol_id, kind, count(*) as partners, round(avg(d), 6) as mean, round(min(d), 6) as smallest, round(max(d), 6) as largest from e group by mol_id, kind""")
def kernel_distances(spark, sf):
    d = K.distance_summary(local_features(spark, sf), SPECIES, isolated_atoms(spark, sf), match=False)
    return d.select("mol_id", "kind", "partners", r6("mean", "mean"), r6("smallest", "smallest"), r6("largest", "largest"))


@query("distance_correlations", f"""with {DIST} select 'd_avg' as kind_a, 'd_species' as kind_b, count(*) as pairs,
 round(corr(d_avg, d_species), 6) as correlation, round(greatest(max(d_avg), max(d_species)), 6) as largest from pairs""")
def distance_correlations(spark, sf):
    d = K.distance_correlations(local_features(spark, sf), SPECIES, isolated_atoms(spark, sf), match=False)
    return d.select("kind_a", "kind_b", "pairs", r6("correlation", "correlation"), r6("largest", "largest"))


MATCH_SQL = """with recursive lf as materialized (select vec_id // 10 as mol_id, cast(vec_id % 10 as integer) as atom_idx,
 ['H','C','N','O'][vec_id % 4 + 1] as species, embedding::double[] as f from embeddings),
hv as (select * from lf where species <> 'H'),
nm as (select mol_id, sqrt(sum(list_dot_product(f, f))) as norm from hv group by mol_id),
am as materialized (select mol_id, row_number() over (partition by mol_id order by atom_idx) as a, list_transform(f, lambda v: v / norm) as f from hv join nm using (mol_id)),
pr as (select x.mol_id as i, y.mol_id as j from nm x join nm y on x.mol_id <= y.mol_id),
cl as (select i, j, p.a as a, list(list_dot_product(p.f, q.f) order by q.a) as c from pr join am p on p.mol_id = i join am q on q.mol_id = j group by i, j, p.a),
cm as materialized (select i, j, list(c order by a) as c, list(list_transform(c, lambda v: exp(-(1 - v) / 0.5)) order by a) as k from cl group by i, j),
it as (select i, j, c, k, 0 as step, list_transform(k, lambda r: 1.0::double / len(k)) as u, [0.0::double] as v, false as done from cm
 union all select i, j, c, k, step + 1, nu, nv, list_sum(list_transform(nu, lambda x, p: abs(x - u[p]))) / list_sum(list_transform(nu, lambda x: abs(x))) < 1e-6
 from (select *, list_transform(k, lambda r: (1.0::double / len(k)) / list_dot_product(r, nv)) as nu
  from (select *, list_transform(k[1], lambda x, q: (1.0::double / len(k[1])) / list_dot_product(u, list_transform(k, lambda r: r[q]))) as nv
   from it where not done))),
sm as materialized (select i, j, list_sum(list_transform(c, lambda r, p: u[p] * list_sum(list_transform(r, lambda x, q: x * k[p][q] * v[q])))) as s from it where done),
d as (select sm.i, sm.j, sqrt(greatest(2 - 2 * power(sm.s / sqrt(a.s * b.s), 2), 0)) as d from sm join sm a on a.i = sm.i and a.j = sm.i join sm b on b.i = sm.j and b.j = sm.j where sm.i < sm.j)"""


@query("soft_match_distance", f"""{MATCH_SQL}, e as (select i as mol_id, d from d union all select j, d from d)
select mol_id, count(*) as partners, round(avg(d), 6) as mean, round(min(d), 6) as smallest, round(max(d), 6) as largest from e group by mol_id""")
def soft_match_distance(spark, sf):
    d = K.distance_summary(local_features(spark, sf), SPECIES, isolated_atoms(spark, sf))
    return d.where("kind = 'd_match'").select("mol_id", "partners", r6("mean", "mean"), r6("smallest", "smallest"),
                                              r6("largest", "largest"))
