"""Result lines printed by calculation jobs, read as a table.

A line is ``<functional><index>, e1, ..., seconds``: there is no separator
between functional and index, and lines without a functional belong to the
expensive method. Four-energy lines are ``whole, pair, pair, pair, interaction,
total seconds, last seconds``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

# Functionals whose names may end in a digit.
FUNCTIONALS = ("PBE0_DH", "PBE0", "PBE", "SCAN", "BLYP")


def parse_lines(lines: DataFrame, column: str = "value", functionals: tuple[str, ...] = FUNCTIONALS,
                bare: str = "CCSDT") -> tuple[DataFrame, DataFrame]:
    """(calculations, rejected lines). Back-tracking tells ``PBE0, `` (PBE, 0) from ``PBE033, `` (PBE0, 33)."""
    names = "|".join(re.escape(f) for f in sorted(functionals, key=len, reverse=True))
    pattern = rf"^({names})?(\d+), "
    text = F.col(column)
    parts = F.split(text, ", ")
    numbers = F.transform(F.slice(parts, 2, 64), lambda s: s.try_cast("double"))
    shaped = lines.select(
        text.alias("line"), F.regexp_extract(text, pattern, 1).alias("f"),
        F.regexp_extract(text, pattern, 2).try_cast("bigint").alias("mol_id"), numbers.alias("v"))
    ok = (F.col("mol_id").isNotNull() & F.size("v").isin(2, 7)
          & ~F.exists("v", lambda e: e.isNull()))
    method = F.when(F.col("f") == "", F.lit(bare)).otherwise(F.col("f"))
    return (shaped.where(ok).select("mol_id", method.alias("method"), F.col("v").alias("values")),
            shaped.where(~F.coalesce(ok, F.lit(False))).select("line"))


def scan_log(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    return parse_lines(spark.read.text(path), **options)


def energies(calculations: DataFrame) -> DataFrame:
    """One row per energy: the single point, or the whole ('trimer') and its pairs ('dimer')."""
    v = F.col("values")

    def entry(kind: str, fragment: str, energy, seconds):
        return F.struct(F.lit(kind).alias("kind"), F.lit(fragment).alias("fragment"), energy.alias("energy"),
                        seconds.cast("double").alias("seconds"))

    none = F.lit(0.0)
    single = F.array(entry("trimer", "", F.get(v, F.lit(0)), F.get(v, F.lit(1))))
    many = F.array(entry("trimer", "ABC", F.get(v, F.lit(0)), F.get(v, F.lit(5))),
                   *[entry("dimer", d, F.get(v, F.lit(i)), none) for i, d in enumerate(("AB", "AC", "BC"), 1)])
    rows = calculations.select("mol_id", "method",
                               F.explode(F.when(F.size("values") == 7, many).otherwise(single)).alias("e"))
    return rows.select("mol_id", "method", "e.*")
