"""CSV and Parquet tables: declared schemas, append by name, replacement of single runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tiersmith.operators.relational import join_groups

ROWS_PER_WRITER = 1_000_000


def _struct(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with a header; the schema is inferred only when none is given. Names may hold commas and dashes.

    With a declared schema the header of every file is checked against it.
    """
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(_struct(schema)).option("enforceSchema", False).csv(path)


def _shaped(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of ``schema`` by name, cast; absent nullable columns become null, unknown ones are an error."""
    unknown = set(df.columns) - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"columns not in the table: {sorted(unknown)}")
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in schema])


def make_table(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet") -> None:
    """An empty table with the given columns; an existing one is replaced."""
    spark.createDataFrame([], _struct(schema)).write.mode("overwrite").option("header", True).format(fmt).save(path)


def append_rows(df: DataFrame, path: str, schema: str | StructType, fmt: str = "parquet") -> None:
    """Append, creating the table if it is absent; columns are matched by name."""
    _shaped(df, _struct(schema)).write.mode("append").option("header", True).format(fmt).save(path)


def write_runs(df: DataFrame, path: str, schema: str | StructType, by: tuple[str, ...] = ("target", "seed")) -> None:
    """Replace only the partitions present in ``df``.

    Rows are shuffled to their partition plus a salt. The number of salts
    follows the partition's row count, so that a partition of any size is
    written by tasks of bounded size.
    """
    shaped = _shaped(df, _struct(schema))
    sizes = shaped.groupBy(*by).agg(F.ceil(F.count("*") / ROWS_PER_WRITER).alias("__salts"))
    salted = join_groups(shaped, sizes, list(by)).withColumn("__salt", F.pmod(F.xxhash64(*shaped.columns), F.col("__salts"))).drop("__salts")
    (salted.repartition(*by, "__salt").drop("__salt").write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def read_runs(spark: SparkSession, path: str, schema: str | StructType, seeds: list[int] | None = None,
              target: int | None = None) -> DataFrame:
    """All runs in one scan; a subset of seeds or one target prunes partitions."""
    df = spark.read.schema(_struct(schema)).parquet(path)
    if seeds is not None:
        df = df.where(F.col("seed").isin(seeds))
    return df if target is None else df.where(F.col("target") == target)
