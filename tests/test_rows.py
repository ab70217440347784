import pytest
from pyspark.sql import functions as F

from tiersmith.operators import rows as R
from tiersmith.operators.relational import side_by_side


def items(spark, values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "row_idx bigint, v int")


def listed(df, by="row_idx"):
    return [r["v"] for r in df.orderBy(by).collect()]


@pytest.mark.parametrize("per_bucket", [10_000, 60, 3])
def test_index_is_dense_per_group_with_a_hot_key(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", per_bucket)
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") * 37 % 11).alias("k"), "id").repartition(7)
    got = R.row_index(df, ["k", "id"], group=["g"], total="n").collect()
    by_group = {}
    for r in got:
        by_group.setdefault(r["g"], []).append(r)
    assert len(got) == 900
    for rows in by_group.values():
        rows.sort(key=lambda r: (r["k"], r["id"]))
        assert [r["row_idx"] for r in rows] == list(range(1, len(rows) + 1))
        assert {r["n"] for r in rows} == {len(rows)}


def test_hot_key_is_split_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 50)
    df = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    sizes = df.groupBy(R._bucket(df, ["k", "id"], 1000)).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 250


def test_running_sum_of_weights(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 20)
    df = spark.range(200).select("id", (F.col("id") % 5).alias("w"))
    got = {r["id"]: r["s"] for r in R.running_sum(df, ["id"], "w", out="s").collect()}
    total = 0
    for i in range(200):
        total += i % 5
        assert got[i] == total


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, k int")
    assert sorted((r["g"] or "", r["row_idx"]) for r in R.row_index(df, ["k"], group=["g"]).collect()) == \
        [("", 1), ("", 2), ("a", 1)]


def test_sections(spark):
    df = items(spark, range(1, 19))
    assert listed(R.sections(df, 18, 6, [2, 3]), "ord") == [4, 5, 6, 7, 8, 9]
    assert listed(R.sections(df, 18, 6, [3, 1]), "ord") == [7, 8, 9, 1, 2, 3]
    twenty = items(spark, range(1, 21))
    assert listed(R.sections(twenty, 20, 3, [3]), "ord") == list(range(13, 21))
    assert listed(R.sections(twenty, 20, 3, [3, 1]), "ord") == [*range(13, 19), *range(1, 7)]
    assert listed(R.sections(twenty, 20, 3, [1, 3]), "ord") == [*range(1, 7), *range(13, 21)]
    with pytest.raises(ValueError):
        R.section_of(2, 3)


def test_first_and_rest(spark):
    df = items(spark, range(1, 19))
    assert listed(R.first_part(df, 18, 3)) == list(range(1, 7))
    assert listed(R.rest_part(df, 18, 2)) == list(range(10, 19))
    assert listed(R.rest_part(df, 18, 3)) == list(range(7, 19))


def test_exchange(spark):
    def run(c, s, split):
        return listed(R.exchange(items(spark, c), len(c), items(spark, s), len(s), split))
    assert run([1, 2, 3, 4], [11, 12, 13, 14], 2) == [1, 2, 11, 12]
    assert run(range(1, 9), range(11, 17), 3) == [1, 2, 3, 4, 11, 12]
    assert run([1, 2, 3], range(11, 17), 3) == [1, 2, 3, 11, 12, 13]


def test_replace_last(spark):
    assert listed(R.replace_last(items(spark, [5, 6, 7]), 3, "v", 12)) == [5, 6, 12]
    got = R.exchange_replace_last(items(spark, [1, 2, 3, 4]), 4, items(spark, [11, 12, 13, 14]), 4, "v", 99)
    assert listed(got) == [1, 2, 11, 99]


def test_filter_positions_is_null_safe(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "row_idx bigint, s string")
    assert [r[0] for r in R.filter_positions(df, "s", None).orderBy("row_idx").collect()] == [2, 3]


def test_side_by_side_refuses_unequal_lengths(spark):
    with pytest.raises(Exception, match="differ in length"):
        side_by_side(items(spark, [1, 2, 3]), items(spark, [1, 2]).withColumnRenamed("v", "w")).collect()
