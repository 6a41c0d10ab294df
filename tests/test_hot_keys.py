"""Joins with keys of most rows: the rows of Spark's own joins, spread over tasks."""

import datetime
import logging

import pytest
from pyspark.sql import functions as F

from weftline.operators import combining
from weftline.operators.combining import join_dataframes
from weftline.operators.hot_keys import hot_keys

HOW = ["inner", "left", "right", "full", "semi", "anti"]


@pytest.fixture
def shuffled(spark):
    """Joins that shuffle, over partitions that are left as they are."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(str(sorted(r.asDict().items(), key=lambda x: x[0])) for r in df.collect())


def sides(spark):
    """Keys hot on both sides, on the left, on the right, on one side alone, and null; others once or twice."""
    hot = lambda *parts: F.coalesce(*[F.when(c, F.lit(v)) for c, v in parts], F.col("id") + 1000)
    i = F.col("id")
    left = spark.range(3000).select(F.when(i % 10 != 9, hot((i % 10 < 2, 1), (i % 10 < 4, 2), (i % 10 < 6, 3))).alias("k"), i.alias("a"))
    right = spark.range(600).select(F.when(i % 10 != 9, hot((i % 10 < 1, 1), (i % 10 < 5, 4), (i % 10 < 7, 5), (i == 7, 2))).alias("k"), i.alias("b"))
    return left, right.unionByName(spark.createDataFrame([(3000 + 7, -1), (3, -2)], "k bigint, b bigint").filter("k > 3"))


@pytest.mark.parametrize("how", HOW)
def test_equals_the_plain_join(shuffled, how):
    left, right = sides(shuffled)
    for options in ({"on": "k"}, {"on": "k", "coalesce_keys": False}):
        assert rows(join_dataframes(left, right, how=how, spread_hot_keys=True, **options)) == rows(join_dataframes(left, right, how=how, **options))


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_several_keys_of_other_types(shuffled, how):
    left, right = sides(shuffled)
    day = F.expr("date_add(DATE '2024-01-01', cast(k % 3 as int))")
    left, right = (df.withColumns({"day": day, "s": F.col("k").cast("string")}) for df in (left, right.withColumnRenamed("b", "b2")))
    got = join_dataframes(left, right.drop("k"), how=how, on=["s", "day"], spread_hot_keys=True)
    assert rows(got) == rows(join_dataframes(left, right.drop("k"), how=how, on=["s", "day"]))
    assert isinstance(left.filter("day IS NOT NULL").first().day, datetime.date)


def test_keys_of_most_rows_are_found(shuffled):
    left, right = sides(shuffled)
    found, (n, m), tasks = hot_keys(left.select(F.col("k").alias("x")), right.select(F.col("k").alias("y")), ["x"], ["y"])
    assert (n, m, tasks) == (2700, 541, 16)
    assert found == {(1,): (600, 60), (2,): (600, 1), (3,): (600, 0), (4,): (0, 240), (5,): (0, 120)}


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_half_of_the_rows_spread_over_tasks(shuffled, how):
    i = F.col("id")
    left = shuffled.range(40_000).select(F.when(i % 2 == 0, -1).otherwise(i).alias("k"), i.alias("a"))
    right = shuffled.range(200).select(F.when(i < 20, -1).otherwise(i * 100 + 1).alias("k"), i.alias("b"))
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    plain, spread = (join_dataframes(left, right, how=how, on="k", spread_hot_keys=s) for s in (False, True))
    assert plain.count() == spread.count() > 400_000
    assert max(sizes(plain)) > 400_000 > 4 * max(sizes(spread))


def test_keys_that_cannot_be_spread_are_joined_as_usual(shuffled):
    left, right = sides(shuffled)
    for kind in ("double", "int"):
        other = right.withColumn("k", F.col("k").cast(kind))
        got = join_dataframes(left, other, how="full", on="k", spread_hot_keys=True)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
        assert got.count() == join_dataframes(left, right, how="full", on="k").count()
    assert join_dataframes(left.limit(0), right, how="left", on="k", spread_hot_keys=True).count() == 0


def test_large_frames_are_not_broadcast(spark, monkeypatch, caplog, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    left, right = spark.range(10), spark.read.parquet(str(tmp_path / "t"))
    plan = lambda: join_dataframes(left, right, how="inner", on="id", broadcast=True)._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(combining, "MAX_BROADCAST_BYTES", 10)
    with caplog.at_level(logging.WARNING, "weftline.joins"):
        assert "strategy=broadcast" not in plan()
    assert "not broadcast" in caplog.text
