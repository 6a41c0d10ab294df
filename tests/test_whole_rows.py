"""Pivots of many values, samples and rows kept whole: the same rows however the data lie."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions.frames import drop_duplicates_keeping_rows, get_data_skew, orderable, planned_partitions
from weftline.functions.methods import frame_method
from weftline.operators import Pivot, SparkDropDuplicates, reshaping


def text_rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        day = datetime.datetime(2024, 1, 1 + rng.randrange(20))
        rows.append((rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, "x", "y", "z w"]), rng.choice([None, *range(9)]), rng.random(), rng.choice(["s", "t", None]), day, [i % 3]))
    return spark.createDataFrame(rows, "k string, g int, p string, v int, d double, s string, t timestamp, a array<int>").repartition(5).cache()


@pytest.mark.parametrize("given", [None, ["x", "z w", "none of them"]])
@pytest.mark.parametrize(("agg", "values"), [("sum", ["v", "d"]), ("max", ["s", "t", "v"]), ("min", "a"), ("mean", "v"), ("len", "v"), ("len", ["s", "v"])])
def test_wide_pivots_equal_narrow_ones(cells, monkeypatch, agg, values, given):
    make = lambda: Pivot(pivot_col="p", id_cols=["k", "g"], aggregate_function=agg, values_cols=values, pivot_values=given).transform(cells)
    narrow = make()
    monkeypatch.setattr(reshaping, "WIDE", 0)
    wide = make()
    assert "MapInArrow" in wide._jdf.queryExecution().toString() and "MapInArrow" not in narrow._jdf.queryExecution().toString()
    assert [(f.name, f.dataType) for f in wide.schema] == [(f.name, f.dataType) for f in narrow.schema]
    close = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert close(wide) == close(narrow) and wide.count() == 9


def test_first_and_last_of_one_row_a_cell(spark, monkeypatch):
    df = spark.createDataFrame([(1, "x", None), (1, "y", "b"), (2, "y", "c")], "k int, p string, v string")
    monkeypatch.setattr(reshaping, "WIDE", 0)
    for agg in ("first", "last"):
        assert text_rows(Pivot(pivot_col="p", id_cols="k", aggregate_function=agg).transform(df)) == ["Row(k=1, x=None, y='b')", "Row(k=2, x=None, y='c')"]
    assert Pivot(pivot_col="p", id_cols="k").transform(df.limit(0)).collect() == []


def test_median_cells_are_selected(cells):
    out = Pivot(pivot_col="p", id_cols="g", aggregate_function="median", values_cols="v").transform(cells)
    assert "median" not in out._jdf.queryExecution().toString().lower().replace("weftline", "")
    want = {(r.g, r.p): r.m for r in cells.groupBy("g", "p").agg(F.median("v").alias("m")).collect()}
    assert {(r.g, p): r["null" if p is None else p] for r in out.collect() for p in (None, "x", "y", "z w")} == want


def test_thousands_of_values(spark):
    df = spark.range(30_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3_000).cast("int").alias("p"), F.col("id").alias("v"))
    out = Pivot(pivot_col="p", id_cols="k", aggregate_function="sum", values_cols="v").transform(df)
    assert len(out.columns) == 3001
    got = {r.k: r for r in out.collect()}
    want = collections.Counter()
    for i in range(30_000):
        want[i % 7, i % 3000] += i
    assert all(got[k][str(p)] == (want[k, p] if (k, p) in want else None) for k in range(7) for p in range(0, 3000, 7))


# samples


def test_samples_do_not_depend_on_how_rows_lie(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("a"), F.concat(F.lit("s"), F.col("id") % 10).alias("b"), F.array("id").alias("c"), F.create_map(F.lit("k"), F.col("id") % 3).alias("m"))
    sample = frame_method("sample")
    draws = [text_rows(sample(df.repartition(n), n=200, seed=4)) for n in (1, 7, 50)]
    assert len(draws[0]) == 200 and draws[0] == draws[1] == draws[2]
    assert text_rows(sample(df, n=200, seed=5)) != draws[0]
    assert sample(df, n=99_999, seed=1).count() == 5000 and sample(df, n=0, seed=1).count() == 0 and sample(df, n=10).count() == 10
    assert sample(df.limit(0), n=5, seed=1).collect() == []


def test_copies_are_drawn_one_by_one(spark):
    """Half of the rows are one row; about half of the sample is, for every seed."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("a"))
    for seed in range(4):
        got = [r.a for r in frame_method("sample")(df, n=1000, seed=seed).collect()]
        assert len(got) == 1000 and 420 < got.count(-1) < 580
        assert max(n for a, n in collections.Counter(got).items() if a != -1) == 1


# rows kept whole


def test_rows_are_kept_whole(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, 1, 2]), {rng.choice("xy"): rng.randrange(3), "z": 1}, [{"q": rng.randrange(2)}], (rng.randrange(3), {1: rng.random() < 0.5})) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, v int, m map<string, int>, l array<map<string, int>>, s struct<i: int, m: map<int, boolean>>")
    given = {str(r) for r in df.collect()}
    for agg in ("max", "min"):
        draws = [text_rows(drop_duplicates_keeping_rows(df.repartition(n), "k", agg)) for n in (1, 6, 40)]
        assert draws[0] == draws[1] == draws[2] and len(draws[0]) == 2 and set(draws[0]) <= given
    got = text_rows(SparkDropDuplicates(columns="k", keep_rows=True).transform(df))
    assert got == text_rows(drop_duplicates_keeping_rows(df, "k"))
    by_map = drop_duplicates_keeping_rows(df.select("m", "v"), "m", "min")
    assert by_map.count() == df.select(orderable(F.col("m"), df.schema["m"].dataType)).distinct().count()
    with pytest.raises(ValueError):
        drop_duplicates_keeping_rows(df, "k", "first")
    with pytest.raises(AssertionError):
        drop_duplicates_keeping_rows(df, "nothing")
    assert drop_duplicates_keeping_rows(df.limit(0), "k").collect() == []


def test_a_map_is_its_entries_in_any_order(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, 1 AS i UNION ALL SELECT map('b', 2, 'a', 1), 2 UNION ALL SELECT NULL, 3")
    assert df.select(orderable(F.col("m"), df.schema["m"].dataType)).distinct().count() == 2
    assert [r.i for r in drop_duplicates_keeping_rows(df, "m").orderBy("i").collect()] == [2, 3]


def test_skew_counts_empty_partitions(spark):
    skew = get_data_skew(spark.range(0, 10, 1, 4).filter("id < 3"))
    assert (skew.partitions, skew.rows, skew.min, skew.max) == (4, 3, 0, 2)
    assert planned_partitions(spark.range(0, 10, 1, 6)) == 6 and planned_partitions(spark.range(10).groupBy("id").count()) == 4
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
