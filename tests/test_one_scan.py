"""Forks in one scan give the rows that unions give."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import (
    AddLiterals,
    AssertNotEmpty,
    Cast,
    ColumnsToMap,
    DataFrameMethod,
    DropColumns,
    DropNulls,
    Filter,
    GroupBy,
    MathOperator,
    RenameColumns,
    Repartition,
    SelectColumns,
    SparkExplode,
    When,
    WithColumns,
)
from weftline.plans import TransformerPipeline
from weftline.plans import executor as executor_module


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else float(i % 5), f"s{i % 3}", [i, i + 1]) for i in range(60)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, "i int, x double, s string, a array<int>").write.parquet(path)
    return spark.read.parquet(path)


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def rows(df):
    return sorted(map(str, df.collect()))


def both(monkeypatch, make, df):
    """The pipeline's result, and that of the union of its sides."""
    one = make().run(df, verbose=False)
    with monkeypatch.context() as m:
        m.setattr(executor_module.Executor, "_in_one_scan", lambda *_: None)
        two = make().run(df, verbose=False)
    return one, two


def halves(df):
    return {"low": df.filter("x < 2"), "rest": df.filter(~F.coalesce(F.col("x") < 2, F.lit(False)))}


def overlapping(df):
    return {"low": df.where(df["x"] < 3).select("i", "x", "s"), "high": df.filter(df.x > 1).drop("a")}


DOUBLE = MathOperator(strategy={"new_column_name": "x", "strategy": [{"column": "x"}, {"constant": 2}], "operations": ["mul"]})
CASES = {
    "apply": lambda: TransformerPipeline([DOUBLE, AddLiterals(data=[{"alias": "s", "value": "new"}])], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}),
    "apply and otherwise": lambda: TransformerPipeline(
        [SelectColumns(columns=["s", "i"]), Cast(cast={"i": "str"})], apply_to_rows={"input_col": "x", "operator": "is_in", "value": [1.0, 3.0]}, otherwise=[Cast(cast={"i": "str"}), SelectColumns(columns=["i", "s"])]
    ),
    "a filter within": lambda: TransformerPipeline([Filter(input_col="s", operator="eq", value="s1"), DropNulls(columns="x")], apply_to_rows={"input_col": "i", "operator": "lt", "value": 40}),
    "missing columns": lambda: TransformerPipeline([AddLiterals(data=[{"alias": "kind", "value": 1}])], apply_to_rows={"input_col": "x", "operator": "is_null"}, allow_missing_columns=True),
    "compared columns": lambda: TransformerPipeline([DropColumns(columns="a")], apply_to_rows={"input_col": "i", "operator": "lt", "comparison_column": "x"}, otherwise=[DropColumns(columns="a")]),
    "nested": lambda: TransformerPipeline(
        [TransformerPipeline([When(output_col="t", conditions=[{"input_col": "x", "operator": "gt", "value": 3, "output_col": "s"}], otherwise_constant="few")]), RenameColumns(mapping={"t": "s", "s": "t"})],
        apply_to_rows={"input_col": "s", "operator": "ne", "value": "s0"}, otherwise=[WithColumns(columns="s", method="str.to_uppercase", alias="t")],
    ),
    "split": lambda: TransformerPipeline({"low": [AddLiterals(data=[{"alias": "s", "value": "low"}])], "rest": []}, split_function=halves),
    "split, overlapping": lambda: TransformerPipeline({"low": [DOUBLE], "high": [Filter(input_col="s", operator="ne", value="s2")]}, split_function=overlapping, split_apply_before_appending=[SelectColumns(columns=["i", "x"])]),
    "split, empty side": lambda: TransformerPipeline({"low": [DOUBLE], "rest": []}, split_function=lambda df: {"low": df.filter("x > 99"), "rest": df.filter("x > 2")}, splits_skip_if_empty=["low"]),
    "branch": lambda: TransformerPipeline([Filter(input_col="x", operator="le", value=1), ColumnsToMap(output_column="m", columns=["s"]), DropColumns(columns="m")], branch={"end": "append"}),
    "branch and otherwise": lambda: TransformerPipeline([SelectColumns(columns=["i"])], branch={"end": "append"}, otherwise=[SelectColumns(columns=["i"]), Filter(input_col="i", operator="gt", value=50)]),
    "partitions": lambda: TransformerPipeline([DOUBLE], apply_to_rows={"input_col": "i", "operator": "gt", "value": 9}, repartition_output_to_original=True),
}


@pytest.mark.parametrize("name", CASES)
def test_one_scan(table, monkeypatch, name):
    one, two = both(monkeypatch, CASES[name], table)
    assert scans(one) == 1 and scans(two) == (1 if "empty" in name else 2)
    assert [(f.name, f.dataType) for f in one.schema] == [(f.name, f.dataType) for f in two.schema]
    assert rows(one) == rows(two) and rows(one)


UNIONS = {
    "aggregate": lambda: TransformerPipeline([GroupBy(groupby_columns="s", aggregations={"max": "i"})], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}, otherwise=[SelectColumns(columns=["s", "i"])]),
    "generator": lambda: TransformerPipeline([SparkExplode(input_col="a"), Cast(cast={"a": "string"})], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}, otherwise=[Cast(cast={"a": "string"})]),
    "function": lambda: TransformerPipeline([lambda df: df.limit(100)], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}),
    "assertion": lambda: TransformerPipeline([AssertNotEmpty()], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}),
    "ordered": lambda: TransformerPipeline([WithColumns(columns="x", method="shift", kwargs={"order_by": "i", "partition_by": "s"})], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}),
    "over all": lambda: TransformerPipeline([WithColumns(columns="i", method="cum_sum", kwargs={"order_by": "i"}), Cast(cast={"i": "int32"})], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}),
    "method": lambda: TransformerPipeline([DataFrameMethod(method="head", args=[100])], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}),
    "other types": lambda: TransformerPipeline([Cast(cast={"i": "long"})], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}),
    "split by a job": lambda: TransformerPipeline({"low": [DOUBLE], "rest": []}, split_function=lambda df: {"low": df.filter(F.col("x") < 2), "rest": df.filter(F.col("x") >= df.agg(F.lit(2)).first()[0])}),
    "dead end": lambda: TransformerPipeline([DOUBLE], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2, "dead-end": True}),
}


@pytest.mark.parametrize("name", UNIONS)
def test_other_forks_stay_unions(table, monkeypatch, name):
    one, two = both(monkeypatch, UNIONS[name], table)
    assert rows(one) == rows(two) and rows(one)
    assert scans(one) == scans(two)


def test_nothing_is_computed_on_rows_of_other_sides(spark, table):
    """A side's overflow on rows that are not its own does not come up."""
    big = table.withColumn("n", F.when(F.col("i") < 30, F.lit(2**62)).otherwise(F.col("i").cast("bigint")))
    times = MathOperator(strategy={"new_column_name": "n", "strategy": [{"column": "n"}, {"constant": 4}], "operations": ["mul"]})
    out = TransformerPipeline([times], apply_to_rows={"input_col": "i", "operator": "ge", "value": 30}).run(big, verbose=False)
    assert scans(out) == 1 and {r.n for r in out.collect() if r.i >= 30} == {4 * i for i in range(30, 60)}


def test_failures_come_from_the_step(table):
    wrong = TransformerPipeline([DOUBLE, SelectColumns(columns=["nothing"])], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2})
    with pytest.raises(AssertionError, match="nothing"):
        wrong.run(table, verbose=False)
    different = TransformerPipeline([SelectColumns(columns=["i"])], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2})
    with pytest.raises(ValueError):
        different.run(table, verbose=False)


def test_a_split_function_is_called_with_a_frame_where_it_needs_one(table):
    calls = []

    def split(df):
        calls.append(type(df).__name__)
        return {"low": df.filter("x < 2").sample(1.0), "rest": df.filter("x >= 2")}

    out = TransformerPipeline({"low": [DOUBLE], "rest": []}, split_function=split).run(table, verbose=False)
    assert calls == ["Rows", "DataFrame"] and out.count() == table.filter("x IS NOT NULL").count()


def test_no_job_before_the_action(spark, table):
    """Merge options and skipped sides ask the plan, and not the data."""
    tracker, group = spark.sparkContext.statusTracker(), "no-job"
    spark.sparkContext.setJobGroup(group, group)
    grouped = table.groupBy("s").agg(F.max("i").alias("i"), F.max("x").alias("x"))
    out = TransformerPipeline([DOUBLE], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}, repartition_output_to_original=True).run(grouped, verbose=False)
    again = TransformerPipeline([Repartition(num_partitions=2)], apply_to_rows={"input_col": "x", "operator": "gt", "value": 2}, coalesce_output_to_original=True).run(grouped, verbose=False)
    skipped = TransformerPipeline({"low": [DOUBLE], "rest": []}, split_function=halves, splits_skip_if_empty=["low"]).run(table, verbose=False)
    assert not list(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "other")
    assert out.count() == again.count() == 3 and skipped.count() == 60
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Repartition 4, true") == 1
